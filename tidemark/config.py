"""Settings of the candle engine: one frozen value passed to the builders."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

#: Fixed values.
STABLE_BASES = ("USDT", "USDC", "DAI", "TUSD", "USDP", "GUSD", "FRAX", "LUSD", "EURC", "BUSD")


def parse_list(text: str | None) -> tuple[str, ...]:
    """Comma-separated, trimmed, empty entries dropped, upper case."""
    return tuple(x.strip().upper() for x in (text or "").split(",") if x.strip())


def parse_flag(text: str | None, default: bool) -> bool:
    return default if text is None else text.strip().lower() in {"1", "true", "yes", "y", "on"}


@dataclass(frozen=True)
class Settings:
    # fixed values: the defaults of all settings
    horizon_minutes: int = 240
    horizon_mode: str = "FIXED"
    scan_interval_minutes: int = 30
    min_bars_5m: int = 7
    benchmark_symbol: str = "BTC-USD"
    crypto_universe: tuple[str, ...] | None = None
    quote_allowlist: tuple[str, ...] = ("USD", "USDT", "USDC")
    stablecoin_bases: tuple[str, ...] = STABLE_BASES
    exclude_stablecoin_base: bool = True
    universe_max: int = 0
    universe_refresh_minutes: int = 360
    max_candle_staleness_minutes: int = 60
    train_lookback_days: int = 60
    train_max_products: int = 0
    calib_min_bucket_samples: int = 200
    enet_c_values: tuple[float, ...] = (0.5, 1.0)
    enet_l1_values: tuple[float, ...] = (0.0, 0.5)
    prior_alpha_values: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9)
    auto_train: bool = True
    auto_train_max_products: int = 20
    auto_train_lookback_days: int = 14
    auto_train_cooldown_minutes: int = 60
    tod_rvol_lookback_days: int = 20
    tod_rvol_min_days: int = 8
    liq_rolling_bars: int = 12
    liq_dvol_min_usd: float = 2_000_000.0
    liq_range_pct_max: float = 0.012
    liq_wick_atr_max: float = 0.8
    max_rps: float = 5.0
    max_inflight: int = 5
    extra: Mapping[str, str] = field(default_factory=dict, hash=False, compare=False)

    @classmethod
    def from_mapping(cls, env: Mapping[str, str]) -> Settings:
        """Settings from upper-case names; malformed numbers fall back to the default, malformed number lists raise."""
        got = {}
        for f in fields(cls):
            text = env.get(f.name.upper())
            if text is None or f.name == "extra":
                continue
            default = f.default
            if f.name in ("enet_c_values", "enet_l1_values", "prior_alpha_values"):
                got[f.name] = tuple(float(x) for x in parse_list(text))
            elif isinstance(default, bool):
                got[f.name] = parse_flag(text, default)
            elif isinstance(default, int | float):
                try:
                    got[f.name] = type(default)(text)
                except ValueError:
                    pass
            elif isinstance(default, tuple) or f.name == "crypto_universe":
                got[f.name] = parse_list(text) or default
            else:
                got[f.name] = text.strip().upper()
        return cls(**got)
