"""All 25 features of a stream of completed bars, with typed state per product.

State of a product (``transformWithStateInPandas``):

* ``head``: schema version, bars seen, bars given out, and the running averages and sums after the last bar;
* ``ring``: its last 72 bars with the averages after each, the longest reach of a rolling window.

Both have a time to live, so products that are gone leave no state. A micro-batch reads a product's state once, advances
the averages bar by bar, computes every window over ring and new bars in numpy, and writes the state once.

The first bars take the volume-weighted price of the sixth, as in batch, so they wait for it; a timer gives them out with
their closes if it does not come within ``hold``. Bars at or before the last one seen are ignored: the source may
send its newest bars again, once they are final. Null prices or volumes make a bar unusable; it is dropped."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Settings
from ..functions.scalar import EPS
from ..schemas import FEATURES

STATE_VERSION = 1
RING = 72
#: Bars that the volume-weighted price needs.
LEAST = 6
AVERAGES = ("fast", "slow", "atr", "pdm", "mdm", "adx", "obv")
BAR = ("us", "open", "high", "low", "close", "volume")
HEAD_SCHEMA = "version INT, seen LONG, given LONG, " + ", ".join(f"{x} {'LONG' if x == 'us' else 'DOUBLE'}" for x in ("us", "high", "low", "close", *AVERAGES))
RING_SCHEMA = ", ".join(f"{x} {'LONG' if x == 'us' else 'DOUBLE'}" for x in (*BAR, *AVERAGES))
OUT = "product_id STRING, ts_end TIMESTAMP_NTZ, i LONG, " + ", ".join(f"{f} DOUBLE" for f in FEATURES)
#: Days without a bar after which a product's state is dropped; seconds that its first bars wait.
TTL_DAYS, HOLD_SECONDS = 60, 3600
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(last: tuple | None, bar: tuple) -> tuple:
    """(fast, slow, atr, pdm, mdm, adx, obv) after bar, from (high, low, close, *averages) after the one before."""
    _, _, high, low, close, volume = bar
    if last is None:
        return (close, close, high - low, 0.0, 0.0, 0.0, 0.0)
    before_high, before_low, before, fast, slow, atr, pdm, mdm, adx, obv = last
    mean = lambda old, new, a: old * (1 - a) + new * a
    up, down, a = high - before_high, before_low - low, 1 / 14
    atr = mean(atr, max(abs(high - low), abs(high - before), abs(low - before)), a)
    pdm = mean(pdm, up if up > down and up > 0 else 0.0, a)
    mdm = mean(mdm, down if down > up and down > 0 else 0.0, a)
    plus, minus = 100 * pdm / (atr + EPS), 100 * mdm / (atr + EPS)
    adx = mean(adx, 100 * abs(plus - minus) / (plus + minus + EPS), a)
    return (mean(fast, close, 2 / 13), mean(slow, close, 2 / 27), atr, pdm, mdm, adx, obv + float(np.sign(close - before)) * volume)


def frames(x: np.ndarray, n: int, last: int = 0) -> np.ndarray:
    """For each row the n values that end ``-last`` rows back; NaN before the first."""
    if not len(x):
        return np.zeros((0, n))
    padded = np.concatenate([np.full(n - 1 - last, np.nan), x])[: len(x) + n - 1]
    return np.lib.stride_tricks.sliding_window_view(padded, n)


def rolled(fn, x: np.ndarray, n: int, least: int, last: int = 0) -> np.ndarray:
    """fn over the frames of each row, NaN below ``least`` values."""
    window = frames(x, n, last)
    out, enough = np.full(len(x), np.nan), (~np.isnan(window)).sum(1) >= least
    if enough.any():
        out[enough] = fn(window[enough])
    return out


def lagged(x: np.ndarray, k: int = 1) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[:-k]])


def scrubbed(x: np.ndarray, default: float = 0.0) -> np.ndarray:
    return np.where(np.isfinite(x), x, default)


def features_of(rows: np.ndarray, start: int, cfg: Settings) -> dict[str, np.ndarray]:
    """The 25 columns of bars (RING_SCHEMA, one row each) of which the first is the product's start-th. Rows less than RING
    behind the first one are exact only if start is 0."""
    us, o, h, l, c, v = rows[:, :6].T  # noqa: E741
    fast, slow, atr, _, _, adx, obv = rows[:, 6:].T
    n = max(3, cfg.liq_rolling_bars)
    with np.errstate(all="ignore"):
        change = lagged(c)
        log = np.log((c + EPS) / (change + EPS))
        if not start and len(log):
            log[0] = 0.0
        total = lambda w: np.cumsum(np.nan_to_num(w), 1)[:, -1]  # from the oldest on, as windows of a batch add
        middle = lambda w: np.nanmedian(w, 1)
        vwap = rolled(total, c * v, 24, LEAST) / (rolled(total, v, 24, LEAST) + EPS)
        if not start:
            vwap[: LEAST - 1] = vwap[LEAST - 1] if len(vwap) >= LEAST else np.nan
        vwap = np.where(np.isnan(vwap), c, vwap)
        step = np.arange(24) - 11.5
        flow = rolled(lambda w: (w * step).sum(1) / (step * step).sum(), obv, 24, 24)
        minute = us // 60_000_000 % 1440 + 5
        minute = minute % 1440
        left = np.minimum(np.maximum(0, 1439 - minute), cfg.horizon_minutes) if cfg.horizon_mode == "UTC_DAY_END" else np.full(len(c), float(cfg.horizon_minutes))
        frac = np.clip(left / cfg.horizon_minutes, 0, 1)
        wick, spread = (h - np.maximum(o, c) + np.minimum(o, c) - l) / (atr + EPS), (h - l) / (c + EPS)
        ret_30m, rvol = scrubbed(c / lagged(c, 6) - 1), scrubbed(v / (rolled(middle, v, n, 3, -1) + EPS), 1.0)
        place, trend = (c - vwap) / (atr + EPS), (fast - slow) / (c + EPS)
        out = {
            "price": c, "vwap": vwap, "ret_5m": c / change - 1, "ret_30m": ret_30m, "bench_ret_30m": np.zeros(len(c)), "ema_diff_pct": trend, "adx": adx,
            "atr_pct": atr / (c + EPS), "rv": rolled(lambda w: np.nanstd(w, 1, ddof=1), log, 24, 6), "rvol_tod": rvol, "obv_slope": flow, "vwap_loc": place,
            "donch_dist": (rolled(lambda w: np.nanmax(w, 1), h, RING, 6) - c) / (atr + EPS), "time_remaining_frac": frac, "log_minutes_remaining": np.log1p(left),
            "tod_frac": minute / 1440, "log1p_med_dvol": np.log1p(scrubbed(rolled(middle, c * v, n, 3))), "med_range_pct": rolled(middle, spread, n, 3),
            "cur_range_pct": spread, "med_wick_atr": rolled(middle, wick, n, 3), "cur_wick_atr": wick, "i_ret30_rvol": ret_30m * (rvol - 1),
            "i_ret30_vwaploc": ret_30m * place, "i_ema_adx": trend * adx, "i_ret30_timefrac": ret_30m * frac,
        }
    return {f: scrubbed(out[f]) for f in FEATURES}


class Features(StatefulProcessor):
    def __init__(self, cfg: Settings, ttl_days: float | None = TTL_DAYS, hold: float = HOLD_SECONDS):
        if max(3, cfg.liq_rolling_bars) >= RING:
            raise ValueError(f"windows of {RING} bars and more do not fit the ring")
        self.cfg, self.hold = cfg, int(hold * 1000)
        self.ttl = int(ttl_days * 86_400_000) if ttl_days else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD_SCHEMA, self.ttl)
        self.ring = handle.getListState("ring", RING_SCHEMA, self.ttl)

    def _state(self) -> tuple[tuple | None, np.ndarray]:
        """(head, bars of the ring). A product of which either part has outlived its time starts anew."""
        head = self.head.get() if self.head.exists() else None
        if head is None:
            return None, np.zeros((0, len(BAR) + len(AVERAGES)))
        head = tuple(head)
        if head[0] != STATE_VERSION:
            raise ValueError(f"state of version {head[0]}; this code reads {STATE_VERSION}: start from a new checkpoint")
        ring = np.array([tuple(r) for r in self.ring.get()], float) if self.ring.exists() else np.zeros((0, 0))
        return (head, ring) if len(ring) else (None, np.zeros((0, len(BAR) + len(AVERAGES))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).dropna(subset=[*BAR]).sort_values("us")
        head, ring = self._state()
        last = tuple(head[4:]) if head else None
        seen, given, newest = (head[1], head[2], head[3]) if head else (0, 0, None)
        made = []
        for bar in zip(*(fresh[c].tolist() for c in BAR), strict=True):
            if newest is not None and bar[0] <= newest:
                continue
            now = advance(last, bar)
            made.append((*bar, *now))
            last, newest = (*bar[2:5], *now), bar[0]
        if not made:
            return
        bars = np.concatenate([ring, np.array(made, float)])
        seen += len(made)
        waiting = seen < LEAST
        if not waiting:
            yield self._rows(key, bars, seen, given)
            given = seen
        elif given < seen:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold)
        self._put(bars, seen, given)

    def _rows(self, key, bars: np.ndarray, seen: int, given: int) -> pd.DataFrame:
        """Features of the bars that are not given out yet."""
        n = seen - given
        made = features_of(bars, seen - len(bars), self.cfg)
        ends = pd.to_datetime(bars[-n:, 0].astype(np.int64) + 300_000_000, unit="us")
        return pd.DataFrame({"product_id": key[0], "ts_end": ends, "i": np.arange(given, seen), **{f: made[f][-n:] for f in FEATURES}})

    def _put(self, bars: np.ndarray, seen: int, given: int) -> None:
        typed = lambda r: (int(r[0]), *map(float, r[1:]))
        us, _, high, low, close, _, *averages = typed(bars[-1])
        self.head.update((STATE_VERSION, int(seen), int(given), us, high, low, close, *averages))
        self.ring.put([typed(r) for r in bars[-RING:]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head, ring = self._state()
        if head and head[2] < head[1] < LEAST:
            yield self._rows(key, ring, head[1], head[2])
            self._put(ring, head[1], head[1])

    def close(self) -> None:
        pass


@contextmanager
def state_settings(spark: SparkSession, *, drain: bool = False) -> Iterator[None]:
    """Settings of the queries that start inside: state stores that hold typed state. drain: for queries that read what is there
    and end; processing-time state would have them go on with empty batches for ever."""
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER} | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if drain else {})
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def running_features(bars: DataFrame, cfg: Settings, *, ttl_days: float | None = TTL_DAYS, hold: float = HOLD_SECONDS) -> DataFrame:
    """A stream of completed 5-minute bars (product_id, ts_start, open, high, low, close, volume) to (product_id, ts_end, i and
    the 25 features) of each bar, once. Start its query in ``state_settings``."""
    us = F.unix_micros(F.col("ts_start").cast("timestamp")) if dict(bars.dtypes)["ts_start"] == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts_start"))
    rows = bars.select("product_id", us.alias("us"), *BAR[1:])
    return rows.groupBy("product_id").transformWithStateInPandas(Features(cfg, ttl_days, hold), OUT, "append", "ProcessingTime")
