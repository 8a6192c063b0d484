"""Running indicators of completed bars, with state per product.

State holds the averages and the last bar; bars at or before the last one seen are ignored, so
the source may send its newest bars again. Send bars once they are final."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EPS = 1e-12
OUT = "product_id STRING, ts_start TIMESTAMP_NTZ, ema_diff_pct DOUBLE, atr DOUBLE, adx DOUBLE, obv DOUBLE"
STATE = "last_us LONG, high DOUBLE, low DOUBLE, close DOUBLE, fast DOUBLE, slow DOUBLE, atr DOUBLE, pdm DOUBLE, mdm DOUBLE, adx DOUBLE, obv DOUBLE"


def advance(state: tuple | None, bar: tuple) -> tuple:
    """One step; bar: (microseconds, high, low, close, volume)."""
    us, high, low, close, volume = bar
    if state is None:
        return (us, high, low, close, close, close, high - low, 0.0, 0.0, 0.0, 0.0)
    _, ph, pl, pc, fast, slow, atr, pdm, mdm, adx, obv = state
    up, down = high - ph, pl - low
    a = 1 / 14
    mean = lambda old, new, w: old * (1 - w) + new * w
    atr = mean(atr, max(abs(high - low), abs(high - pc), abs(low - pc)), a)
    pdm = mean(pdm, up if up > down and up > 0 else 0.0, a)
    mdm = mean(mdm, down if down > up and down > 0 else 0.0, a)
    p, m = 100 * pdm / (atr + EPS), 100 * mdm / (atr + EPS)
    adx = mean(adx, 100 * abs(p - m) / (p + m + EPS), a)
    obv += ((close > pc) - (close < pc)) * volume
    return (us, high, low, close, mean(fast, close, 2 / 13), mean(slow, close, 2 / 27), atr, pdm, mdm, adx, obv)


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = tuple(state.get) if state.exists else None
    rows = pd.concat(list(frames)).sort_values("ts_start")
    out = []
    for r in rows.itertuples(index=False):
        us = int(pd.Timestamp(r.ts_start).value // 1000)
        if held is not None and us <= held[0]:
            continue
        held = advance(held, (us, r.high, r.low, r.close, r.volume))
        out.append((key[0], r.ts_start, (held[4] - held[5]) / (r.close + EPS), held[6], held[9], held[10]))
    if held is not None:
        state.update(held)
    yield pd.DataFrame(out, columns=["product_id", "ts_start", "ema_diff_pct", "atr", "adx", "obv"])


def running_indicators(bars: DataFrame) -> DataFrame:
    """A stream of completed bars (product_id, ts_start, high, low, close, volume) to its indicators."""
    rows = bars.select("product_id", "ts_start", "high", "low", "close", "volume")
    return rows.groupBy("product_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
