"""Does the highest high of the next bars reach a target?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import forward_asof
from ..operators.chunks import CHUNK, with_chunks
from ..sources.candles import keep_last


def future_max(bars: DataFrame, horizon: int, *, by_time: bool = False, chunk: int = CHUNK) -> DataFrame:
    """1-minute bars with h_future: the highest high of the bar and the horizon - 1 rows after it.

    Each chunk of a product borrows the first rows of the next one. by_time: the bars within
    horizon minutes instead of a number of rows (never more rows, for bars a minute apart)."""
    if not by_time:
        return forward_max(bars, horizon, chunk)
    rows = with_chunks(bars, max(chunk, horizon), halo=0, ahead=horizon - 1)
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts_start"))
    w = Window.partitionBy("product_id", "chunk").orderBy(seconds).rangeBetween(0, horizon * 60 - 1)
    return rows.withColumn("h_future", F.max("high").over(w)).where("core").drop("chunk", "core")


def forward_max(bars: DataFrame, horizon: int, chunk: int = CHUNK) -> DataFrame:
    """future_max by rows, at a cost that does not depend on the horizon.

    Rows fall into blocks of ``horizon`` rows, so the rows ahead of one are the rest of its block and the first rows of the
    next: the highest high to the end of its block, and the highest from the start of the block of the row that is
    horizon - 1 ahead. Both are running maxima; past the last row, the last row's stands for those that are not there."""
    rows = with_chunks(bars, max(chunk, horizon), halo=0, ahead=horizon - 1).withColumn("_block", F.floor(F.col("i") / horizon))
    whole = Window.partitionBy("product_id", "chunk")
    block = Window.partitionBy("product_id", "chunk", "_block")
    grow = lambda order: F.max("high").over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_rest", grow(F.desc("i"))).withColumn("_first", grow(F.asc("i")))
    here = F.struct("_block", "_first")
    ahead = F.coalesce(F.lead(here, horizon - 1).over(whole.orderBy("i")), F.last(here).over(whole.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("_ahead", ahead)
    high = F.when(F.col("_ahead._block") > F.col("_block"), F.greatest("_rest", F.col("_ahead._first"))).otherwise(F.col("_rest"))
    return rows.withColumn("h_future", high).where("core").drop("chunk", "core", "_block", "_rest", "_first", "_ahead")


def labels(features: DataFrame, minute_bars: DataFrame, horizon: int, *, targets: dict[str, float] | None = None, as_of: Column | None = None, drop_censored: bool = False, by_time: bool = False) -> DataFrame:
    """features (product_id, ts_end, price, ...) with h_future and one 0/1 column per target.

    A row past the last minute bar takes that bar; rows near the end see a shorter horizon unless
    drop_censored."""
    targets = targets or {"y1": 0.03, "y2": 0.05}
    bars = keep_last(minute_bars)
    if as_of is not None:
        bars = bars.where(F.col("ts_start") + F.expr("INTERVAL 1 MINUTE") <= as_of)
    ahead = future_max(bars, horizon, by_time=by_time)
    if drop_censored:
        ends = ahead.groupBy(F.col("product_id").alias("_p")).agg((F.max("i") + 1).alias("_n"))
        ahead = ahead.join(ends, F.col("product_id") == F.col("_p")).withColumn("h_future", F.when(F.col("i") <= F.col("_n") - horizon, F.col("h_future")))
    out = forward_asof(features, ahead.select("product_id", "ts_start", "h_future"), "ts_end", "ts_start", "h_future")
    if drop_censored:
        out = out.where("h_future IS NOT NULL")
    return out.withColumns({y: F.when(F.col("h_future") >= (1 + pct) * F.col("price"), 1).otherwise(0) for y, pct in targets.items()})
