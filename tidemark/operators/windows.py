"""Rolling, cumulative and exponentially weighted windows over (product, chunk)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BY = ("product_id", "chunk")
BLOCK = 128


def series() -> WindowSpec:
    return Window.partitionBy(*BY).orderBy("i")


def rolling(agg: Column, counted: Column, n: int, least: int, last: int = 0) -> Column:
    """agg over the n rows that end ``-last`` rows back; NULL below ``least`` non-null rows."""
    frame = series().rowsBetween(last - n + 1, last)
    return F.when(F.count(counted).over(frame) >= least, agg.over(frame))


def lag(c: str | Column, k: int = 1) -> Column:
    return F.lag(c, k).over(series())


def median(c: str | Column) -> Column:
    return F.percentile(c, 0.5)


def backfill(c: Column) -> Column:
    """The first non-null value from the row on. A growing frame over the reverse order: each row is visited once."""
    back = Window.partitionBy(*BY).orderBy(F.col("i").desc())
    return F.last(c, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))


def slope(df: DataFrame, value: str, n: int, out: str) -> DataFrame:
    """Least-squares slope of value against row position over n full rows."""
    frame = series().rowsBetween(1 - n, 0)
    fit = F.regr_slope(F.col(value), F.col("i").cast("double"))
    return df.withColumn(out, F.when(F.count(value).over(frame) >= n, fit.over(frame)))


def ewm(df: DataFrame, inputs: dict[str, str], a: float) -> DataFrame:
    """Exponentially weighted means of one factor; inputs: value column -> output column."""
    return ewms(df, [(x, out, a) for x, out in inputs.items()])


def ewms(df: DataFrame, means: list[tuple[str, str, float]]) -> DataFrame:
    """Non-adjusted exponentially weighted means y = (1 - a) y + a x with y0 = x0, as (value, output, a).

    Values must not be null. Rows are cut into blocks of 128. In a block, the weighted sum is a scaled
    cumulative sum; a block's end value carries into the next ones with weight q**128, of which only
    few blocks matter. All of it is windows over the same partitioning: no shuffle, no join; all means
    share the windows."""
    offset = F.col("i") % BLOCK
    in_block = Window.partitionBy(*BY, "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_block": F.floor(F.col("i") / BLOCK), "_first": F.row_number().over(series()) == 1})
    reach, own = {}, {}
    for x, out, a in means:
        q = 1 - a
        far = q**BLOCK
        reach[out] = max(1, math.ceil(math.log(1e-18) / math.log(far))) if far > 0 else 1
        own[out] = F.pow(F.lit(q), offset) * F.sum(F.when(F.col("_first"), F.col(x)).otherwise(a * F.col(x)) * F.pow(F.lit(q), -offset)).over(in_block)
    df = df.withColumns(own)
    # the end values of the 1, 2, ... blocks before, looked up row by row
    past = series().rowsBetween(Window.unboundedPreceding, -1)
    ends = offset == BLOCK - 1
    carried = []
    for k in range(1, max(reach.values()) + 1):
        source = {out: F.col(out) if k == 1 else F.col(f"_{k - 1}_{out}") for out in own if reach[out] >= k}
        df = df.withColumns({f"_{k}_{out}": F.last(F.when(ends, c), ignorenulls=True).over(past) for out, c in source.items()})
        carried += [f"_{k}_{out}" for out in source]
    total = {}
    for _, out, a in means:
        q = 1 - a
        carry = sum((F.coalesce(f"_{k}_{out}", F.lit(0.0)) * F.lit(q ** (BLOCK * (k - 1))) for k in range(1, reach[out] + 1)), F.lit(0.0))
        total[out] = F.col(out) + carry * F.pow(F.lit(q), offset + 1)
    return df.withColumns(total).drop("_block", "_first", *carried)
