"""Forward as-of join without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, value: str, by: str = "product_id") -> DataFrame:
    """left with the value of the first right row at or after left_ts; past the end, of the last right row.

    A day of one key is the most that a task orders: both sides meet as a union per day, and one
    row per day carries the first value of the days that follow."""
    l = left.withColumns({"_ts": F.col(left_ts), "_side": F.lit(0), "_v": F.lit(None).cast("double"), "_day": F.to_date(left_ts)})  # noqa: E741
    r = right.select(by, F.col(right_ts).alias("_ts"), F.lit(1).alias("_side"), F.col(value).alias("_v"), F.to_date(right_ts).alias("_day"))
    none = F.lit(None).cast("double")
    firsts = r.groupBy(by, "_day").agg(F.min_by("_v", "_ts").alias("_first"), F.max_by("_v", "_ts").alias("_last"))
    asked = l.select(by, "_day", none.alias("_first"), none.alias("_last")).distinct()
    days = firsts.unionByName(asked).groupBy(by, "_day").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    w = Window.partitionBy(by).orderBy("_day")
    later = F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    end = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    days = days.select(F.col(by).alias("_by"), F.col("_day").alias("_d"), later.alias("_later"), end.alias("_end"))

    both = l.unionByName(r, allowMissingColumns=True)
    # in reverse order the frame only grows, so a day of n rows takes n steps
    in_day = Window.partitionBy(by, "_day").orderBy(F.col("_ts").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(in_day)).where("_side = 0")
    joined = found.join(days, (F.col(by) == F.col("_by")) & (F.col("_day") == F.col("_d")), "left")
    return joined.withColumn(value, F.coalesce("_found", "_later", "_end")).drop("_ts", "_side", "_v", "_day", "_by", "_d", "_later", "_end", "_found")
