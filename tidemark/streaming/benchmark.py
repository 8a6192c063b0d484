"""The benchmark's return beside each feature row of a stream: a stream-stream join bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_live_benchmark(features: DataFrame, bench: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """features (ts_end, ...) with bench_ret_30m of the benchmark's row (ts_end, ret_30m) of the same time; 0 if it has none.

    Both are streams of completed bars, each bar once. A row waits for its benchmark until the watermark, ``late`` behind the slower
    stream, has passed it; a row of either side that comes later than that is dropped, as is what state holds of times
    before it, so state is bounded by the lateness and not by the streams' length. Rows come out once, in append mode."""
    time = "_at"
    left = features.drop("bench_ret_30m").withColumn(time, F.col("ts_end").cast("timestamp")).withWatermark(time, late)
    right = bench.select(F.col("ts_end").cast("timestamp").alias("_bench_at"), F.col("ret_30m").alias("bench_ret_30m")).withWatermark("_bench_at", late)
    out = left.join(right, F.col(time) == F.col("_bench_at"), "leftOuter")
    return out.withColumn("bench_ret_30m", F.coalesce("bench_ret_30m", F.lit(0.0))).drop(time, "_bench_at")
