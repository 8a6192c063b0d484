"""Row-exact chunks of long series.

A series of one product can be far longer than a task should hold, and all its windows look back
a bounded number of rows. ``with_chunks`` numbers the rows of each product without ordering a whole
product in one task (counts per day give the offsets), cuts the numbers into chunks, and hands
each chunk the last ``halo`` rows of the one before. Windows over (product, chunk) then equal
windows over the product on the chunk's own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 2048
#: Rows of memory: windows reach back 72; the weight left of an average with factor 1/14 is 3e-21.
HALO = 640


def numbered(rows: DataFrame, order: str = "ts_start", out: str = "i") -> DataFrame:
    """0-based row numbers per product, from counts per day."""
    day = F.to_date(order)
    counts = rows.groupBy("product_id", day.alias("_day")).count()
    before = F.sum("count").over(Window.partitionBy("product_id").orderBy("_day")) - F.col("count")
    offsets = counts.select(F.col("product_id").alias("_p"), F.col("_day").alias("_d"), before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("product_id", "_day").orderBy(order)) - 1
    own = rows.withColumn("_day", day).withColumn("_at", at)
    joined = own.join(offsets, (F.col("product_id") == F.col("_p")) & (F.col("_day") == F.col("_d")))
    return joined.withColumn(out, F.col("_before") + F.col("_at")).drop("_day", "_at", "_p", "_d", "_before")


def with_chunks(rows: DataFrame, chunk: int | None = CHUNK, halo: int = HALO, ahead: int = 0) -> DataFrame:
    """rows with i, chunk and core (false for rows lent to a neighbouring chunk).

    halo: last rows lent to the next chunk; ahead: first rows lent to the one before. Where a product is
    known to have few rows, chunk None makes it one chunk, without counts and a join."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if chunk is None:
        at = F.row_number().over(Window.partitionBy("product_id").orderBy("ts_start")) - 1
        return rows.repartition(tasks, "product_id").withColumns({"i": at.cast("long"), "chunk": F.lit(0), "core": F.lit(True)})
    own = F.floor(F.col("i") / chunk).cast("int")
    at = F.col("i") % chunk
    nobody = F.array().cast("array<int>")
    lent = F.concat(
        F.array("_own"),
        F.when(at >= chunk - halo, F.array(F.col("_own") + 1)).otherwise(nobody) if halo else nobody,
        F.when((at < ahead) & (F.col("_own") > 0), F.array(F.col("_own") - 1)).otherwise(nobody) if ahead else nobody,
    )
    out = numbered(rows).withColumn("_own", own).withColumn("chunk", F.explode(lent))
    out = out.withColumn("core", F.col("chunk") == F.col("_own")).drop("_own")
    # a chunk costs CPU, not bytes: as many tasks as configured, which adaptive execution would merge by size
    return out.repartition(tasks, "product_id", "chunk")
