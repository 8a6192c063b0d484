"""Candle ingestion: wire parsing, range chunks, upserts and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["product_id", "granularity_sec", "ts_start"]
OHLCV = ["open", "high", "low", "close", "volume"]


def parse_wire(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Candles from JSON arrays of [time, low, high, open, close, volume].

    Rows that are no arrays, shorter than six or not castable are dropped, longer ones cut; a
    payload that is no array gives no rows. NaN and infinite values are rejected too."""
    rows = pages.withColumn("_row", F.explode(F.from_json(payload, "array<string>")))
    rows = rows.withColumn("_v", F.from_json("_row", "array<string>")).where(F.size("_v") >= 6)
    value = lambda k: F.expr(f"try_cast(get(_v, {k}) AS DOUBLE)")
    names = {"low": 1, "high": 2, "open": 3, "close": 4, "volume": 5}
    out = rows.withColumns({n: value(k) for n, k in names.items()}).withColumn("_t", F.floor(value(0)))
    good = F.col("_t").isNotNull()
    for n in names:
        good = good & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf")))
    ts = F.timestamp_seconds("_t").cast("timestamp_ntz")
    return out.where(good).withColumn("ts_start", ts).drop("_row", "_v", "_t", payload)


def keep_last(candles: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per key: the one ingested last (highest ingest_seq)."""
    order = Window.partitionBy(*key).orderBy(F.col("ingest_seq").desc(), *[F.col(c).desc() for c in OHLCV])
    return candles.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and fresh candles as one series; fresh rows win."""
    return keep_last(stored.unionByName(fresh))


def fetch_plan(products: DataFrame, stored: DataFrame, granularity: int, start: Column, end: Column, most: int = 300) -> DataFrame:
    """Requests (product_id, from_ts, to_ts) for what the store lacks of [start, end].

    The newest two bars are asked for again, and a gap before the oldest stored bar is filled, so
    a short history never blocks a longer one."""
    have = stored.where(F.col("granularity_sec") == granularity).groupBy("product_id").agg(F.min("ts_start").alias("lo"), F.max("ts_start").alias("hi"))
    span = products.select(F.col("id").alias("product_id")).join(have, "product_id", "left")
    back = F.expr(f"INTERVAL {2 * granularity} SECONDS")
    ranges = F.when(F.col("lo").isNull(), F.array(F.struct(start.alias("s"), end.alias("e")))).otherwise(
        F.array(F.struct(start.alias("s"), F.least(F.col("lo"), end).alias("e")), F.struct(F.greatest(start, F.col("hi") - back).alias("s"), end.alias("e")))
    )
    asked = span.select("product_id", F.explode(ranges).alias("r")).select("product_id", "r.s", "r.e").where("s < e")
    return chunk_ranges(asked, "s", "e", granularity, most)


def chunk_ranges(ranges: DataFrame, start: str, end: str, granularity: int, most: int = 300) -> DataFrame:
    """Cut [start, end] into requests of at most ``most`` bars."""
    step = granularity * most
    cuts = F.sequence(F.lit(0), F.floor((F.timestamp_diff("SECOND", F.col(start), F.col(end)) - 1) / step).cast("int"))
    rows = ranges.where(F.col(start) < F.col(end)).withColumn("_k", F.explode(cuts))
    from_ts = F.col(start) + F.make_dt_interval(secs=F.col("_k") * step)
    to_ts = F.least(F.col(end), F.col(start) + F.make_dt_interval(secs=(F.col("_k") + 1) * step))
    return rows.withColumn("from_ts", from_ts).withColumn("to_ts", to_ts).drop("_k", start, end)


def completed(candles: DataFrame, as_of: Column) -> DataFrame:
    """Adds ts_end and keeps the bars that have ended by as_of."""
    width = F.make_dt_interval(secs=F.col("granularity_sec"))
    return candles.withColumn("ts_end", F.col("ts_start") + width).where(F.col("ts_end") <= as_of)


def resample(trades: DataFrame, seconds: int, *, product: str = "product_id", ts: str = "ts", price: str = "price", volume: str = "volume", seq: str = "seq") -> DataFrame:
    """Tumbling OHLCV bars from trades; one shuffle with map-side partial aggregates."""
    order = F.struct(ts, seq)
    bars = trades.groupBy(F.col(product).alias("product_id"), F.window(ts, f"{seconds} seconds").alias("w")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"),
        F.max(seq).alias("ingest_seq"),
    )
    return bars.select("product_id", F.lit(seconds).alias("granularity_sec"), F.col("w.start").cast("timestamp_ntz").alias("ts_start"), *OHLCV, "ingest_seq")


def events_as_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as trades (price 100 + 0.015 value, volume 1 + props.k)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_type").alias("product_id"), "ts", (100 + 0.015 * F.col("value")).alias("price"), (1 + k).alias("volume"), F.col("event_id").alias("seq"))
