"""Streaming ingestion: bars from trades, and upserts into a versioned candle store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import Store


def bars(trades: DataFrame, seconds: int, *, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Completed tumbling bars of a stream of (product_id, ts, price, volume, seq)."""
    order = F.struct(ts, "seq")
    grouped = trades.withWatermark(ts, late).groupBy("product_id", F.window(ts, f"{seconds} seconds").alias("w"))
    made = grouped.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.max("seq").alias("ingest_seq"))
    return made.select("product_id", F.lit(seconds).alias("granularity_sec"), F.col("w.start").cast("timestamp_ntz").alias("ts_start"), "open", "high", "low", "close", "volume", "ingest_seq")


def merge(fresh: DataFrame, path: str, txn: tuple[str, int] | None = None) -> int:
    """Upsert a batch into the versioned store at path; a batch that is sent again under its txn changes nothing."""
    return Store(fresh.sparkSession, path).merge(fresh, txn=txn)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, *, interval: str | None = "30 minutes") -> StreamingQuery:
    """Micro-batches on aligned ticks (or all that is there now, with interval None) into the store, each exactly once."""
    out = stream.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(lambda batch, epoch: merge(batch, path, (checkpoint, epoch)))
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
