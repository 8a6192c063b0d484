"""Scans on a schedule: aligned ticks, a warm start from the last version, and a scan after each new model version."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import snapshots


def warm_start(spark: SparkSession, root: str) -> tuple[DataFrame | None, dict | None]:
    """The scores and the document of the last scan below root, or None where there are none."""
    run = snapshots.load_run(spark, f"{root}/scan")
    return (run[0].get("scores"), run[1]) if run else (None, None)


def tick(now: dt.datetime, seconds: int) -> dt.datetime:
    """The last multiple of seconds since midnight that is not after now."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return midnight + dt.timedelta(seconds=int((now - midnight).total_seconds()) // seconds * seconds)


def guarded(spark: SparkSession, scan: Callable[[], None], status: str | None) -> bool:
    """Run scan; what it raises becomes the status document at that path, as its success does. Whether it ended well."""
    error = None
    try:
        scan()
    except Exception as e:  # a scan that fails must not end the schedule
        error = f"{type(e).__name__}: {e}"
        if not status:
            raise
    if status:
        snapshots.publish_document(spark, {"last_error": error, "at": dt.datetime.now(dt.UTC).isoformat()}, status)
    return error is None


def on_ticks(spark: SparkSession, scan: Callable[[], None], checkpoint: str, *, minutes: float = 30, status: str | None = None) -> StreamingQuery:
    """Run scan at once, then at every multiple of minutes since midnight UTC, whether or not minutes divides a day.

    The source is a clock; scan reads the store as it is at the tick and publishes. With a status path, a scan that fails
    leaves its error there and the schedule goes on; without, its error ends the query. A scan that takes longer than
    a tick skips those it missed."""
    seconds = max(1, round(60 * minutes))
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    last: list[dt.datetime] = []

    def step(batch: DataFrame, epoch: int) -> None:
        now = tick(dt.datetime.now(dt.UTC), seconds)
        if last[-1:] != [now]:
            last[:] = [now]
            guarded(spark, scan, status)

    # triggers are aligned to the epoch: every common divisor of the tick and the day meets all ticks
    started = clock.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{math.gcd(seconds, 86_400)} seconds")
    return started.foreachBatch(step).start()


def on_models(spark: SparkSession, root: str, scan: Callable[[], None], checkpoint: str, *, interval: str | None = "10 seconds", status: str | None = None) -> StreamingQuery:
    """Run scan whenever a model version appears below root, whichever process published it.

    The source is the models' logs, read as files; each version is seen once, also after a restart. interval None: what is there
    now, then end. Models need not exist yet."""
    versions = spark.readStream.schema("folder STRING, at STRING").json(f"{root}/pt*/log")

    def step(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            guarded(spark, scan, status)

    out = versions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


def on_candles(stream: DataFrame, scan: Callable[[], None], merge: Callable[[DataFrame], None], checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
    """Merge each micro-batch of candles into the store, then scan. interval None: what is there now, then end."""

    def step(batch: DataFrame, epoch: int) -> None:
        merge(batch)
        scan()

    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
