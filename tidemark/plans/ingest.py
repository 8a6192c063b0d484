"""Ingestion as one call: catalog, universe, fetch plan, requests, parsing and the versioned store; and the scan behind it."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..sources import rest, snapshots
from ..sources.candles import OHLCV, fetch_plan, parse_wire
from ..sources.tables import written
from ..sources.versions import Store
from ..streaming.scan import on_ticks
from . import scan as scans
from . import training, universe


@dataclass(frozen=True)
class Ingested:
    """products: the universe; failures (product_id, error) of products whose requests failed; health: one row; version of the
    store that holds what was fetched; requests: how many were made."""

    products: DataFrame
    source: str
    failures: DataFrame
    health: DataFrame
    version: int
    requests: int


def products(spark: SparkSession, cfg: Settings, base_url: str, transport: rest.Transport = rest.urllib_transport) -> tuple[DataFrame, str]:
    """The universe and where it is from: configured ids, else the live catalog, else the fallback list where the catalog
    cannot be read."""
    if cfg.crypto_universe:
        return written(universe.env_universe(spark, cfg), "universe"), "env"
    plan = spark.range(1).select(F.lit("catalog").alias("key"), F.lit(rest.CATALOG_PATH).alias("path"))
    page = written(rest.request_pages(plan, base_url, rate=cfg.max_rps, inflight=1, transport=transport), "catalog")
    if page.where("error IS NOT NULL").isEmpty():
        return written(universe.live_universe(rest.parse_catalog(page), cfg), "universe"), "live"
    return written(universe.fallback_universe(spark, cfg), "universe"), "fallback"


def paths(plan: DataFrame, granularity: int) -> DataFrame:
    """Requests (key, path) of a fetch plan."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    path = F.concat(F.lit("/products/"), "product_id", F.lit(f"/candles?granularity={granularity}&start="), text("from_ts"), F.lit("&end="), text("to_ts"))
    return plan.select(F.col("product_id").alias("key"), path.alias("path"))


def candles_of(pages: DataFrame, granularity: int, seq: int) -> DataFrame:
    """Candles of pages; seq tells which of equal bars is newer."""
    rows = pages.where("payload IS NOT NULL").select(F.col("key").alias("product_id"), F.lit(granularity).alias("granularity_sec"), "payload", F.lit(seq).cast("long").alias("ingest_seq"))
    return parse_wire(rows).select("product_id", "granularity_sec", "ts_start", *OHLCV, "ingest_seq")


def ingest(spark: SparkSession, cfg: Settings, store: Store, base_url: str, end: dt.datetime, *, hours: float = scans.LOOKBACK_HOURS, granularity: int = 300, only: DataFrame | None = None, transport: rest.Transport = rest.urllib_transport) -> Ingested:
    """Fetch what the store lacks of the last hours before end (UTC), for the universe and the benchmark, and merge it.
    only: a table (id) of products instead of the universe.

    Products whose requests fail keep what the store has; the failed ranges are asked again by the next call, as far
    as they lie at the ends of what is stored."""
    own, source = (only, "given") if only is not None else products(spark, cfg, base_url, transport)
    asked = own.select("id").unionByName(spark.range(1).select(F.lit(cfg.benchmark_symbol).alias("id"))).distinct()
    stamp = lambda t: F.lit(t.replace(tzinfo=None)).cast("timestamp_ntz")
    start = end - dt.timedelta(hours=hours)
    plan = fetch_plan(asked, store.read(), granularity, stamp(start), stamp(end))
    pages = written(rest.request_pages(paths(plan, granularity), base_url, rate=cfg.max_rps, inflight=cfg.max_inflight, transport=transport), "pages")
    version = store.merge(candles_of(pages, granularity, int(time.time() * 1000)))
    health = rest.health(pages)
    failures = rest.failures(pages).groupBy("product_id").agg(F.min("error").alias("error"))
    return Ingested(own, source, failures, health, version, health.first()["requests"])


def ingest_and_scan(spark: SparkSession, cfg: Settings, store: Store, base_url: str, root: str, now: dt.datetime, *, models: dict | None = None, profile: DataFrame | None = None, transport: rest.Transport = rest.urllib_transport) -> scans.Scan:
    """From the catalog to the published scan: what a tick of the schedule runs."""
    got = ingest(spark, cfg, store, base_url, now, transport=transport)
    held = store.read(got.version).where(F.col("granularity_sec") == 300) if got.version else store.read()
    at = F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz")
    result = scans.scan(got.products, held, cfg, at, profile=profile, models=models, failures=got.failures)
    scans.publish(result, root, now.isoformat())
    return result


def auto_train(spark: SparkSession, cfg: Settings, store: Store, base_url: str, root: str, now: dt.datetime, *, allowed: bool = True, transport: rest.Transport = rest.urllib_transport) -> dict | None:
    """Train the models below root if one is missing and the last attempt is long enough ago, on the first products of the universe
    and the candles of both widths that this takes; returns retrain's status and report, None if nothing was due.

    The attempt is noted before it begins, so one that dies is not repeated at once."""
    present = scans.model_view(scans.load_models(spark, root))["using"] == scans.MODEL
    last = (snapshots.load_document(spark, f"{root}/auto_training") or {}).get("attempted_at")
    minutes = (now - dt.datetime.fromisoformat(last)).total_seconds() / 60 if last else None
    if not training.should_auto_train(cfg, allowed=allowed, models_present=present, minutes_since_last=minutes):
        return None
    snapshots.publish_document(spark, {"attempted_at": now.isoformat()}, f"{root}/auto_training")
    own, _ = products(spark, cfg, base_url, transport)
    chosen = written(training.training_products(own, cfg, auto=True).withColumnRenamed("product_id", "id"), "chosen")
    hours = 24 * (cfg.auto_train_lookback_days + 2)
    for granularity in (300, 60):
        ingest(spark, cfg, store, base_url, now, hours=hours, granularity=granularity, only=chosen, transport=transport)
    held = [store.read().where(F.col("granularity_sec") == g).drop("day") for g in (300, 60)]
    return scans.retrain(own, *held, cfg, F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz"), root, auto=True)


def serve(spark: SparkSession, cfg: Settings, store: Store, base_url: str, root: str, checkpoint: str, *, transport: rest.Transport = rest.urllib_transport) -> StreamingQuery:
    """The whole schedule: at once and on every tick, train if it is due, fetch, scan with the models that are there, publish.
    A tick that fails leaves its error in the document scan_status."""

    def once() -> None:
        now = dt.datetime.now(dt.UTC)
        auto_train(spark, cfg, store, base_url, root, now, transport=transport)
        ingest_and_scan(spark, cfg, store, base_url, root, now, models=scans.load_models(spark, root), transport=transport)

    return on_ticks(spark, once, checkpoint, minutes=cfg.scan_interval_minutes, status=f"{root}/scan_status")


def ingest_stream(spark: SparkSession, products: list[str], store_path: str, checkpoint: str, base_url: str, *, granularity: int = 300, start: int = 0, interval: str | None = "5 minutes", **options) -> StreamingQuery:
    """A stream of REST pages into the store, each batch once. options: those of the source. interval None: one batch, then end."""
    import json

    spark.dataSource.register(rest.CandleSource)
    given = {"base_url": base_url, "products": json.dumps(products), "granularity": granularity, "start": start, "progress": f"{checkpoint}/progress.json", **options}
    pages = spark.readStream.format(rest.CandleSource.name()).options(**{k: str(v) for k, v in given.items()}).load()

    def step(batch: DataFrame, epoch: int) -> None:
        seq = int(time.time() * 1000)
        Store(batch.sparkSession, store_path).merge(candles_of(written(batch, "pages"), granularity, seq), txn=(checkpoint, epoch))

    out = pages.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(step)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
