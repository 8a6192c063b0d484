"""One scan: candles of the lookback, live features, models or the heuristic, ranked rows and coverage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..sources import snapshots
from ..sources.tables import written
from . import scoring, training
from .features import indicators, last_bars, last_return, with_one_benchmark

#: Hours of 5-minute bars that a scan reads, of all products and of the benchmark.
LOOKBACK_HOURS, BENCHMARK_HOURS = 48, 12
#: Names and targets of the two models.
MODELS = {"pt1": "3%", "pt2": "5%"}
MODEL, FALLBACK, MISMATCH = "model", "heuristic", "heuristic(schema_mismatch)"


@dataclass(frozen=True)
class Scan:
    """scores in rank order; scanned has a row for each product; models says which model was used and why."""

    scores: DataFrame
    scanned: DataFrame
    skipped: DataFrame
    coverage: DataFrame
    models: dict


def load_models(spark: SparkSession, root: str) -> dict[str, tuple[training.Bundle | None, str]]:
    return {name: training.load_bundle(spark, f"{root}/{name}") for name in MODELS}


def model_view(loaded: dict[str, tuple[training.Bundle | None, str]]) -> dict:
    """What a reader sees of the models: both must be usable, else the heuristic scores."""
    state = {name: loaded.get(name, (None, "missing")) for name in MODELS}
    both = all(bundle is not None for bundle, _ in state.values())
    view = {name: {"ok": bundle is not None, "reason": why, "target": MODELS[name]} for name, (bundle, why) in state.items()}
    return {"using": MODEL if both else FALLBACK, **view, "schema_warning": None if both else "No usable pair of models: the heuristic scores instead."}


def with_probabilities(scanned: DataFrame, loaded: dict[str, tuple[training.Bundle | None, str]]) -> tuple[DataFrame, str]:
    """scanned with prob_1 and prob_2 and their source. Models that lack a feature fall back to the heuristic."""
    if model_view(loaded)["using"] == MODEL:
        scored = scanned.where("scan_status = 'scored'")  # other rows may lack features
        try:
            for name, out in (("pt1", "prob_1"), ("pt2", "prob_2")):
                scored = training.predict(loaded[name][0], scored, out)
        except ValueError as e:
            if "missing_features" not in str(e):
                raise
            return scoring.heuristic(scanned), MISMATCH
        return scored.unionByName(scanned.where("scan_status <> 'scored'"), allowMissingColumns=True), MODEL
    return scoring.heuristic(scanned), FALLBACK


def lookback(candles: DataFrame, scan_time: Column, hours: int) -> DataFrame:
    """Candles of the last hours, and of their days where candles have a day column."""
    since = scan_time - F.expr(f"INTERVAL {hours} HOURS")
    own = candles.where(F.col("ts_start") >= since)
    return own.where(F.col("day") >= F.to_date(since)).drop("day") if "day" in candles.columns else own


def scan(products: DataFrame, candles: DataFrame, cfg: Settings, scan_time: Column, *, profile: DataFrame | None = None, models: dict | None = None, failures: DataFrame | None = None) -> Scan:
    """products (id, quote, status), 5-minute candles -> Scan.

    Only candles of the lookback are read; where candles have a day column, as the store's do, other days are pruned. profile:
    the products' volume profiles; failures: (product_id, error) of products whose candles could not be fetched."""
    own = written(lookback(candles, scan_time, LOOKBACK_HOURS), "lookback")  # read for features, presence and the benchmark
    bench = last_return(lookback(own, scan_time, BENCHMARK_HOURS).where(F.col("product_id") == cfg.benchmark_symbol), scan_time)
    feats = last_bars(indicators(own, cfg, scan_time, profile=profile, chunk=None))  # 576 bars a product at most
    feats = with_one_benchmark(feats, bench)
    scanned, source = with_probabilities(scoring.scan_status(products, feats, cfg, scan_time, own, failures), models or {})
    scanned = written(scanned, "scanned")  # a row for each product, read by four results
    mismatch = source == MISMATCH
    scores = scoring.ranked(scoring.score_rows(scanned, cfg, source))
    return Scan(scores, scanned, scoring.skipped(scanned), scoring.coverage(scanned, mismatch=mismatch), model_view(models or {}))


def publish(result: Scan, root: str, run_at: str) -> None:
    """Scores, coverage, skipped products and a document about the run below root, as one version."""
    tables = {"scores": result.scores, "coverage": result.coverage, "skipped": result.skipped}
    facts = {"last_candle_timestamp": lambda w: scoring.top_candle_time(w["scores"]).first()[0], "rows_count": lambda w: w["scores"].count()}
    snapshots.publish_run(result.scores.sparkSession, tables, {"last_run_utc": run_at, "model": result.models, **facts}, f"{root}/scan")


def retrain(products: DataFrame, candles_5m: DataFrame, candles_1m: DataFrame, cfg: Settings, as_of: Column, root: str, *, auto: bool = False, then: Callable[[], None] | None = None) -> dict:
    """Train both models, save them below root, publish status and report; then: what follows a new model, a scan.

    Whatever fails ends up in the status; what is not about the data is raised again."""
    spark = products.sparkSession
    status = {"running": True, "last_error": None}
    snapshots.publish_document(spark, status, f"{root}/training_status")
    try:
        bundles, report = training.train(candles_5m, candles_1m, cfg, as_of, products=products, auto=auto)
        for name, y in (("pt1", "y1"), ("pt2", "y2")):
            bundles[y].save(f"{root}/{name}")
        snapshots.publish(report.pop("per_product"), f"{root}/training_products")
        snapshots.publish_document(spark, report, f"{root}/training_report")
        status = {"running": False, "last_error": None}
    except Exception as e:
        report, status = {}, {"running": False, "last_error": str(e) or type(e).__name__}
        if not isinstance(e, ValueError):
            snapshots.publish_document(spark, status, f"{root}/training_status")
            raise
    snapshots.publish_document(spark, status, f"{root}/training_status")
    if then and not status["last_error"]:
        then()
    return status | report
