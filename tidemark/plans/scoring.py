"""Risk, heuristic score, scan status, ranking, coverage and the filters of the score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import scalar as S
from .features import last_bars

#: Reasons of products whose candles could not be fetched.
FAILED = ("rate_limited", "other_errors")


def liquidity_risk(df: DataFrame, cfg: Settings) -> DataFrame:
    """risk (OK, CAUTION, HIGH) and its comma-joined reasons."""
    tests = {
        "LOW_LIQ": F.expm1("log1p_med_dvol") < cfg.liq_dvol_min_usd,
        "WIDE_RANGE": F.col("cur_range_pct") > cfg.liq_range_pct_max,
        "WICKY": F.col("cur_wick_atr") > cfg.liq_wick_atr_max,
    }
    n = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests.values()), F.lit(0))
    risk = F.when(n >= 2, "HIGH").when(n == 1, "CAUTION").otherwise("OK")
    return df.withColumns({"risk": risk, "risk_reasons": F.concat_ws(",", *[F.when(t, k) for k, t in tests.items()])})


def heuristic(df: DataFrame) -> DataFrame:
    """prob_1 and prob_2 from a fixed formula over the features."""
    # fixed values: (weight, gain, feature) of the squashed terms
    terms = [
        (5.0, 8.0, F.col("ret_30m")),
        (3.0, 20.0, F.col("ema_diff_pct")),
        (1.5, 1 / 50.0, F.col("adx")),
        (1.5, 1.5, F.col("rvol_tod") - 1),
        (1.0, 0.8, F.col("vwap_loc")),
        (-0.8, 0.7, F.col("donch_dist")),
        (-1.0, 10.0, F.col("atr_pct") + F.col("rv")),
    ]
    s = sum((w * F.tanh(g * x) for w, g, x in terms), F.lit(0.0))
    return df.withColumns({"prob_1": S.clip(S.sigmoid(0.7 * s - 0.9), 0.01, 0.90), "prob_2": S.clip(S.sigmoid(0.6 * s - 1.6), 0.005, 0.75)})


def scan_status(products: DataFrame, features: DataFrame, cfg: Settings, scan_time: Column, candles: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """products with their latest feature row and status; the first matching reason wins.

    A product counts as returned if it has candles at all, even if none is complete. features: all rows, or
    the latest ones with n_bars. failures (product_id, error): what a reader could not fetch comes first."""
    last = (features if "n_bars" in features.columns else last_bars(features)).withColumnRenamed("product_id", "_pid")
    df = products.join(last, F.col("id") == F.col("_pid"), "left")
    if candles is None:
        returned = F.col("_pid").isNotNull()
    else:
        have = candles.select(F.col("product_id").alias("_have")).distinct()
        df = df.join(have, F.col("id") == F.col("_have"), "left")
        returned = F.col("_have").isNotNull()
    stale = S.minutes_between(F.col("ts_end"), scan_time) > cfg.max_candle_staleness_minutes
    if failures is None:
        df = df.withColumn("_error", F.lit(None).cast("string"))
    else:
        errors = failures.where("error IS NOT NULL").groupBy(F.col("product_id").alias("_failed")).agg(F.min("error").alias("_error"))
        df = df.join(errors, F.col("id") == F.col("_failed"), "left").drop("_failed")
    kind = F.when(F.contains("_error", F.lit("http_429")), FAILED[0]).otherwise(FAILED[1])
    status = (
        F.when(F.col("_error").isNotNull(), kind)
        .when(~returned, "no_candles")
        .when(F.coalesce("n_bars", F.lit(0)) < cfg.min_bars_5m, "insufficient_candles")
        .when(stale, "stale_candles")
        .when((F.col("price") <= 0) | (F.col("vwap") <= 0), "missing_price_or_vwap")
        .otherwise("scored")
    )
    detail = F.when(F.col("_error").isNotNull(), F.concat(kind, F.lit(":"), F.substring_index("_error", ":", 1)))
    return df.withColumns({"scan_status": status, "skip_detail": F.coalesce(detail, status)}).drop("_pid", "_have", "_error")


def score_rows(scanned: DataFrame, cfg: Settings, source: str = "heuristic") -> DataFrame:
    """Output rows of the stale and scored products. ``scanned`` may bring prob_1 and prob_2 of a model."""
    df = liquidity_risk(scanned, cfg)
    if "prob_1" not in scanned.columns:
        df = heuristic(df)
    ok = F.col("scan_status") == "scored"
    df = df.where(F.col("scan_status").isin("scored", "stale_candles"))
    reason = F.when(ok, F.col("risk_reasons")).otherwise(F.lit("stale_candles"))
    return df.select(
        F.col("id").alias("product"),
        F.replace("id", F.lit("-"), F.lit("/")).alias("display_symbol"),
        "price",
        "vwap",
        F.when(ok, F.col("risk")).otherwise(F.lit("N/A")).alias("risk"),
        reason.alias("risk_reasons"),
        F.when(ok, F.col("prob_1")).alias("prob_1"),
        F.when(ok, F.col("prob_2")).alias("prob_2"),
        F.when(ok, F.lit(source)).otherwise(F.lit("skipped")).alias("prob_1_source"),
        F.when(ok, F.lit(source)).otherwise(F.lit("skipped")).alias("prob_2_source"),
        F.coalesce("quote", F.lit("")).alias("quote"),
        F.coalesce("status", F.lit("spot")).alias("category"),
        reason.alias("reasons"),
        S.iso_utc(F.col("ts_end")).alias("last_candle_time"),
        ok.alias("included"),
        F.when(~ok, F.lit("stale_candles")).alias("skip_reason"),
    )


def ranked(scores: DataFrame) -> DataFrame:
    """Best prob_2, then prob_1, then product; missing probabilities last."""
    return scores.orderBy(F.coalesce("prob_2", F.lit(-1.0)).desc(), F.coalesce("prob_1", F.lit(-1.0)).desc(), "product")


def top_candle_time(scores: DataFrame) -> DataFrame:
    """The candle time of the best-ranked row that has one."""
    order = F.struct(-F.coalesce("prob_2", F.lit(-1.0)), -F.coalesce("prob_1", F.lit(-1.0)), F.col("product"))
    return scores.where("last_candle_time IS NOT NULL").agg(F.min_by("last_candle_time", order).alias("last_candle_timestamp"))


def skipped(scanned: DataFrame) -> DataFrame:
    """(product, reason, last_candle) of every product that was not scored."""
    known = ~F.col("scan_status").isin("no_candles", *FAILED)
    return scanned.where("scan_status <> 'scored'").select(F.col("id").alias("product"), F.col("skip_detail").alias("reason"), F.when(known, S.iso_utc(F.col("ts_end"))).alias("last_candle"))


def skip_histogram(scanned: DataFrame) -> DataFrame:
    return scanned.where("scan_status <> 'scored'").groupBy(F.col("scan_status").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason")


def coverage(scanned: DataFrame, *, mismatch: bool = False) -> DataFrame:
    """One row of counts along the funnel, in one pass, and the skip reasons as a map.

    mismatch: models were there but did not fit, which counts for every product scored without them."""
    s = F.col("scan_status")
    one = scanned.groupBy(s).agg(F.count(F.lit(1)).alias("n"))  # at most seven rows from here on
    reason = F.when(s != "scored", s).when(F.lit(mismatch), "model_schema_incompatible")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return one.agg(
        total(F.lit(True)).alias("universe_count"),
        total(F.lit(True)).alias("products_requested_count"),
        total(~s.isin("no_candles", *FAILED)).alias("products_returned_with_candles_count"),
        total(~s.isin("no_candles", "insufficient_candles", *FAILED)).alias("products_with_sufficient_candles_count"),
        total(s == "scored").alias("products_scored_count"),
        F.map_from_entries(F.collect_list(F.when(reason.isNotNull(), F.struct(reason, "n")))).alias("top_skip_reasons"),
    )


def filter_scores(scores: DataFrame, *, include_stale: bool = True, quotes: list[str] | None = None, risks: list[str] | None = None, price_min: float | None = None, price_max: float | None = None, prob_2_min: float | None = None) -> DataFrame:
    """The score table's filters; a missing price counts as 0, a missing probability as -1."""
    out = scores
    if not include_stale:
        out = out.where("included")
    if quotes:
        out = out.where(F.col("quote").isin(*quotes))
    if risks:
        out = out.where(F.col("risk").isin(*risks))
    price = F.coalesce("price", F.lit(0.0))
    if price_min is not None:
        out = out.where(price >= price_min)
    if price_max is not None:
        out = out.where(price <= price_max)
    if prob_2_min is not None:
        out = out.where(F.coalesce("prob_2", F.lit(-1.0)) >= prob_2_min)
    return out


def sort_scores(scores: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """By a numeric column (missing lowest), ties by symbol; text columns sort by symbol alone."""
    kind = dict(scores.dtypes).get(column)
    if kind not in ("double", "int", "bigint", "float"):
        return scores.orderBy("display_symbol")
    x = F.coalesce(F.col(column).cast("double"), F.lit(float("-inf")))
    return scores.orderBy(x.desc() if descending else x.asc(), "display_symbol")


def quotes(scores: DataFrame) -> DataFrame:
    return scores.where("quote <> ''").select("quote").distinct().orderBy("quote")
