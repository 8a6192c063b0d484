"""The 25 indicators of a 5-minute bar, for all products in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import scalar as S
from ..operators.chunks import CHUNK, HALO, with_chunks
from ..operators.windows import backfill, ewm, ewms, lag, median, rolling, series, slope
from ..schemas import FEATURES
from ..sources.candles import completed, keep_last


#: Rows that the latest row depends on: the longest window on top of the averages' memory.
REACH = HALO + 72


def scrub(x: Column, default: float = 0.0) -> Column:
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(F.when(~bad, x), F.lit(default))


def directional(df: DataFrame) -> DataFrame:
    """True range and directional movement."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    tr = F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))
    df = df.withColumns({"tr": tr, "_up": up, "_down": down})
    move = lambda a, b: F.when((F.col(a) > F.col(b)) & (F.col(a) > 0), F.col(a)).otherwise(0.0)
    return df.withColumns({"plus_dm": move("_up", "_down"), "minus_dm": move("_down", "_up")}).drop("_up", "_down")


def trend(df: DataFrame, period: int = 14, more: tuple[tuple[str, str, float], ...] = ()) -> DataFrame:
    """Average true range and directional index; more: other means that share the first pass."""
    df = ewms(directional(df), [("tr", "atr", 1 / period), ("plus_dm", "_pdm", 1 / period), ("minus_dm", "_mdm", 1 / period), *more])
    df = df.withColumns({"_pdi": 100 * S.ratio(F.col("_pdm"), F.col("atr")), "_mdi": 100 * S.ratio(F.col("_mdm"), F.col("atr"))})
    dx = 100 * F.abs(F.col("_pdi") - F.col("_mdi")) / (F.col("_pdi") + F.col("_mdi") + S.EPS)
    return ewm(df.withColumn("_dx", F.coalesce(dx, F.lit(0.0))), {"_dx": "adx"}, 1 / period).drop("_pdm", "_mdm", "_pdi", "_mdi", "_dx")


def slot_volumes(bars: DataFrame) -> DataFrame:
    """(product_id, slot, volume, day) of completed bars: what a profile is made of. A bar that ends at midnight is the next day's."""
    return bars.select("product_id", S.slot_5m(F.col("ts_end")).alias("slot"), "volume", F.to_date("ts_end").alias("day"))


def profile_of(volumes: DataFrame, products: DataFrame, cfg: Settings, today: Column) -> DataFrame:
    """volume_profile from slot volumes; products (product_id): all that get a row."""
    prior = volumes.where(F.col("day") < today)
    days = prior.select("product_id", "day").distinct()
    recent = days.withColumn("_n", F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("day").desc()))).where(F.col("_n") <= cfg.tod_rvol_lookback_days)
    counts = recent.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_days"))
    enough = counts.where(F.col("n_days") >= cfg.tod_rvol_min_days)
    used = prior.join(recent.select("product_id", "day"), ["product_id", "day"], "left_semi").join(enough, "product_id")
    good = used.groupBy("product_id", "slot").agg(F.median("volume").alias("median_volume"), F.max("n_days").alias("n_days"))
    every = products.select("product_id").distinct().join(counts, "product_id", "left")
    note = F.when(F.col("n_days").isNull(), "insufficient_prior_days").when(F.col("n_days") < cfg.tod_rvol_min_days, F.format_string("insufficient_days(%d)", "n_days"))
    short = every.withColumn("note", note).where("note IS NOT NULL")
    return good.withColumn("note", F.lit("ok")).unionByName(short.select("product_id", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("double").alias("median_volume"), F.coalesce("n_days", F.lit(0)).alias("n_days"), "note"))


def volume_profile(bars: DataFrame, cfg: Settings, as_of: Column) -> DataFrame:
    """(product_id, slot, median_volume, n_days, note): the last completed days' median volume by slot.

    Products without a profile have one row with a null slot and the reason in note."""
    return profile_of(slot_volumes(bars), bars, cfg, F.to_date(as_of))


def profile_array(profile: DataFrame) -> DataFrame:
    """288 medians per product in slot order, missing ones null."""
    held = profile.where("slot IS NOT NULL").groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "median_volume"))).alias("m"), F.max("n_days").alias("n_days"))
    return held.select("product_id", F.transform(F.sequence(F.lit(0), F.lit(287)), lambda k: F.try_element_at("m", k)).alias("slot_median_volume"), "n_days")


def indicators(candles: DataFrame, cfg: Settings, as_of: Column, *, profile: DataFrame | None = None, bench: DataFrame | float | None = None, chunk: int | None = CHUNK) -> DataFrame:
    """Feature rows of 5-minute candles: product_id, ts_end, the 25 columns, and row number i.

    profile: live mode, relative volume by time of day where the product has a profile; without,
    the rolling median before the bar. bench: (ts_end, bench_ret_30m) to join, or one value. chunk: rows of a
    task's series; None where each product has few."""
    bars = completed(keep_last(candles), as_of)
    df = with_chunks(bars, chunk)
    df = trend(df, more=(("close", "_fast", 2 / 13), ("close", "_slow", 2 / 27)))
    c, v = F.col("close"), F.col("volume")
    df = df.withColumns(
        {
            "ret_5m": F.coalesce(F.try_divide(c, lag("close")) - 1, F.lit(0.0)),
            "ret_30m": F.coalesce(F.try_divide(c, lag("close", 6)) - 1, F.lit(0.0)),
            "_log": F.coalesce(F.ln((c + S.EPS) / (lag("close") + S.EPS)), F.lit(0.0)),
            "_pv": rolling(F.sum(c * v), c * v, 24, 6),
            "_vv": rolling(F.sum(v), v, 24, 6),
            "_top": rolling(F.max("high"), F.col("high"), 72, 6),
            "_signed": F.signum(F.coalesce(c - lag("close"), F.lit(0.0))) * v,
            "_dvol": c * v,
            "cur_range_pct": (F.col("high") - F.col("low")) / (c + S.EPS),
        }
    )
    atr = F.col("atr")
    wicks = F.col("high") - F.greatest("open", "close") + F.least("open", "close") - F.col("low")
    df = df.withColumns({"_vwap": F.col("_pv") / (F.col("_vv") + S.EPS), "cur_wick_atr": wicks / (atr + S.EPS), "_obv": F.sum("_signed").over(series().rowsBetween(Window.unboundedPreceding, 0))})
    n = max(3, cfg.liq_rolling_bars)
    df = df.withColumns(
        {
            "rv": rolling(F.stddev_samp("_log"), F.col("_log"), 24, 6),
            "vwap": F.coalesce(backfill(F.col("_vwap")), c),
            "_med_dvol": F.coalesce(rolling(median("_dvol"), F.col("_dvol"), n, 3), F.lit(0.0)),
            "med_range_pct": rolling(median("cur_range_pct"), F.col("cur_range_pct"), n, 3),
            "med_wick_atr": rolling(median("cur_wick_atr"), F.col("cur_wick_atr"), n, 3),
            "_base": rolling(median("volume"), v, n, 3, last=-1),
        }
    )
    df = slope(df, "_obv", 24, "obv_slope").where("core")
    rolled = scrub(S.ratio(v, F.col("_base")), 1.0)
    if profile is None:
        df = df.withColumn("rvol_tod", rolled)
    else:
        base = profile.where("slot IS NOT NULL").select(F.col("product_id").alias("_p"), F.col("slot").alias("_slot"), "median_volume")
        has = profile.groupBy(F.col("product_id").alias("_q")).agg(F.max(F.col("slot").isNotNull()).alias("_has"))
        df = df.join(base, (F.col("product_id") == F.col("_p")) & (S.slot_5m(F.col("ts_end")) == F.col("_slot")), "left")
        df = df.join(has, F.col("product_id") == F.col("_q"), "left")
        df = df.withColumn("rvol_tod", F.when(F.coalesce("_has", F.lit(False)), scrub(S.ratio(v, F.col("median_volume")), 1.0)).otherwise(rolled))
    if isinstance(bench, DataFrame):
        df = df.join(bench.select(F.col("ts_end").alias("_bts"), "bench_ret_30m"), F.col("ts_end") == F.col("_bts"), "left")
        df = df.withColumn("bench_ret_30m", F.coalesce("bench_ret_30m", F.lit(0.0)))
    else:
        df = df.withColumn("bench_ret_30m", F.lit(float(bench or 0.0)))
    h = float(cfg.horizon_minutes)
    left = F.least(S.minutes_to_day_end(F.col("ts_end")), F.lit(h)) if cfg.horizon_mode == "UTC_DAY_END" else F.lit(h)
    df = df.withColumns(
        {
            "price": c,
            "ema_diff_pct": (F.col("_fast") - F.col("_slow")) / (c + S.EPS),
            "atr_pct": atr / (c + S.EPS),
            "vwap_loc": (c - F.col("vwap")) / (atr + S.EPS),
            "donch_dist": (F.col("_top") - c) / (atr + S.EPS),
            "time_remaining_frac": S.clip(left / h, 0.0, 1.0) if cfg.horizon_mode == "UTC_DAY_END" else F.lit(1.0),
            "log_minutes_remaining": F.log1p(left),
            "tod_frac": S.tod_frac(F.col("ts_end")),
            "log1p_med_dvol": F.log1p("_med_dvol"),
        }
    )
    ret = F.col("ret_30m")
    df = df.withColumns({"i_ret30_rvol": ret * (F.col("rvol_tod") - 1), "i_ret30_vwaploc": ret * F.col("vwap_loc"), "i_ema_adx": F.col("ema_diff_pct") * F.col("adx"), "i_ret30_timefrac": ret * F.col("time_remaining_frac")})
    return df.select("product_id", "ts_end", *[scrub(F.col(f)).alias(f) for f in FEATURES], "i")


def benchmark_returns(features: DataFrame, symbol: str) -> DataFrame:
    """(ts_end, bench_ret_30m) of the benchmark, one row per bar."""
    return features.where(F.col("product_id") == symbol).select("ts_end", F.col("ret_30m").alias("bench_ret_30m"))


def with_benchmark(features: DataFrame, bench: DataFrame) -> DataFrame:
    """Left join on ts_end; missing is 0."""
    joined = features.drop("bench_ret_30m").join(bench.select(F.col("ts_end").alias("_b"), "bench_ret_30m"), F.col("ts_end") == F.col("_b"), "left")
    return joined.withColumn("bench_ret_30m", F.coalesce("bench_ret_30m", F.lit(0.0))).drop("_b")


def with_one_benchmark(features: DataFrame, bench: DataFrame) -> DataFrame:
    """bench_ret_30m of the benchmark's latest row for all rows; 0 if it has none."""
    one = bench.agg(F.coalesce(F.max_by("ret_30m", "ts_end"), F.lit(0.0)).alias("bench_ret_30m"))
    return features.drop("bench_ret_30m").crossJoin(F.broadcast(one))  # one row


def last_return(candles: DataFrame, as_of: Column, bars: int = 6) -> DataFrame:
    """(ts_end, ret_30m) of the latest completed bar of one product's few candles; no row without candles."""
    own = Window.partitionBy("product_id").orderBy("ts_start")
    ret = F.coalesce(F.try_divide("close", F.lag("close", bars).over(own)) - 1, F.lit(0.0))
    rows = completed(keep_last(candles), as_of).select("ts_end", ret.alias("ret_30m"))
    return rows.agg(F.max_by(F.struct("ts_end", scrub(F.col("ret_30m")).alias("ret_30m")), "ts_end").alias("r")).where("r IS NOT NULL").select("r.*")


def latest_features(candles: DataFrame, cfg: Settings, as_of: Column, **more) -> DataFrame:
    """last_bars of the indicators, from the last days of each product that hold the rows its windows reach.

    Counts per day say where those days begin, so no window runs over a whole history; what is left of a product
    is REACH rows and the rest of a day, one task's series."""
    bars = completed(keep_last(candles), as_of).withColumn("_day", F.to_date("ts_start"))
    per_day = bars.groupBy("product_id", "_day").agg(F.count(F.lit(1)).alias("n"))
    after = F.sum("n").over(Window.partitionBy("product_id").orderBy(F.col("_day").desc())) - F.col("n")
    cut = per_day.withColumn("after", after).groupBy(F.col("product_id").alias("_p")).agg(F.min(F.when(F.col("after") < REACH, F.col("_day"))).alias("_from"), F.sum("n").alias("n_bars"))
    recent = bars.join(cut, (F.col("product_id") == F.col("_p")) & (F.col("_day") >= F.col("_from"))).select(*candles.columns)
    last = last_bars(indicators(recent, cfg, as_of, chunk=None, **more)).drop("n_bars")
    return last.join(cut.select("_p", "n_bars"), F.col("product_id") == F.col("_p")).drop("_p")


def last_bars(features: DataFrame) -> DataFrame:
    """The latest row per product, by partial aggregates rather than a sort."""
    rest = [c for c in features.columns if c != "product_id"]
    return features.groupBy("product_id").agg(F.max_by(F.struct(*rest), "ts_end").alias("r"), F.count(F.lit(1)).alias("n_bars")).select("product_id", "n_bars", *[F.col(f"r.{c}").alias(c) for c in rest])
