"""One query per operator of the candle engine over the driver's tables, with DuckDB SQL.

Times are compared as text and doubles at six decimals (adding 0.0 drops the sign of zero)."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Settings
from .functions import scalar as S
from .plans import features as P
from .plans import labels as L
from .plans import scan as N
from .plans import scoring as R
from .plans import training as T
from .plans import universe as U
from .plans.profiles import ProfileStore
from .schemas import CANDLES, FEATURES
from .sources import candles as C
from .sources.tables import shared_folder, written
from .sources.versions import Store
from .streaming.benchmark import with_live_benchmark
from .streaming.features import running_features, state_settings
from .streaming.indicators import running_indicators

AS_OF_TEXT = "2024-01-31 00:00:00"
FIXTURE = Settings(liq_dvol_min_usd=5000.0, benchmark_symbol="view")
SCAN = Settings(liq_dvol_min_usd=5000.0, benchmark_symbol="view", max_candle_staleness_minutes=24 * 60)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: str):
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(c)


def show(df: DataFrame) -> DataFrame:
    """Doubles rounded, timestamps as text."""
    return df.select(*[r6(n) if t == "double" else F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in df.dtypes])


def d6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def t19(name: str, alias: str | None = None) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {alias or name}"


def candles(spark: SparkSession, sf: str, seconds: int) -> DataFrame:
    return C.resample(C.events_as_trades(spark, sf), seconds)


def features(spark: SparkSession, sf: str, cfg: Settings = FIXTURE, **more) -> DataFrame:
    return P.indicators(candles(spark, sf, 300), cfg, ntz(AS_OF_TEXT), **more)


# ---- SQL building blocks -------------------------------------------------------------------


def sql_candles(name: str, seconds: int) -> str:
    return f"""{name} AS (
  SELECT event_type AS product_id, time_bucket(INTERVAL {seconds} SECONDS, ts) AS ts_start,
    first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close,
    sum(volume) AS volume, max(event_id) AS ingest_seq
  FROM (SELECT *, 100 + 0.015 * value AS price, 1 + CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS volume FROM events)
  GROUP BY 1, 2)"""


def sql_ewm(x: str, a: str) -> str:
    return f"list_reduce(list({x}) OVER (w ROWS BETWEEN 640 PRECEDING AND CURRENT ROW), lambda y, v: y * (1 - {a}) + {a} * v)"


W = "WINDOW w AS (PARTITION BY product_id ORDER BY ts_start)"


def roll(agg: str, n: int, least: int, counted: str, end: str = "CURRENT ROW") -> str:
    frame = f"(w ROWS BETWEEN {n - 1 if end == 'CURRENT ROW' else n} PRECEDING AND {end})"
    return f"CASE WHEN count({counted}) OVER {frame} >= {least} THEN {agg} OVER {frame} END"


def sql_features(mode: str = "training", horizon: str = "FIXED", cfg: Settings = FIXTURE) -> str:
    """CTEs up to ``f`` (the scrubbed feature rows)."""
    rvol = "volume / (base + 1e-12)"
    profile = ""
    if mode == "live":
        profile = f"""{SQL_PROFILE},
has AS (SELECT product_id, max(CASE WHEN slot IS NOT NULL THEN 1 ELSE 0 END) AS h FROM prof GROUP BY 1),
"""
        rvol = "CASE WHEN coalesce(h, 0) = 1 THEN volume / (median_volume + 1e-12) ELSE volume / (base + 1e-12) END"
    joins = "LEFT JOIN has USING (product_id) LEFT JOIN (SELECT product_id, slot, median_volume FROM prof) q USING (product_id, slot)" if mode == "live" else ""
    left = f"least(greatest(0.0, epoch(date_trunc('day', ts_end) + INTERVAL '23:59' HOUR TO MINUTE - ts_end) / 60.0), {cfg.horizon_minutes}.0)" if horizon != "FIXED" else f"{cfg.horizon_minutes}.0"
    left = left.replace("INTERVAL '23:59' HOUR TO MINUTE", "INTERVAL 1439 MINUTES")
    return f"""{sql_candles("c5", 300)},
{profile}k0 AS (SELECT *, ts_start + INTERVAL 5 MINUTES AS ts_end FROM c5 WHERE ts_start + INTERVAL 5 MINUTES <= TIMESTAMP '{AS_OF_TEXT}'),
k1 AS (SELECT *, row_number() OVER w - 1 AS i, lag(close) OVER w AS pc, lag(close, 6) OVER w AS pc6, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM k0 {W}),
k2 AS (SELECT *, greatest(abs(high - low), abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus_dm,
    coalesce(ln((close + 1e-12) / (pc + 1e-12)), 0) AS lr, sign(coalesce(close - pc, 0)) * volume AS signed, close * volume AS dvol, (high - low) / (close + 1e-12) AS cur_range_pct FROM k1),
k3 AS (SELECT *, {sql_ewm("tr", "(1.0/14)")} AS atr, {sql_ewm("plus_dm", "(1.0/14)")} AS pdm, {sql_ewm("minus_dm", "(1.0/14)")} AS mdm,
    {sql_ewm("close", "(2.0/13)")} AS fast, {sql_ewm("close", "(2.0/27)")} AS slow, sum(signed) OVER (w ROWS UNBOUNDED PRECEDING) AS obv FROM k2 {W}),
k4 AS (SELECT *, coalesce(100 * abs(100 * pdm / (atr + 1e-12) - 100 * mdm / (atr + 1e-12)) / (100 * pdm / (atr + 1e-12) + 100 * mdm / (atr + 1e-12) + 1e-12), 0) AS dx,
    (high - greatest(open, close) + least(open, close) - low) / (atr + 1e-12) AS cur_wick_atr,
    {roll("sum(close * volume)", 24, 6, "close")} / ({roll("sum(volume)", 24, 6, "close")} + 1e-12) AS vw,
    {roll("max(high)", 72, 6, "high")} AS top, {roll("stddev_samp(lr)", 24, 6, "lr")} AS rv0, {roll("median(dvol)", 12, 3, "dvol")} AS med_dvol,
    {roll("median(cur_range_pct)", 12, 3, "cur_range_pct")} AS mr, {roll("median(volume)", 12, 3, "volume", "1 PRECEDING")} AS base,
    {roll("regr_slope(obv, i)", 24, 24, "obv")} AS sl FROM k3 {W}),
k5 AS (SELECT *, {sql_ewm("dx", "(1.0/14)")} AS adx, {roll("median(cur_wick_atr)", 12, 3, "cur_wick_atr")} AS mw,
    coalesce(first_value(vw IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), close) AS vwap FROM k4 {W}),
k6 AS (SELECT *, CAST(floor((hour(ts_end) * 60 + minute(ts_end)) / 5) AS INTEGER) AS slot, {left} AS mins FROM k5),
f AS (SELECT product_id, ts_end, i, close AS price, vwap, coalesce(close / pc - 1, 0) AS ret_5m, coalesce(close / pc6 - 1, 0) AS ret_30m, 0.0 AS bench_ret_30m,
    (fast - slow) / (close + 1e-12) AS ema_diff_pct, adx, atr / (close + 1e-12) AS atr_pct, coalesce(rv0, 0) AS rv, coalesce({rvol}, 1.0) AS rvol_tod, coalesce(sl, 0) AS obv_slope,
    (close - vwap) / (atr + 1e-12) AS vwap_loc, coalesce((top - close) / (atr + 1e-12), 0) AS donch_dist, {"mins / " + str(cfg.horizon_minutes) + ".0" if horizon != "FIXED" else "1.0"} AS time_remaining_frac,
    ln(1 + mins) AS log_minutes_remaining, (hour(ts_end) * 60 + minute(ts_end)) / 1440.0 AS tod_frac, ln(1 + coalesce(med_dvol, 0)) AS log1p_med_dvol, coalesce(mr, 0) AS med_range_pct, cur_range_pct,
    coalesce(mw, 0) AS med_wick_atr, cur_wick_atr, ret_30m * (rvol_tod - 1) AS i_ret30_rvol, ret_30m * vwap_loc AS i_ret30_vwaploc, ema_diff_pct * adx AS i_ema_adx, ret_30m * time_remaining_frac AS i_ret30_timefrac
  FROM k6 {joins})"""


SQL_PROFILE = f"""pk AS (SELECT *, ts_start + INTERVAL 5 MINUTES AS ts_end FROM c5 WHERE ts_start + INTERVAL 5 MINUTES <= TIMESTAMP '{AS_OF_TEXT}'),
pp AS (SELECT *, CAST(ts_end AS DATE) AS day, dense_rank() OVER (PARTITION BY product_id ORDER BY CAST(ts_end AS DATE) DESC) AS dr FROM pk WHERE CAST(ts_end AS DATE) < DATE '2024-01-31'),
pd AS (SELECT product_id, count(DISTINCT day) AS n_days FROM pp WHERE dr <= 20 GROUP BY 1),
prof AS (SELECT product_id, CAST(floor((hour(ts_end) * 60 + minute(ts_end)) / 5) AS INTEGER) AS slot, median(volume) AS median_volume, max(n_days) AS n_days, 'ok' AS note
  FROM pp JOIN pd USING (product_id) WHERE dr <= 20 AND n_days >= 8 GROUP BY 1, 2
  UNION ALL SELECT product_id, NULL, NULL, coalesce(n_days, 0), CASE WHEN n_days IS NULL THEN 'insufficient_prior_days' ELSE 'insufficient_days(' || n_days || ')' END
  FROM (SELECT DISTINCT product_id FROM pk) LEFT JOIN pd USING (product_id) WHERE n_days IS NULL OR n_days < 8)"""


# ---- sources -------------------------------------------------------------------------------

for _name, _s in (("candles_5m", 300), ("candles_1m", 60)):
    query(_name, f"WITH {sql_candles('c', _s)} SELECT product_id, CAST({_s} AS INTEGER) AS granularity_sec, {t19('ts_start')}, {d6('open', 'high', 'low', 'close', 'volume')}, ingest_seq FROM c")(
        lambda spark, sf, s=_s: show(candles(spark, sf, s))
    )


@query("candle_parse_reject", """SELECT n_nationkey AS k, strftime(make_timestamp(CAST(1704067200 + n_nationkey * 60 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts_start,
  3.0 AS open, 2.0 AS high, 1.0 AS low, 4.0 AS close, n_nationkey + 0.5 AS volume FROM nation WHERE n_nationkey % 6 IN (0, 1)""")
def _parse(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    row = lambda tail: F.concat(F.lit("["), (1704067200 + F.col("k") * 60).cast("string"), F.lit(", 1, 2, 3, 4, "), F.col("k").cast("string"), F.lit(tail))
    case = F.col("k") % 6
    body = (
        F.when(case == 0, row(".5]"))
        .when(case == 1, row('.5, "more", 9]'))
        .when(case == 2, F.lit("[1, 2, 3, 4, 5]"))
        .when(case == 3, F.lit('["x", 1, 2, 3, 4, 5]'))
        .when(case == 4, F.lit('{"time": 1}'))
        .otherwise(F.lit('[1, 2, 3, 4, 5, "NaN"]'))
    )
    out = C.parse_wire(n.withColumn("payload", F.concat(F.lit("["), body, F.lit("]"))))
    return show(out.select("k", "ts_start", "open", "high", "low", "close", "volume"))


@query("dedupe_keep_last", f"""WITH x AS (SELECT event_type AS product_id, date_trunc('hour', ts) AS ts_start, event_id AS ingest_seq, value AS close,
  row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS n FROM events)
  SELECT product_id, {t19("ts_start")}, ingest_seq, {d6("close")} FROM x WHERE n = 1""")
def _dedupe(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(F.col("event_type").alias("product_id"), F.lit(3600).alias("granularity_sec"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts_start"), *[F.col("value").alias(c) for c in C.OHLCV], F.col("event_id").alias("ingest_seq"))
    return show(C.keep_last(rows).select("product_id", "ts_start", "ingest_seq", "close"))


@query("upsert_incremental", f"""WITH {sql_candles("c", 300)}
SELECT product_id, {t19("ts_start")}, round(CASE WHEN ts_start >= TIMESTAMP '2024-01-19' THEN close + 1 ELSE close END, 6) + 0.0 AS close,
  CAST(CASE WHEN ts_start >= TIMESTAMP '2024-01-19' THEN 1 ELSE 0 END AS BIGINT) AS ingest_seq FROM c""")
def _upsert(spark, sf):
    c = candles(spark, sf, 300)
    stored = c.where(F.col("ts_start") < ntz("2024-01-20 00:00:00")).withColumn("ingest_seq", F.lit(0).cast("long"))
    fresh = c.where(F.col("ts_start") >= ntz("2024-01-19 00:00:00")).withColumns({"close": F.col("close") + 1, "ingest_seq": F.lit(1).cast("long")})
    return show(C.upsert(stored, fresh).select("product_id", "ts_start", "close", "ingest_seq"))


@query("chunk_ranges", f"""WITH r AS (SELECT r_regionkey AS k, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * r_regionkey AS s, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * r_regionkey + INTERVAL 2887 MINUTE * (r_regionkey + 1) AS e FROM region),
  x AS (SELECT k, s, e, unnest(range(0, CAST(floor((epoch(e) - epoch(s) - 1) / 90000) AS BIGINT) + 1)) AS n FROM r)
  SELECT k, {t19("s + INTERVAL 90000 SECOND * n", "from_ts")}, {t19("least(e, s + INTERVAL 90000 SECOND * (n + 1))", "to_ts")} FROM x""")
def _chunks(spark, sf):
    r = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("k"))
    s = ntz("2024-01-01 00:00:00") + F.make_dt_interval(days=F.col("k"))
    return show(C.chunk_ranges(r.withColumn("s", s).withColumn("e", F.col("s") + F.make_dt_interval(mins=2887 * (F.col("k") + 1))), "s", "e", 300))


@query("completed_bars", f"WITH {sql_candles('c', 300)} SELECT product_id, {t19('ts_start + INTERVAL 5 MINUTES', 'ts_end')}, {d6('close')} FROM c WHERE ts_start + INTERVAL 5 MINUTES <= TIMESTAMP '2024-01-15 12:03:00'")
def _completed(spark, sf):
    return show(C.completed(candles(spark, sf, 300), ntz("2024-01-15 12:03:00")).select("product_id", "ts_end", "close"))


# ---- windows and features ------------------------------------------------------------------

_COLUMNS = {
    "ret_5m": ["ret_5m"], "ret_30m": ["ret_30m"], "ema_diff_pct": ["ema_diff_pct"], "atr_pct": ["atr_pct"], "adx": ["adx"], "realized_vol": ["rv"],
    "rolling_vwap": ["vwap"], "vwap_loc": ["vwap_loc"], "donchian_dist": ["donch_dist"], "obv_slope": ["obv_slope"], "med_dollar_volume": ["log1p_med_dvol"],
    "range_pct": ["med_range_pct", "cur_range_pct"], "wickiness": ["med_wick_atr", "cur_wick_atr"], "rvol_rolling": ["rvol_tod"],
    "interaction_features": ["i_ret30_rvol", "i_ret30_vwaploc", "i_ema_adx", "i_ret30_timefrac"], "features_full": FEATURES,
}
for _name, _cols in _COLUMNS.items():
    query(_name, f"WITH {sql_features()} SELECT product_id, {t19('ts_end')}, {d6(*_cols)} FROM f")(
        lambda spark, sf, c=_cols: show(features(spark, sf).select("product_id", "ts_end", *c))
    )


@query("log_return", f"WITH {sql_features()} SELECT product_id, {t19('ts_end')}, {d6('lr')} FROM k2")
def _log_return(spark, sf):
    from .operators.chunks import with_chunks
    from .operators.windows import lag

    bars = with_chunks(C.completed(candles(spark, sf, 300), ntz(AS_OF_TEXT)))
    lr = F.coalesce(F.ln((F.col("close") + S.EPS) / (lag("close") + S.EPS)), F.lit(0.0))
    return show(bars.withColumn("lr", lr).where("core").select("product_id", "ts_end", "lr"))


@query("true_range", f"WITH {sql_features()} SELECT product_id, {t19('ts_end')}, {d6('tr')} FROM k2")
def _tr(spark, sf):
    return show(_directional(spark, sf).select("product_id", "ts_end", "tr"))


@query("dm_plus_minus", f"WITH {sql_features()} SELECT product_id, {t19('ts_end')}, {d6('plus_dm', 'minus_dm')} FROM k2")
def _dm(spark, sf):
    return show(_directional(spark, sf).select("product_id", "ts_end", "plus_dm", "minus_dm"))


def _directional(spark, sf):
    from .operators.chunks import with_chunks

    return P.directional(with_chunks(C.completed(candles(spark, sf, 300), ntz(AS_OF_TEXT)))).where("core")


@query("obv", f"WITH {sql_features()} SELECT product_id, {t19('ts_end')}, {d6('obv')} FROM k3")
def _obv(spark, sf):
    """The whole cumulative volume: sums per chunk give each chunk's start."""
    from pyspark.sql import Window

    from .operators.chunks import with_chunks
    from .operators.windows import lag, series

    bars = with_chunks(C.completed(candles(spark, sf, 300), ntz(AS_OF_TEXT)), chunk=1024)
    bars = bars.withColumn("signed", F.signum(F.coalesce(F.col("close") - lag("close"), F.lit(0.0))) * F.col("volume")).where("core")
    own = bars.withColumn("run", F.sum("signed").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    ends = bars.groupBy("product_id", "chunk").agg(F.sum("signed").alias("s"))
    start = F.sum("s").over(Window.partitionBy("product_id").orderBy("chunk")) - F.col("s")
    ends = ends.select(F.col("product_id").alias("_p"), F.col("chunk").alias("_c"), start.alias("_s"))
    out = own.join(ends, (F.col("product_id") == F.col("_p")) & (F.col("chunk") == F.col("_c")))
    return show(out.withColumn("obv", F.col("run") + F.col("_s")).select("product_id", "ts_end", "obv"))


@query("volume_profile", f"WITH {sql_candles('c5', 300)}, {SQL_PROFILE} SELECT product_id, slot, {d6('median_volume')}, n_days, note FROM prof")
def _profile(spark, sf):
    return show(_bars_profile(spark, sf))


def _bars_profile(spark, sf, cfg=FIXTURE):
    return P.volume_profile(C.completed(candles(spark, sf, 300), ntz(AS_OF_TEXT)), cfg, ntz(AS_OF_TEXT))


@query("profile_incremental", f"WITH {sql_candles('c5', 300)}, {SQL_PROFILE} SELECT product_id, slot, {d6('median_volume')}, n_days, note FROM prof")
def _profile_incremental(spark, sf):
    """The profile after 26 days at once and four more, one by one."""
    store = Store(spark, f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}")
    store.merge(candles(spark, sf, 300))
    kept = ProfileStore(spark, f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}")
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    kept.add(store.read(), FIXTURE, day(0), day(25))
    for k in range(26, 30):
        kept.add(store.read(), FIXTURE, day(k))
    return show(kept.profile(FIXTURE, day(30), store.read().select("product_id").distinct()))


@query("profile_status", f"""WITH {sql_candles("c5", 300)},
x AS (SELECT product_id, count(DISTINCT CAST(ts_start + INTERVAL 5 MINUTES AS DATE)) AS n FROM c5 WHERE ts_start + INTERVAL 5 MINUTES < TIMESTAMP '2024-01-07'
  AND (product_id <> 'click' OR ts_start >= TIMESTAMP '2024-01-05') GROUP BY 1)
SELECT product_id, 'insufficient_days(' || n || ')' AS note, n AS n_days FROM x""")
def _profile_status(spark, sf):
    at = ntz("2024-01-07 00:00:00")
    c = candles(spark, sf, 300).where((F.col("product_id") != "click") | (F.col("ts_start") >= ntz("2024-01-05 00:00:00")))
    return P.volume_profile(C.completed(c, at), FIXTURE, at).select("product_id", "note", "n_days").distinct()


@query("rvol_profile", f"WITH {sql_features('live')} SELECT product_id, {t19('ts_end')}, {d6('rvol_tod', 'i_ret30_rvol')} FROM f")
def _rvol_profile(spark, sf):
    return show(features(spark, sf, profile=_bars_profile(spark, sf)).select("product_id", "ts_end", "rvol_tod", "i_ret30_rvol"))


@query("profile_array", f"WITH {sql_candles('c5', 300)}, {SQL_PROFILE} SELECT product_id, CAST(288 AS INTEGER) AS slots, count(slot) AS filled, round(sum(median_volume * (slot + 1)), 6) + 0.0 AS checksum FROM prof WHERE slot IS NOT NULL GROUP BY 1")
def _profile_array(spark, sf):
    a = P.profile_array(_bars_profile(spark, sf))
    weighted = F.aggregate(F.transform("slot_median_volume", lambda v, k: F.coalesce(v, F.lit(0.0)) * (k + 1)), F.lit(0.0), lambda x, y: x + y)
    filled = F.size(F.filter("slot_median_volume", lambda v: v.isNotNull())).cast("long")
    return show(a.select("product_id", F.size("slot_median_volume").alias("slots"), filled.alias("filled"), weighted.alias("checksum")))


@query("tod_slot", f"WITH {sql_features()} SELECT product_id, {t19('ts_end')}, slot, round((hour(ts_end) * 60 + minute(ts_end)) / 1440.0, 6) + 0.0 AS tod_frac FROM k6")
def _slot(spark, sf):
    bars = C.completed(candles(spark, sf, 300), ntz(AS_OF_TEXT))
    return show(bars.select("product_id", "ts_end", S.slot_5m(F.col("ts_end")).alias("slot"), S.tod_frac(F.col("ts_end")).alias("tod_frac")))


_DAY_END = Settings(liq_dvol_min_usd=5000.0, horizon_mode="UTC_DAY_END")


@query("time_remaining_day_end", f"WITH {sql_features('training', 'UTC_DAY_END')} SELECT product_id, {t19('ts_end')}, {d6('time_remaining_frac', 'log_minutes_remaining', 'i_ret30_timefrac')} FROM f")
def _day_end(spark, sf):
    return show(features(spark, sf, _DAY_END).select("product_id", "ts_end", "time_remaining_frac", "log_minutes_remaining", "i_ret30_timefrac"))


@query("benchmark_left_join", f"""WITH {sql_features()}, b AS (SELECT ts_end, ret_30m AS br FROM f WHERE product_id = 'view')
SELECT product_id, {t19("f.ts_end", "ts_end")}, round(coalesce(br, 0), 6) + 0.0 AS bench_ret_30m FROM f LEFT JOIN b ON f.ts_end = b.ts_end""")
def _bench_join(spark, sf):
    f = features(spark, sf)
    return show(P.with_benchmark(f.select("product_id", "ts_end", "ret_30m", "bench_ret_30m"), P.benchmark_returns(f, "view")).select("product_id", "ts_end", "bench_ret_30m"))


@query("benchmark_scalar_broadcast", f"""WITH {sql_features()}, b AS (SELECT arg_max(ret_30m, ts_end) AS br FROM f WHERE product_id = 'view'), z AS (SELECT product_id, max(ts_end) AS ts_end FROM f GROUP BY 1)
SELECT product_id, {t19("ts_end")}, round(coalesce(br, 0), 6) + 0.0 AS bench_ret_30m FROM z, b""")
def _bench_scalar(spark, sf):
    f = features(spark, sf).select("product_id", "ts_end", "ret_30m")
    one = f.where("product_id = 'view'").agg(F.coalesce(F.max_by("ret_30m", "ts_end"), F.lit(0.0)).alias("bench_ret_30m"))
    return show(f.groupBy("product_id").agg(F.max("ts_end").alias("ts_end")).crossJoin(F.broadcast(one)))


@query("last_bar_per_product", f"WITH {sql_features()} SELECT product_id, count(*) AS n_bars, {t19('max(ts_end)', 'ts_end')}, round(arg_max(price, ts_end), 6) + 0.0 AS price, round(arg_max(adx, ts_end), 6) + 0.0 AS adx FROM f GROUP BY 1")
def _last(spark, sf):
    return show(P.last_bars(features(spark, sf)).select("product_id", "n_bars", "ts_end", "price", "adx"))


# ---- labels --------------------------------------------------------------------------------

SQL_LABELS = f"""{sql_candles("c1", 60)},
m1 AS (SELECT product_id, ts_start, max(high) OVER (PARTITION BY product_id ORDER BY ts_start ROWS BETWEEN CURRENT ROW AND 239 FOLLOWING) AS h_future FROM c1),
ml AS (SELECT product_id, arg_max(h_future, ts_start) AS h_last FROM m1 GROUP BY 1),
ll AS (SELECT f.*, coalesce(m1.h_future, ml.h_last) AS h_future FROM f ASOF LEFT JOIN m1 ON f.product_id = m1.product_id AND m1.ts_start >= f.ts_end JOIN ml ON ml.product_id = f.product_id),
y AS (SELECT *, CASE WHEN h_future >= 1.03 * price THEN 1 ELSE 0 END AS y1, CASE WHEN h_future >= 1.05 * price THEN 1 ELSE 0 END AS y2 FROM ll)"""


@query("future_max_high", f"WITH {sql_candles('c1', 60)} SELECT product_id, {t19('ts_start')}, round(max(high) OVER (PARTITION BY product_id ORDER BY ts_start ROWS BETWEEN CURRENT ROW AND 239 FOLLOWING), 6) + 0.0 AS h_future FROM c1")
def _future(spark, sf):
    return show(L.future_max(candles(spark, sf, 60), 240).select("product_id", "ts_start", "h_future"))


def _labelled(spark, sf):
    bars = C.completed(candles(spark, sf, 300), ntz(AS_OF_TEXT)).select("product_id", "ts_end", F.col("close").alias("price"))
    return L.labels(bars, candles(spark, sf, 60), 240)


for _name, _col in (("asof_forward", "h_future"), ("labels_3pct", "y1"), ("labels_5pct", "y2")):
    query(_name, f"WITH {sql_features()}, {SQL_LABELS} SELECT product_id, {t19('ts_end')}, {d6(_col) if _col == 'h_future' else _col} FROM y")(
        lambda spark, sf, c=_col: show(_labelled(spark, sf).select("product_id", "ts_end", c))
    )

# ---- universe ------------------------------------------------------------------------------

SQL_UNIVERSE = """p AS (SELECT p_partkey, upper(trim(upper(p_type) || '-' || q)) AS id, CASE WHEN p_partkey % 11 = 0 THEN 'USDT' ELSE upper(trim(p_type)) END AS base, upper(q) AS quote, lower(s) AS status
  FROM (SELECT *, ['USD', 'usdt', 'USDC', 'EUR', ''][p_partkey % 5 + 1] AS q, ['online', 'delisted', '', 'ACTIVE'][p_partkey % 4 + 1] AS s FROM part)),
t AS (SELECT *, base IN ('USDT', 'USDC', 'DAI', 'TUSD', 'USDP', 'GUSD', 'FRAX', 'LUSD', 'EURC', 'BUSD') AS stable FROM p
  WHERE contains(id, '-') AND status IN ('', 'online', 'active') AND quote IN ('', 'USD', 'USDT', 'USDC')),
u AS (SELECT p_partkey, id, base, quote, CASE WHEN status = '' THEN 'spot' ELSE status END AS status FROM t WHERE NOT stable)"""
_CFG = Settings()


@query("universe_filter", f"WITH {SQL_UNIVERSE} SELECT * FROM u")
def _universe(spark, sf):
    return U.live_universe(U.catalog_from_parts(spark, sf), _CFG).select("p_partkey", "id", "base", "quote", "status")


@query("universe_rank_limit", f"""WITH {SQL_UNIVERSE},
pl(rank, r_regionkey, id) AS (VALUES (1, 3, 'ETH-USD'), (43, 0, 'DOGE-USDC'), (0, 4, 'BTC-USD'), (29, 1, 'BTC-USDT'), (1000000, 2, 'ZZZ-USD')),
x AS (SELECT p_partkey, id, base, quote, status, 1000000 AS rank FROM u
  UNION ALL SELECT -r_regionkey, id, split_part(id, '-', 1), split_part(id, '-', 2), 'online', rank FROM pl JOIN region USING (r_regionkey))
SELECT p_partkey, id, base, quote, status, CAST(rank AS INTEGER) AS rank FROM x ORDER BY rank, id, base, p_partkey, quote, status LIMIT 25""")
def _universe_rank(spark, sf):
    """The parts' catalog with products of the priority list, one for each region."""
    ids = F.array(*map(F.lit, ("DOGE-USDC", "BTC-USDT", "ZZZ-USD", "ETH-USD", "BTC-USD")))
    r = spark.read.parquet(f"{sf}/region.parquet").select((-F.col("r_regionkey")).alias("p_partkey"), F.get(ids, F.col("r_regionkey").cast("int")).alias("id"))
    more = r.select("p_partkey", "id", F.substring_index("id", "-", 1).alias("base_currency"), F.substring_index("id", "-", -1).alias("quote_currency"), F.lit("online").alias("status"))
    live = U.live_universe(U.catalog_from_parts(spark, sf).unionByName(more), _CFG).orderBy("rank", "id", "base", "p_partkey", "quote", "status").limit(25)
    return live.select("p_partkey", "id", "base", "quote", "status", "rank")


@query("quote_distribution", f"WITH {SQL_UNIVERSE} SELECT quote, count(*) AS n FROM u GROUP BY 1")
def _quotes(spark, sf):
    return U.quote_distribution(U.catalog_from_parts(spark, sf), _CFG)


@query("stable_excluded_count", f"WITH {SQL_UNIVERSE} SELECT count(*) FILTER (NOT stable) AS count, count(*) FILTER (NOT stable) AS full_count, count(*) FILTER (stable) AS excluded_stablecoin_base_count, 'live' AS source FROM t")
def _excluded(spark, sf):
    return U.universe_meta(U.catalog_from_parts(spark, sf), _CFG)


SQL_PART_IDS = """SELECT DISTINCT upper(p_type) || '-' || list_extract(['USD', 'usdt', 'USDC', 'EUR', ''], CAST(p_partkey % 5 + 1 AS BIGINT)) || CASE WHEN p_partkey % 13 = 0 THEN '-X' ELSE '' END AS id FROM part
  UNION SELECT DISTINCT p_type FROM part"""


@query("env_universe_split", f"SELECT id, split_part(id, '-', 1) AS base, split_part(id, '-', 2) AS quote, 'env' AS status FROM ({SQL_PART_IDS}) WHERE contains(id, '-')")
def _env(spark, sf):
    """Ids of the parts as a configured universe: some have a third piece, some no dash."""
    parts = U.catalog_from_parts(spark, sf)
    ids = parts.select(F.concat("id", F.when(F.col("p_partkey") % 13 == 0, "-X").otherwise("")).alias("id"))
    plain = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_type").alias("id"))
    return U.env_universe(spark, _CFG, ids.unionByName(plain).distinct())


@query("fallback_universe", f"""SELECT id, split_part(id, '-', 1) AS base, split_part(id, '-', 2) AS quote, 'fallback' AS status, CAST(list_position({U.PRIORITY}, id) - 1 AS INTEGER) AS rank
  FROM (SELECT DISTINCT list_extract({U.PRIORITY}, CAST(p_partkey * 7 % 60 + 1 AS BIGINT)) AS id FROM part WHERE p_size > 25) WHERE id IS NOT NULL""")
def _fallback(spark, sf):
    """The priority list where the catalog is down, of it the products that the larger parts name."""
    parts = spark.read.parquet(f"{sf}/part.parquet").where("p_size > 25")
    known = parts.select(F.try_element_at(F.array(*map(F.lit, U.PRIORITY)), (F.col("p_partkey") * 7 % 60 + 1).cast("int")).alias("id")).distinct()
    return U.fallback_universe(spark, _CFG, known)


@query("universe_cache_check", "SELECT true AS fresh, true AS truncated, false AS usable")
def _cache(spark, sf):
    live = U.live_universe(U.catalog_from_parts(spark, sf), _CFG).orderBy("id", "p_partkey").limit(5).withColumn("updated_at", ntz("2024-01-30 20:00:00"))
    return U.cache_usable(live, U.quote_distribution(U.catalog_from_parts(spark, sf), _CFG), ntz(AS_OF_TEXT), _CFG)


# ---- scan ----------------------------------------------------------------------------------

_LIVE = "WITH " + sql_features("live") + ","
SQL_RISK = """rk AS (SELECT *, CASE WHEN exp(log1p_med_dvol) - 1 < 5000 THEN 1 ELSE 0 END AS r1, CASE WHEN cur_range_pct > 0.012 THEN 1 ELSE 0 END AS r2, CASE WHEN cur_wick_atr > 0.8 THEN 1 ELSE 0 END AS r3 FROM {src}),
rr AS (SELECT *, CASE WHEN r1 + r2 + r3 >= 2 THEN 'HIGH' WHEN r1 + r2 + r3 = 1 THEN 'CAUTION' ELSE 'OK' END AS risk,
  concat_ws(',', CASE WHEN r1 = 1 THEN 'LOW_LIQ' END, CASE WHEN r2 = 1 THEN 'WIDE_RANGE' END, CASE WHEN r3 = 1 THEN 'WICKY' END) AS risk_reasons FROM rk)"""
SQL_HEUR = """hs AS (SELECT *, 5 * tanh(8 * ret_30m) + 3 * tanh(20 * ema_diff_pct) + 1.5 * tanh(adx / 50) + 1.5 * tanh(1.5 * (rvol_tod - 1)) + tanh(0.8 * vwap_loc) - 0.8 * tanh(0.7 * donch_dist) - tanh(10 * (atr_pct + rv)) AS s FROM {src}),
hh AS (SELECT *, greatest(0.01, least(0.90, 1 / (1 + exp(-(0.7 * s - 0.9))))) AS prob_1, greatest(0.005, least(0.75, 1 / (1 + exp(-(0.6 * s - 1.6))))) AS prob_2 FROM hs)"""


@query("liquidity_risk", f"WITH {sql_features()}, {SQL_RISK.format(src='f')} SELECT product_id, {t19('ts_end')}, risk, risk_reasons FROM rr")
def _risk(spark, sf):
    return show(R.liquidity_risk(features(spark, sf), FIXTURE).select("product_id", "ts_end", "risk", "risk_reasons"))


@query("heuristic_score", f"WITH {sql_features()}, {SQL_HEUR.format(src='f')} SELECT product_id, {t19('ts_end')}, {d6('prob_1', 'prob_2')} FROM hh")
def _heur(spark, sf):
    return show(R.heuristic(features(spark, sf)).select("product_id", "ts_end", "prob_1", "prob_2"))


def _scan_parts(spark, sf):
    """Five products by event type: one stale, one with too few bars, one unknown."""
    c = candles(spark, sf, 300)
    p = F.col("product_id")
    cut = F.when(p == "click", F.col("ts_start") < ntz("2024-01-20 00:00:00")).when(p == "error", F.col("ts_start") < ntz("2024-01-01 02:00:00")).otherwise(True)
    c = written(c.where(cut), "candles")  # a store's stand-in: counts, features and presence read it
    products = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("id")).distinct().unionByName(spark.range(1).select(F.lit("none").alias("id")))
    products = products.select("id", F.lit("USD").alias("quote"), F.lit("online").alias("status"))
    return products, P.latest_features(c, SCAN, ntz(AS_OF_TEXT)), c


def _scanned(spark, sf):
    products, feats, c = _scan_parts(spark, sf)
    return R.scan_status(products, feats, Settings(**{**SCAN.__dict__, "min_bars_5m": 200, "max_candle_staleness_minutes": 24 * 60}), ntz(AS_OF_TEXT), c)


SQL_SCAN = (
    sql_features().replace("GROUP BY 1, 2)", "GROUP BY 1, 2 HAVING CASE product_id WHEN 'click' THEN ts_start < TIMESTAMP '2024-01-20' WHEN 'error' THEN ts_start < TIMESTAMP '2024-01-01 02:00:00' ELSE true END)", 1)
    + """,
lb AS (SELECT f.*, n_bars FROM f JOIN (SELECT product_id, max(ts_end) AS ts_end, count(*) AS n_bars FROM f GROUP BY 1) z USING (product_id, ts_end)),
pr AS (SELECT DISTINCT event_type AS id FROM events UNION ALL SELECT 'none'),
sc AS (SELECT pr.id, lb.*, CASE WHEN lb.product_id IS NULL AND id NOT IN (SELECT DISTINCT product_id FROM c5) THEN 'no_candles' WHEN coalesce(n_bars, 0) < 200 THEN 'insufficient_candles'
  WHEN epoch(TIMESTAMP '2024-01-31') - epoch(ts_end) > 86400 THEN 'stale_candles' WHEN price <= 0 OR vwap <= 0 THEN 'missing_price_or_vwap' ELSE 'scored' END AS scan_status FROM pr LEFT JOIN lb ON pr.id = lb.product_id)"""
)
SQL_ROWS = f"""WITH {SQL_SCAN}, {SQL_RISK.format(src="sc")}, {SQL_HEUR.format(src="rr")},
o AS (SELECT id AS product, replace(id, '-', '/') AS display_symbol, round(price, 6) + 0.0 AS price, round(vwap, 6) + 0.0 AS vwap,
  CASE WHEN scan_status = 'scored' THEN risk ELSE 'N/A' END AS risk, CASE WHEN scan_status = 'scored' THEN risk_reasons ELSE 'stale_candles' END AS risk_reasons,
  CASE WHEN scan_status = 'scored' THEN round(prob_1, 6) + 0.0 END AS prob_1, CASE WHEN scan_status = 'scored' THEN round(prob_2, 6) + 0.0 END AS prob_2,
  CASE WHEN scan_status = 'scored' THEN 'heuristic' ELSE 'skipped' END AS prob_1_source, CASE WHEN scan_status = 'scored' THEN 'heuristic' ELSE 'skipped' END AS prob_2_source,
  'USD' AS quote, 'online' AS category, CASE WHEN scan_status = 'scored' THEN risk_reasons ELSE 'stale_candles' END AS reasons,
  strftime(ts_end, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_candle_time, scan_status = 'scored' AS included, CASE WHEN scan_status <> 'scored' THEN 'stale_candles' END AS skip_reason
  FROM hh WHERE scan_status IN ('scored', 'stale_candles'))"""


@query("scan_status", f"WITH {SQL_SCAN} SELECT id, scan_status, coalesce(n_bars, 0) AS n_bars FROM sc")
def _status(spark, sf):
    return _scanned(spark, sf).select("id", "scan_status", F.coalesce("n_bars", F.lit(0)).alias("n_bars"))


@query("scan_ranked", f"{SQL_ROWS} SELECT * FROM o")
def _ranked(spark, sf):
    return show(R.ranked(R.score_rows(_scanned(spark, sf), SCAN)))


@query("top_candle_time", f"{SQL_ROWS} SELECT last_candle_time AS last_candle_timestamp FROM o ORDER BY coalesce(prob_2, -1) DESC, coalesce(prob_1, -1) DESC, product LIMIT 1")
def _top_time(spark, sf):
    return R.top_candle_time(show(R.score_rows(_scanned(spark, sf), SCAN)))


@query("coverage_funnel", f"""WITH {SQL_SCAN} SELECT count(*) AS universe_count, count(*) AS products_requested_count, count(*) FILTER (scan_status <> 'no_candles') AS products_returned_with_candles_count,
  count(*) FILTER (scan_status NOT IN ('no_candles', 'insufficient_candles')) AS products_with_sufficient_candles_count, count(*) FILTER (scan_status = 'scored') AS products_scored_count FROM sc""")
def _coverage(spark, sf):
    return R.coverage(_scanned(spark, sf)).drop("top_skip_reasons")


@query("skip_histogram", f"WITH {SQL_SCAN} SELECT scan_status AS reason, count(*) AS n FROM sc WHERE scan_status <> 'scored' GROUP BY 1")
def _histogram(spark, sf):
    return R.skip_histogram(_scanned(spark, sf))


@query("skipped_list", f"WITH {SQL_SCAN} SELECT id AS product, scan_status AS reason, CASE WHEN scan_status <> 'no_candles' THEN strftime(ts_end, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS last_candle FROM sc WHERE scan_status <> 'scored'")
def _skipped(spark, sf):
    return R.skipped(_scanned(spark, sf))


@query("score_filter", f"{SQL_ROWS} SELECT product, risk, price, prob_2 FROM o WHERE included AND quote = 'USD' AND coalesce(price, 0) >= 90 AND coalesce(prob_2, -1) >= 0.01")
def _filter(spark, sf):
    rows = show(R.score_rows(_scanned(spark, sf), SCAN))
    return R.filter_scores(rows, include_stale=False, quotes=["USD"], price_min=90.0, prob_2_min=0.01).select("product", "risk", "price", "prob_2")


@query("score_sort", f"{SQL_ROWS} SELECT product, prob_1 FROM o")
def _sort(spark, sf):
    return R.sort_scores(show(R.score_rows(_scanned(spark, sf), SCAN)), "prob_1").select("product", "prob_1")


@query("quote_list", "SELECT 'USD' AS quote")
def _quote_list(spark, sf):
    return R.quotes(R.score_rows(_scanned(spark, sf), SCAN))


def _scan_inputs(spark, sf):
    """Products by event type, one of which could not be fetched, and one without candles."""
    products = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("id")).distinct().unionByName(spark.range(1).select(F.lit("none").alias("id")))
    failures = spark.range(1).select(F.lit("error").alias("product_id"), F.lit("RuntimeError: http_429").alias("error"))
    return products.select("id", F.lit("USD").alias("quote"), F.lit("online").alias("status")), failures


_SINCE = f"ts_start >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 48 HOURS"
SQL_LIVE = (
    sql_features("live").replace("FROM c5 WHERE ts_start + INTERVAL 5 MINUTES <= TIMESTAMP '2024-01-31 00:00:00'),\nk1", f"FROM c5 WHERE ts_start + INTERVAL 5 MINUTES <= TIMESTAMP '2024-01-31 00:00:00' AND {_SINCE}),\nk1", 1)
    + f""",
b0 AS (SELECT ts_start, coalesce(close / lag(close, 6) OVER (ORDER BY ts_start) - 1, 0) AS r FROM c5 WHERE product_id = 'view' AND ts_start >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 12 HOURS),
lb AS (SELECT f.* EXCLUDE (bench_ret_30m), n_bars, coalesce((SELECT arg_max(r, ts_start) FROM b0), 0) AS bench_ret_30m FROM f JOIN (SELECT product_id, max(ts_end) AS ts_end, count(*) AS n_bars FROM f GROUP BY 1) z USING (product_id, ts_end)),
pr AS (SELECT DISTINCT event_type AS id FROM events UNION ALL SELECT 'none'),
sc AS (SELECT pr.id, lb.*, CASE WHEN id = 'error' THEN 'rate_limited' WHEN lb.product_id IS NULL AND id NOT IN (SELECT DISTINCT product_id FROM c5 WHERE {_SINCE}) THEN 'no_candles' WHEN coalesce(n_bars, 0) < 7 THEN 'insufficient_candles'
  WHEN epoch(TIMESTAMP '{AS_OF_TEXT}') - epoch(ts_end) > 86400 THEN 'stale_candles' WHEN price <= 0 OR vwap <= 0 THEN 'missing_price_or_vwap' ELSE 'scored' END AS scan_status FROM pr LEFT JOIN lb ON pr.id = lb.product_id)"""
)


@query("scan_live", f"WITH {SQL_LIVE}, " + SQL_ROWS.split(f"WITH {SQL_SCAN}, ", 1)[1] + """
SELECT o.*, CASE WHEN product IS NOT NULL THEN rank() OVER (ORDER BY coalesce(prob_2, -1) DESC, coalesce(prob_1, -1) DESC, product) ELSE 0 END AS place, scan_status, coalesce(n_bars, 0) AS n_bars, round(bench_ret_30m, 6) + 0.0 AS bench_ret_30m,
  CASE WHEN scan_status = 'rate_limited' THEN 'rate_limited:RuntimeError' ELSE scan_status END AS skip_detail FROM sc LEFT JOIN o ON o.product = sc.id""")
def _scan_live(spark, sf):
    """The whole scan with lookback, live profile, benchmark and a failed product: every product with its score row."""
    products, failed = _scan_inputs(spark, sf)
    stored = written(candles(spark, sf, 300), "candles")
    profile = written(P.volume_profile(C.completed(stored, ntz(AS_OF_TEXT)), SCAN, ntz(AS_OF_TEXT)), "profile")
    got = N.scan(products, stored, SCAN, ntz(AS_OF_TEXT), profile=profile, failures=failed)
    place = F.row_number().over(Window.orderBy(F.coalesce("prob_2", F.lit(-1.0)).desc(), F.coalesce("prob_1", F.lit(-1.0)).desc(), "product")).cast("long")  # a row for each product
    more = got.scanned.select("id", "scan_status", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), "bench_ret_30m", "skip_detail")
    rows = show(got.scores).withColumn("place", place)
    return show(more.join(rows, F.col("id") == F.col("product"), "left").drop("id").withColumn("place", F.coalesce("place", F.lit(0).cast("long"))))


# ---- training ------------------------------------------------------------------------------

SQL_MATRIX = f"""{sql_features()}, {SQL_LABELS},
bm AS (SELECT ts_end, ret_30m AS br FROM f WHERE product_id = 'view'),
mx AS (SELECT y.* EXCLUDE (bench_ret_30m), coalesce(br, 0) AS bench_ret_30m FROM y LEFT JOIN bm USING (ts_end) WHERE i >= 30),
sp AS (SELECT *, row_number() OVER (ORDER BY ts_end, product_id) - 1 AS pos, count(*) OVER () AS n FROM mx),
ss AS (SELECT *, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * 0.8) THEN 'cal' ELSE 'val' END AS split FROM sp)"""


def _matrix(spark, sf):
    return T.training_matrix(candles(spark, sf, 300), candles(spark, sf, 60), FIXTURE, ntz(AS_OF_TEXT))


@query("training_matrix", f"WITH {SQL_MATRIX} SELECT product_id, {t19('ts_end')}, {d6(*FEATURES)}, y1, y2 FROM mx")
def _training(spark, sf):
    return show(_matrix(spark, sf))


@query("time_split", f"WITH {SQL_MATRIX} SELECT product_id, {t19('ts_end')}, pos, split FROM ss")
def _split(spark, sf):
    return show(T.time_split(_matrix(spark, sf).select("product_id", "ts_end")).select("product_id", "ts_end", "pos", "split"))


@query("time_bucket4", f"WITH {sql_features('training', 'UTC_DAY_END')} SELECT least(3, CAST(floor(4 * time_remaining_frac) AS INTEGER)) AS bucket, count(*) AS n FROM f GROUP BY 1")
def _bucket(spark, sf):
    return features(spark, sf, _DAY_END).groupBy(S.bucket4(F.col("time_remaining_frac")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("bucket_priors", f"""WITH {SQL_MATRIX}, g AS (SELECT least(3, CAST(floor(4 * time_remaining_frac) AS INTEGER)) AS bucket, avg(y1) AS p FROM ss WHERE split <> 'val' GROUP BY 1)
SELECT CAST(r AS INTEGER) AS bucket, round(coalesce(p, 0.5), 6) + 0.0 AS prior FROM range(4) t(r) LEFT JOIN g ON g.bucket = r""")
def _priors(spark, sf):
    return show(T.bucket_priors(T.time_split(_matrix(spark, sf)).where("split <> 'val'"), "y1"))


def _scored_matrix(spark, sf):
    return R.heuristic(_matrix(spark, sf)).select("product_id", "ts_end", "y1", "y2", F.round("prob_1", 6).alias("p"))


_SCORED = f"WITH {SQL_MATRIX}, {SQL_HEUR.format(src='mx')}, g AS (SELECT y1, y2, round(prob_1, 6) AS p FROM hh)"


@query("brier", f"{_SCORED} SELECT round(avg((p - y1) * (p - y1)), 6) + 0.0 AS brier FROM g")
def _brier(spark, sf):
    return show(T.brier(_scored_matrix(spark, sf), "y1", "p"))


@query("roc_auc", f"""{_SCORED}, k AS (SELECT y2, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM g)
SELECT round((sum(r) FILTER (y2 = 1) - count(*) FILTER (y2 = 1) * (count(*) FILTER (y2 = 1) + 1) / 2.0) / (count(*) FILTER (y2 = 1) * count(*) FILTER (y2 = 0)), 6) + 0.0 AS auc FROM k""")
def _auc(spark, sf):
    return show(T.roc_auc(_scored_matrix(spark, sf), "y2", "p"))


@query("prior_blend_select", f"""{_SCORED}, a AS (SELECT unnest([0.6, 0.7, 0.8, 0.9]) AS alpha), b AS (SELECT alpha, avg((alpha * p + (1 - alpha) * 0.25 - y1) ** 2) AS brier FROM g, a GROUP BY 1)
SELECT CAST(alpha AS DOUBLE) AS alpha, round(brier, 6) + 0.0 AS brier FROM b ORDER BY brier LIMIT 1""")
def _blend(spark, sf):
    return show(T.best_alpha(_scored_matrix(spark, sf).withColumn("prior", F.lit(0.25)), "y1", "p", "prior", (0.6, 0.7, 0.8, 0.9)))


@query("per_product_rows", f"WITH {sql_candles('a', 300)}, {sql_candles('b', 60)} SELECT product_id, CAST(300 AS INTEGER) AS granularity_sec, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT product_id, 60, count(*) FROM b GROUP BY 1")
def _per_product(spark, sf):
    return T.candle_counts(candles(spark, sf, 300).unionByName(candles(spark, sf, 60)))


@query("next_aligned_tick", f"SELECT event_id, {t19('date_trunc(chr(100) || chr(97) || chr(121), ts) + INTERVAL 30 MINUTE * (CAST(floor((hour(ts) * 60 + minute(ts)) / 30) AS INTEGER) + 1)', 'tick')} FROM events")
def _tick(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return show(e.select("event_id", S.next_tick(F.col("ts"), 30).alias("tick")))


@query("safe_filename", "SELECT p_partkey, regexp_replace(p_name || '/' || p_type || '-é.x', '[^\\p{L}\\p{N}\\-_.]', '_', 'g') AS name FROM part")
def _safe(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", S.safe_filename(F.concat("p_name", F.lit("/"), "p_type", F.lit("-é.x"))).alias("name"))


def sql_spline(x: str, lo: float, hi: float, knots: int = 5) -> str:
    """Cubic basis on even knots: each function is one curve of four pieces, moved by a knot."""
    step = (hi - lo) / (knots - 1)
    t = lambda k: f"((least({hi}, greatest({lo}, {x})) - ({lo + step * (k - 3)})) / {step})"
    piece = "CASE WHEN # < 0 OR # >= 4 THEN 0 WHEN # < 1 THEN #*#*#/6 WHEN # < 2 THEN (-3*#*#*# + 12*#*# - 12*# + 4)/6 WHEN # < 3 THEN (3*#*#*# - 24*#*# + 60*# - 44)/6 ELSE (4-#)*(4-#)*(4-#)/6 END"
    return ", ".join(f"round({piece.replace('#', t(k))}, 6) + 0.0 AS b{k}" for k in range(knots + 1))


@query("spline_basis", f"WITH {sql_features()} SELECT product_id, {t19('ts_end')}, {sql_spline('vwap_loc', -5.0, 5.0)} FROM f")
def _spline(spark, sf):
    cols = T.spline_columns("vwap_loc", -5.0, 5.0)
    return show(features(spark, sf).select("product_id", "ts_end", *[c.alias(f"b{k}") for k, c in enumerate(cols)]))


@query("lr_probs", None)
def _lr(spark, sf):
    """Model probabilities of both targets for the validation rows after training on the rows before."""
    split = written(T.time_split(_matrix(spark, sf)), "split")
    out = split.where("split = 'val'")
    for y, prob in (("y1", "prob_1"), ("y2", "prob_2")):
        out = T.predict(T.fit_target(split, y, FIXTURE), out, prob)
    return out.select("product_id", "ts_end", "y1", "prob_1", "y2", "prob_2")


def bar_files(spark, sf, root: str) -> list[DataFrame]:
    """Completed bars of three periods, for streams that read one file after the other."""
    bars = written(C.completed(candles(spark, sf, 300), ntz(AS_OF_TEXT)).drop("ts_end"), "bars")
    days = ("2024-01-01", "2024-01-12", "2024-01-21", "2024-02-01")
    return [bars.where((F.col("ts_start") >= ntz(f"{a} 00:00:00")) & (F.col("ts_start") < ntz(f"{b} 00:00:00"))) for a, b in zip(days, days[1:], strict=False)]


@query("stream_equals_batch", f"""WITH {sql_features()} SELECT product_id, {t19("ts_start")}, round((fast - slow) / (close + 1e-12), 6) + 0.0 AS ema_diff_pct, {d6("atr", "adx", "obv")} FROM k5""")
def _stream(spark, sf):
    """Running indicators of a stream of bar files."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for k, part in enumerate(bar_files(spark, sf, root)):
        part.coalesce(1).write.mode("append" if k else "overwrite").parquet(f"{root}/bars")
    stream = spark.readStream.schema(CANDLES).option("maxFilesPerTrigger", 1).parquet(f"{root}/bars")
    out = running_indicators(stream).writeStream.outputMode("append").option("checkpointLocation", f"{root}/state")
    out.trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{root}/out")).start().awaitTermination()
    return show(spark.read.parquet(f"{root}/out"))


@query("stream_features", f"WITH {sql_features()} SELECT product_id, {t19('ts_end')}, {d6(*FEATURES)} FROM f")
def _stream_features(spark, sf):
    """All 25 features of a stream: two files, a stop, and the third file after a restart from the checkpoint. The last two bars
    of each period are sent again with the next one."""
    root = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    parts = bar_files(spark, sf, root)
    out_schema = None
    for k, part in enumerate(parts):
        newest = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("ts_start")))
        again = parts[k - 1].withColumn("_n", newest).where("_n <= 2").drop("_n") if k else part.limit(0)
        part.unionByName(again).coalesce(1).write.mode("append" if k else "overwrite").parquet(f"{root}/bars")
        if not k:
            continue
        with state_settings(spark, drain=True):
            live = running_features(spark.readStream.schema(CANDLES).option("maxFilesPerTrigger", 1).parquet(f"{root}/bars"), FIXTURE)
            out_schema = live.schema
            run = live.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
            run.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")).start().awaitTermination()
    return show(spark.read.schema(out_schema).parquet(f"{root}/out").select("product_id", "ts_end", *FEATURES))


@query("stream_benchmark", f"""WITH {sql_features()},
v AS (SELECT ts_end, i, ret_30m FROM f WHERE product_id = 'view'),
o AS (SELECT * FROM v WHERE i % 7 <> 3),
mark AS (SELECT least((SELECT max(ts_end) FROM f WHERE ts_end < TIMESTAMP '2024-01-12'), (SELECT max(ts_end) FROM o WHERE ts_end < TIMESTAMP '2024-01-12' AND i % 5 <> 1)) - INTERVAL 6 HOURS AS w),
b AS (SELECT ts_end, ret_30m FROM o, mark WHERE NOT (i % 5 = 1 AND ts_end <= w))
SELECT f.product_id, {t19('f.ts_end', 'ts_end')}, round(f.ret_30m, 6) + 0.0 AS ret_30m, round(coalesce(b.ret_30m, 0), 6) + 0.0 AS bench_ret_30m FROM f LEFT JOIN b ON b.ts_end = f.ts_end""")
def _stream_benchmark(spark, sf):
    """Feature rows beside the benchmark's, in three batches. Every seventh bar of the benchmark is missing; every fifth of the
    first period comes with the third: too late, but for its last six hours. The watermark of a batch holds from the next one on, so
    those rows still wait while the second period is read."""
    root = f"{shared_folder(spark)}/benchmark-{uuid.uuid4().hex}"
    rows = written(features(spark, sf).select("product_id", "ts_end", "ret_30m", "i"), "rows")
    bench = rows.where("product_id = 'view' AND i % 7 <> 3")
    days = [ntz(f"{d} 00:00:00") for d in ("2024-01-01", "2024-01-12", "2024-01-21", "2024-02-01")]
    late = (F.col("i") % 5 == 1) & (F.col("ts_end") < days[1])
    # a last row of either side, a month on, lets the watermark pass all others
    end = lambda df: df.limit(1).select(*[F.lit("end").alias(c) if c == "product_id" else (F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias(c) if c == "ts_end" else F.col(c)) for c in df.columns])
    parts = lambda df: [df.where((F.col("ts_end") >= a) & (F.col("ts_end") < b)) for a, b in zip(days, days[1:], strict=False)]
    first, second, third = parts(bench)
    sides = {"rows": [*parts(rows), end(rows)], "bench": [first.where(~late), second, third.unionByName(first.where(late)), end(rows)]}
    for name, files in sides.items():
        for k, part in enumerate(files):
            part.drop("i").coalesce(1).write.mode("append" if k else "overwrite").parquet(f"{root}/{name}")
    schema = rows.drop("i").schema
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}")
    out = with_live_benchmark(read("rows"), read("bench"), late="6 hours").writeStream.outputMode("append").option("checkpointLocation", f"{root}/state")
    out.trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")).start().awaitTermination()
    return show(spark.read.parquet(f"{root}/out").where("product_id <> 'end'").select("product_id", "ts_end", "ret_30m", "bench_ret_30m"))


# ---- versions ------------------------------------------------------------------------------

@query("store_versions", f"""WITH {sql_candles("c", 300)},
x AS (SELECT 1 AS version, * FROM c WHERE ts_start < TIMESTAMP '2024-01-11'
  UNION ALL SELECT 2, * FROM c WHERE ts_start < TIMESTAMP '2024-01-21'
  UNION ALL SELECT 3, product_id, ts_start, open, high, low, CASE WHEN product_id = 'view' AND ts_start < TIMESTAMP '2024-01-06' THEN close + 1 ELSE close END, volume, ingest_seq FROM c WHERE ts_start < TIMESTAMP '2024-01-21')
SELECT CAST(version AS INTEGER) AS version, strftime(ts_start, '%Y-%m-%d') AS day, product_id, count(*) AS n, round(sum(close), 6) + 0.0 AS close, round(sum(volume), 6) + 0.0 AS volume
FROM x GROUP BY 1, 2, 3""")
def _store_versions(spark, sf):
    """Ten days, ten later days, and corrected bars of one product: three versions, each read as it was published."""
    made = written(candles(spark, sf, 300), "candles")
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    day = lambda n: F.col("ts_start") < ntz(f"2024-01-{n:02d} 00:00:00")
    store.merge(made.where(day(11)))
    store.merge(made.where(~day(11) & day(21)))
    store.merge(made.where((F.col("product_id") == "view") & day(6)).withColumn("close", F.col("close") + 1).withColumn("ingest_seq", F.col("ingest_seq") + 1))
    out = None
    for v in store.versions():
        per_day = store.read(v).groupBy("day", "product_id").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("close"), F.sum("volume").alias("volume"))
        per_day = per_day.select(F.lit(v).alias("version"), F.date_format("day", "yyyy-MM-dd").alias("day"), "product_id", "n", r6("close"), r6("volume"))
        out = per_day if out is None else out.unionByName(per_day)
    return out
