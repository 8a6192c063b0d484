from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.plans import scan as N
from tidemark.plans import scoring as R
from tidemark.plans import training as T
from tidemark.plans.features import indicators, last_bars, last_return, latest_features
from tidemark.schemas import CANDLES, FEATURES
from tidemark.sources import rest, snapshots
from tidemark.sources.versions import Log, Store
from tidemark.streaming import ingest
from tidemark.streaming import scan as stream

NOW = dt.datetime(2024, 1, 10, 12, 0)
CFG = Settings(benchmark_symbol="B-USD")


def at(x):
    return F.lit(x).cast("timestamp_ntz")


def series(product, bars, seconds=300, end=NOW):
    out = []
    for k in range(bars):
        start = end - dt.timedelta(seconds=seconds * (bars - k))
        close = 100 + (k * 37 % 11) + (len(product) + k) % 5
        out.append((product, seconds, start, close - 0.5, close + 1.0, close - 1.5, float(close), 10.0 + k % 7, k))
    return out


def candles(spark, *rows):
    return spark.createDataFrame([r for part in rows for r in part], CANDLES)


def products(spark, *ids):
    return spark.createDataFrame([(i, i[-3:], "online") for i in ids], "id string, quote string, status string")


def fixed_bundle(features=FEATURES):
    class Halves:
        """Stands for a fitted pipeline: raw probability one half."""

        def transform(self, df):
            from pyspark.ml.functions import array_to_vector

            return df.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))

    scale = {f: [0.0, 0.0] for f in T.SPLINED}
    return T.Bundle(Halves(), scale, {b: T.Calibrator() for b in range(4)}, {b: 0.1 for b in range(4)}, 0.75, {}, tuple(features))


def test_scan_reads_the_lookback_and_reports_failures(spark):
    old = candles(spark, series("A-USD", 40), series("B-USD", 30), series("S-USD", 40, end=NOW - dt.timedelta(hours=3)), series("O-USD", 40, end=NOW - dt.timedelta(hours=60)), series("F-USD", 3))
    failures = spark.createDataFrame([("X-USD", "RuntimeError: http_429"), ("Y-USD", "ValueError: bad"), ("A-USD", None)], "product_id string, error string")
    got = N.scan(products(spark, "A-USD", "B-USD", "S-USD", "O-USD", "F-USD", "X-USD", "Y-USD"), old, CFG, at(NOW), failures=failures)
    status = {r["id"]: r["scan_status"] for r in got.scanned.collect()}
    assert status == {"A-USD": "scored", "B-USD": "scored", "S-USD": "stale_candles", "O-USD": "no_candles", "F-USD": "insufficient_candles", "X-USD": "rate_limited", "Y-USD": "other_errors"}
    assert {(r["product"], r["reason"]) for r in got.skipped.collect()} >= {("X-USD", "rate_limited:RuntimeError"), ("Y-USD", "other_errors:ValueError"), ("O-USD", "no_candles")}
    cover = got.coverage.first().asDict()
    assert [cover[k] for k in list(cover)[:5]] == [7, 7, 4, 3, 2] and cover["top_skip_reasons"]["rate_limited"] == 1
    bench = indicators(old.where("product_id = 'B-USD'"), CFG, at(NOW)).orderBy(F.col("i").desc()).first()["ret_30m"]
    assert {round(r["bench_ret_30m"], 9) for r in got.scanned.where("scan_status = 'scored'").collect()} == {round(bench, 9)}
    assert {r["prob_1_source"] for r in got.scores.collect()} == {"heuristic", "skipped"} and got.models["using"] == "heuristic"
    assert N.scan(products(spark, "A-USD").limit(0), old.limit(0), CFG, at(NOW)).scores.count() == 0


def test_scan_with_models_and_schema_mismatch(spark):
    old = candles(spark, series("A-USD", 40), series("B-USD", 30))
    both = {"pt1": (fixed_bundle(), "ok"), "pt2": (fixed_bundle(), "ok")}
    got = N.scan(products(spark, "A-USD", "B-USD", "N-USD"), old, CFG, at(NOW), models=both)
    rows = got.scores.collect()
    assert {r["prob_1_source"] for r in rows} == {"model"} and {round(r["prob_2"], 9) for r in rows} == {0.75 * 0.5 + 0.25 * 0.1}
    assert got.models["using"] == "model" and got.models["pt2"] == {"ok": True, "reason": "ok", "target": "5%"}
    wrong = both | {"pt2": (fixed_bundle([*FEATURES, "other"]), "ok")}
    got = N.scan(products(spark, "A-USD", "B-USD", "N-USD"), old, CFG, at(NOW), models=wrong)
    plain = N.scan(products(spark, "A-USD", "B-USD", "N-USD"), old, CFG, at(NOW))
    assert {r["prob_1_source"] for r in got.scores.collect()} == {"heuristic(schema_mismatch)"}
    assert [r["prob_1"] for r in got.scores.collect()] == [r["prob_1"] for r in plain.scores.collect()]
    assert got.coverage.first()["top_skip_reasons"] == {"model_schema_incompatible": 2, "no_candles": 1}
    one = N.scan(products(spark, "A-USD"), old, CFG, at(NOW), models={"pt1": both["pt1"], "pt2": (None, "missing")})
    assert one.models["using"] == "heuristic" and one.models["pt2"]["reason"] == "missing" and one.models["schema_warning"]


def test_latest_features_equal_the_last_bars(spark):
    long = candles(spark, series("A-USD", 1500), series("B-USD", 5))
    want = {r["product_id"]: r.asDict() for r in last_bars(indicators(long, CFG, at(NOW))).collect()}
    for r in latest_features(long, CFG, at(NOW)).collect():
        own = want[r["product_id"]]
        assert r["n_bars"] == own["n_bars"] and r["ts_end"] == own["ts_end"]
        assert [r[f] for f in FEATURES] == pytest.approx([own[f] for f in FEATURES], rel=1e-9, abs=1e-9)


def test_short_series_in_one_chunk_and_the_last_return(spark):
    short = candles(spark, series("A-USD", 1500), series("B-USD", 7), series("C-USD", 1))
    get = lambda df: {(r["product_id"], r["ts_end"]): [r[f] for f in FEATURES] + [r["i"]] for r in df.collect()}
    want, got = get(indicators(short, CFG, at(NOW), chunk=700)), get(indicators(short, CFG, at(NOW), chunk=None))
    assert got.keys() == want.keys()
    for k, row in got.items():
        assert row == pytest.approx(want[k], rel=1e-9, abs=1e-9)
    last = {r["product_id"]: r for r in last_bars(indicators(short, CFG, at(NOW))).collect()}
    for p, r in last.items():
        one = last_return(short.where(F.col("product_id") == p), at(NOW)).first()
        assert (one["ts_end"], one["ret_30m"]) == (r["ts_end"], pytest.approx(r["ret_30m"], abs=1e-12))
    assert last_return(short.limit(0), at(NOW)).count() == 0


def test_load_bundle_reasons(spark, tmp_path):
    def meta(text):
        log = tmp_path / "m/log"
        log.mkdir(parents=True, exist_ok=True)
        (log / "000000000001.json").write_text('{"folder": "data/none", "meta": ' + text + "}")
        return T.load_bundle(spark, f"{tmp_path}/m")[1]

    assert T.load_bundle(spark, f"{tmp_path}/none")[1] == "missing"
    assert meta("{broken") == "invalid_bundle" and meta("[1]") == "invalid_bundle"
    assert meta(json.dumps({"schema_version": "old"})) == "schema_version_mismatch"
    assert meta(json.dumps({"schema_version": T.SCHEMA_VERSION})) == "missing_feature_names"
    assert meta(json.dumps({"schema_version": T.SCHEMA_VERSION, "feature_names": []})).startswith("load_error")


def test_retrain_publishes_models_and_scans(spark, tmp_path, monkeypatch):
    cfg = Settings(benchmark_symbol="B-USD", train_lookback_days=1, train_max_products=2, horizon_minutes=20, enet_c_values=(1.0,), enet_l1_values=(0.0,))
    names = ("A-USD", "B-USD", "C-USD")
    five = candles(spark, *(series(p, 1400) for p in names))
    minutes = candles(spark, *(series(p, 7000, seconds=60) for p in names))
    seen = {}
    monkeypatch.setattr(T, "fit_target", lambda split, y, c: seen.setdefault(y, split) and fixed_bundle())
    monkeypatch.setattr(T.Bundle, "save", lambda self, path: snapshots.publish_document(spark, {"saved": True}, path))
    scans = []
    report = N.retrain(products(spark, *names), five, minutes, cfg, at(NOW), str(tmp_path), then=lambda: scans.append(1))
    assert report["last_error"] is None and report["products"] == 2 and scans == [1]
    first = NOW - dt.timedelta(days=3)
    rows = seen["y1"].agg(F.min("ts_end"), F.collect_set("product_id")).first()
    assert rows[0] >= first + dt.timedelta(minutes=5 * 31) and set(rows[1]) == {"A-USD", "B-USD"}
    assert {(r["product_id"], r["granularity_sec"], r["n"]) for r in snapshots.load(spark, f"{tmp_path}/training_products").collect()} == {(p, g, 3 * 86400 // g) for p in ("A-USD", "B-USD") for g in (60, 300)}
    assert snapshots.load_document(spark, f"{tmp_path}/training_status") == {"running": False, "last_error": None}

    def broken(*a, **b):
        raise OSError("disk")

    with monkeypatch.context() as m, pytest.raises(OSError, match="disk"):
        m.setattr(T, "train", broken)
        N.retrain(products(spark, *names), five, minutes, cfg, at(NOW), str(tmp_path))
    assert snapshots.load_document(spark, f"{tmp_path}/training_status") == {"running": False, "last_error": "disk"}
    failed = N.retrain(products(spark, *names), five.limit(0), minutes, cfg, at(NOW), str(tmp_path), then=lambda: scans.append(2))
    assert failed["last_error"] == "no_training_rows" and scans == [1]


def test_auto_training_limits(spark):
    cfg = Settings(train_lookback_days=10, auto_train_lookback_days=1, auto_train_max_products=1)
    rows = candles(spark, series("A-USD", 288 * 20))
    days = lambda auto: T.training_window(rows, cfg, at(NOW), auto=auto).count() / 288
    assert (days(False), days(True)) == (12, 3)
    ids = spark.createDataFrame([("Z-USD", 0), ("A-USD", 1)], "id string, rank int")
    assert [r[0] for r in T.training_products(ids, cfg, auto=True).collect()] == ["Z-USD"] and T.training_products(ids, cfg).count() == 2


def test_streamed_candles_are_merged_scanned_and_published(spark, tmp_path):
    store, root = f"{tmp_path}/store", f"{tmp_path}/out"
    assert stream.warm_start(spark, root) == (None, None)
    candles(spark, series("A-USD", 20), series("B-USD", 20)).coalesce(1).write.parquet(f"{tmp_path}/in")

    def scan():
        held = Store(spark, store).read().where("granularity_sec = 300")
        N.publish(N.scan(products(spark, "A-USD", "B-USD", "N-USD"), held, CFG, at(NOW)), root, NOW.isoformat())

    source = spark.readStream.schema(CANDLES).parquet(f"{tmp_path}/in")
    stream.on_candles(source, scan, lambda batch: ingest.merge(batch, store), f"{tmp_path}/check").awaitTermination()
    scores, document = stream.warm_start(spark, root)
    assert scores.count() == 2 and document["rows_count"] == 2 and document["last_candle_timestamp"] == "2024-01-10T12:00:00+00:00"
    assert [r["product"] for r in snapshots.load_run(spark, f"{root}/scan")[0]["skipped"].collect()] == ["N-USD"]


def test_ticks_call_the_scan(spark, tmp_path):
    calls = []
    query = stream.on_ticks(spark, lambda: calls.append(time.time()), f"{tmp_path}/ticks", minutes=1 / 20)
    try:
        until = time.time() + 60
        while len(calls) < 5 and time.time() < until:
            time.sleep(0.2)
        assert len(calls) >= 5 and any(c % 3 < 1 for c in calls[2:])  # the first ones catch up with the start
    finally:
        query.stop()


def test_ticks_follow_midnight_and_outlive_a_failing_scan(spark, tmp_path):
    day = dt.datetime(2024, 1, 10, tzinfo=dt.UTC)
    assert stream.tick(day + dt.timedelta(minutes=20), 7 * 60) == day + dt.timedelta(minutes=14)
    assert stream.tick(day + dt.timedelta(hours=23, minutes=59), 7 * 60) == day + dt.timedelta(minutes=205 * 7)
    assert stream.tick(day, 1800) == day
    calls = []

    def scan():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError(f"down {len(calls)}")

    query = stream.on_ticks(spark, scan, f"{tmp_path}/ticks", minutes=1 / 30, status=f"{tmp_path}/status")
    try:
        until = time.time() + 60
        seen = set()
        while len(calls) < 4 and time.time() < until:
            seen.add(str((snapshots.load_document(spark, f"{tmp_path}/status") or {}).get("last_error")))
            time.sleep(0.1)
        assert len(calls) >= 4 and query.exception() is None and "RuntimeError: down 1" in seen
        assert snapshots.load_document(spark, f"{tmp_path}/status")["last_error"] is None
    finally:
        query.stop()


def test_other_sessions_models_start_a_scan(spark, tmp_path):
    """Models published through another session are found by the log alone, each once."""
    root, scans = str(tmp_path / "models"), []
    for k in (1, 2):
        Log(spark.newSession(), f"{root}/pt{k}").append({"folder": "data/x", "meta": {}})
    run = lambda: stream.on_models(spark, root, lambda: scans.append(1), f"{tmp_path}/check", interval=None).awaitTermination()
    run()
    assert scans == [1]
    run()
    assert scans == [1]  # nothing new after a restart
    Log(spark.newSession(), f"{root}/pt2").append({"folder": "data/y", "meta": {}})
    run()
    assert scans == [1, 1]


def test_scan_reads_only_the_days_of_the_lookback(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.merge(candles(spark, series("A-USD", 288 * 6), series("B-USD", 288 * 6)))
    held = N.lookback(store.read().where("granularity_sec = 300"), at(NOW), N.LOOKBACK_HOURS)
    plan = held._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.split("PartitionFilters: [")[1:]).split("], PushedFilters")[0]
    assert "day#" in filters and "granularity_sec#" in filters
    assert "day" not in held.columns and held.count() == 2 * 576
    with_day = N.scan(products(spark, "A-USD", "B-USD"), store.read().where("granularity_sec = 300"), CFG, at(NOW)).scores.collect()
    assert with_day == N.scan(products(spark, "A-USD", "B-USD"), store.read().drop("day"), CFG, at(NOW)).scores.collect()


def test_upsert_stream_and_bars_with_watermark(spark, tmp_path):
    made = candles(spark, series("A-USD", 4), [series("A-USD", 4)[3][:6] + (999.0, 1.0, 99)])
    made.coalesce(1).write.parquet(f"{tmp_path}/in")
    ingest.upsert_stream(spark.readStream.schema(CANDLES).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/check", interval=None).awaitTermination()
    got = Store(spark, f"{tmp_path}/store").read().orderBy("ts_start").collect()
    assert len(got) == 4 and got[-1]["close"] == 999.0
    trades = [("A", NOW + dt.timedelta(seconds=s), 10.0 + s, 1.0, s) for s in (0, 70, 100, 400, 2000)]
    spark.createDataFrame(trades, "product_id string, ts timestamp, price double, volume double, seq long").coalesce(1).write.parquet(f"{tmp_path}/trades")
    source = spark.readStream.schema("product_id string, ts timestamp, price double, volume double, seq long").parquet(f"{tmp_path}/trades")
    out = ingest.bars(source, 300, late="1 minute").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/bars-check").trigger(availableNow=True)
    out.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/bars")).start().awaitTermination()
    rows = {r["ts_start"]: r for r in spark.read.parquet(f"{tmp_path}/bars").collect()}
    assert set(rows) == {NOW, NOW + dt.timedelta(minutes=5)}  # the watermark keeps the last bar open
    first = rows[NOW]
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (10.0, 110.0, 10.0, 110.0, 3.0)


def test_catalog_pages_failures_and_health(spark):
    body = json.dumps([{"id": "a-usd", "base_currency": "A", "quote_currency": "USD", "status": "online", "more": 1}, {"id": "b-eur"}, {"x": 1}])
    answers = {"/products": (200, body.encode()), "/x": (404, b""), "/y": (200, b"{}")}
    reader = rest.CandleReader({"base_url": "http://h", "requests": json.dumps([[p, p] for p in answers]), "max_rps": "1000"}, lambda url, t: answers[url.removeprefix("http://h")])
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    pages = spark.createDataFrame(rows, rest.CandleSource({}).schema())
    got = [tuple(r) for r in rest.parse_catalog(pages).orderBy("id").collect()]
    assert got == [("a-usd", "A", "USD", "online"), ("b-eur", None, None, None)]
    assert [tuple(r) for r in rest.failures(pages).collect()] == [("/x", "RuntimeError: http_404")]
    assert rest.health(pages).first().asDict() == {"requests": 3, "errors": 1, "rate_limited": 0, "backoffs": 0, "status": "WARN"}
    assert rest.health(pages.limit(0), demo=True).first()["status"] == "DEMO_MODE"


def test_isotonic_of_many_knots(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.unique(rng.random(3000))
    y = np.sort(rng.random(len(x)))
    p = np.concatenate([rng.random(500), x[:50], [-1.0, 0.0, 1.0, 2.0]])
    got = spark.createDataFrame([(float(v),) for v in p], "p double").select(T.Calibrator("isotonic", x=x.tolist(), y=y.tolist()).apply(F.col("p")).alias("q"))
    assert [r["q"] for r in got.collect()] == pytest.approx(np.interp(p, x, y).tolist())
    step = T.Calibrator("isotonic", x=[0.2, 0.4, 0.4, 0.8], y=[0.1, 0.1, 0.7, 0.9])
    assert [r[0] for r in spark.createDataFrame([(0.3,), (0.4,), (0.6,)], "p double").select(step.apply(F.col("p"))).collect()] == pytest.approx([0.1, 0.7, 0.8])
    assert [r[0] for r in spark.range(1).select(T.Calibrator("isotonic", x=[0.5], y=[0.3]).apply(F.lit(0.7))).collect()] == [0.3]


def test_spline_basis_equals_the_recursion(spark):
    """Cox-de Boor's recursion, one function and point at a time."""
    lo, hi, knots, degree = -1.0, 3.0, 5, 3
    at_ = [lo + (hi - lo) / (knots - 1) * k for k in range(-degree, knots + degree)]

    def basis(k, d, v):
        if d == 0:
            last = degree + knots - 2  # the last interval holds its right end; those beyond are empty
            return float(k <= last and (at_[k] <= v < at_[k + 1] or (k == last and v == at_[k + 1])))
        a = (v - at_[k]) / (at_[k + d] - at_[k]) * basis(k, d - 1, v)
        return a + (at_[k + d + 1] - v) / (at_[k + d + 1] - at_[k + 1]) * basis(k + 1, d - 1, v)

    points = [lo - 1, lo, -0.3, 0.0, 1.0, 2.2, 2.9999, hi, hi + 5]
    cols = T.spline_columns("x", lo, hi)
    for (x,), got in zip([(p,) for p in points], spark.createDataFrame([(p,) for p in points], "x double").select(*cols).collect(), strict=True):
        v = min(hi, max(lo, x))
        want = [basis(k, degree, v) for k in range(len(at_) - degree - 1)][:-1]
        assert list(got) == pytest.approx(want, abs=1e-12)


def test_score_rows_and_skip_histogram_of_failures(spark):
    rows = spark.createDataFrame([("A", "rate_limited", "rate_limited:X"), ("B", "no_candles", "no_candles"), ("C", "rate_limited", "rate_limited:Y")], "id string, scan_status string, skip_detail string")
    assert [tuple(r) for r in R.skip_histogram(rows).collect()] == [("rate_limited", 2), ("no_candles", 1)]
