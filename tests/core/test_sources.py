from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings, parse_flag, parse_list
from tidemark.sources import candles as C
from tidemark.sources import rest, snapshots
from tidemark.sources.versions import Store
from tidemark.streaming.ingest import merge


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def bar(product, when, close, seq):
    return (product, 300, dt.datetime.fromisoformat(when), close, close, close, close, 1.0, seq)


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), "product_id string, granularity_sec int, ts_start timestamp_ntz, open double, high double, low double, close double, volume double, ingest_seq long")


def test_wire_rows(spark):
    payload = '[[1704067200, 1, 4, 2, 3, 9.5], [1704067260, 1, 4, 2, 3, 9.5, "x"], [1, 2], "no", [1704067200, 1, null, 2, 3, 4], [1704067200, "NaN", 4, 2, 3, 9]]'
    got = C.parse_wire(spark.createDataFrame([("a", payload), ("b", "{}"), ("c", None), ("d", "[]")], "product_id string, payload string")).collect()
    assert [(r["product_id"], r["low"], r["high"], r["open"], r["close"], r["volume"]) for r in got] == [("a", 1, 4, 2, 3, 9.5)] * 2
    assert sorted(r["ts_start"].minute for r in got) == [0, 1]


def test_upsert_is_idempotent_and_last_wins(spark):
    old = bars(spark, bar("a", "2024-01-01T00:00", 1.0, 0), bar("a", "2024-01-01T00:05", 2.0, 0))
    new = bars(spark, bar("a", "2024-01-01T00:05", 3.0, 1), bar("b", "2024-01-01T00:05", 4.0, 1))
    once = C.upsert(old, new)
    assert sorted((r["product_id"], r["close"]) for r in once.collect()) == [("a", 1.0), ("a", 3.0), ("b", 4.0)]
    assert sorted(map(tuple, C.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_plan_fills_both_ends(spark):
    stored = bars(spark, bar("a", "2024-01-02T00:00", 1.0, 0), bar("a", "2024-01-03T00:00", 1.0, 0))
    products = spark.createDataFrame([("a",), ("b",)], "id string")
    got = C.fetch_plan(products, stored, 300, ts("2024-01-01 00:00:00"), ts("2024-01-04 00:00:00")).collect()
    spans = {}
    for r in got:
        assert (r["to_ts"] - r["from_ts"]).total_seconds() <= 300 * 300
        spans.setdefault(r["product_id"], []).append((r["from_ts"], r["to_ts"]))
    assert min(spans["b"])[0] == dt.datetime(2024, 1, 1) and max(spans["b"])[1] == dt.datetime(2024, 1, 4)
    assert min(spans["a"])[0] == dt.datetime(2024, 1, 1) and (dt.datetime(2024, 1, 2, 23, 50)) in {s for s, _ in spans["a"]}


def test_store_and_stream_merge(spark, tmp_path):
    path = str(tmp_path / "store")
    merge(bars(spark, bar("a", "2024-01-01T00:00", 1.0, 0), bar("a", "2024-01-02T00:00", 2.0, 0)), path)
    merge(bars(spark, bar("a", "2024-01-02T00:00", 5.0, 1), bar("b", "2024-01-02T00:05", 6.0, 1)), path)
    got = sorted((r["product_id"], r["close"]) for r in Store(spark, path).read().collect())
    assert got == [("a", 1.0), ("a", 5.0), ("b", 6.0)]


def test_snapshots(spark, tmp_path):
    p = str(tmp_path / "doc")
    assert snapshots.load_document(spark, p) is None and snapshots.load(spark, str(tmp_path / "none")) is None
    snapshots.publish_document(spark, {"b": 1, "a": dt.date(2024, 1, 1)}, p)
    assert snapshots.load_document(spark, p) == {"a": "2024-01-01", "b": 1}
    (tmp_path / "doc/log/000000000002.json").write_text("{broken")
    assert snapshots.load_document(spark, p) is None


class Script:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), 0

    def __call__(self, url, timeout):
        self.calls += 1
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_fetch_retries_then_succeeds():
    waits, health = [], rest.Health()
    bucket = rest.TokenBucket(5, clock=lambda: 0.0, sleep=waits.append)
    script = Script((429, b""), OSError("reset"), (503, b""), (200, b"[1]"))
    assert rest.fetch("u", script, bucket, health, waits.append) == [1]
    assert script.calls == 4 and [0.75 * 2**k <= w <= 1.25 * 2**k for k, w in enumerate(waits)] == [True] * 3
    assert health.last_429 and health.status() == "OK" and health.status(demo=True) == "DEMO_MODE"


def test_fetch_gives_up():
    health, bucket = rest.Health(), rest.TokenBucket(100)
    with pytest.raises(RuntimeError, match="http_404"):
        rest.fetch("u", Script((404, b"")), bucket, health, lambda s: None)
    with pytest.raises(RuntimeError, match="http_500"):
        rest.fetch("u", Script(*[(500, b"")] * 5), bucket, health, lambda s: None)
    assert health.status() == "WARN"


def test_token_bucket_waits_after_burst():
    waits, now = [], [0.0]
    bucket = rest.TokenBucket(2, clock=lambda: now[0], sleep=waits.append)
    for _ in range(5):
        bucket.take()
    assert len(waits) == 1 and waits[0] == pytest.approx(0.5)


def test_reader_deals_requests_and_demo_reads_nothing(spark):
    requests = [[f"p{i}", f"/x{i}"] for i in range(7)]
    reader = rest.CandleReader({"base_url": "http://h", "requests": json.dumps(requests), "max_inflight": "3", "max_rps": "1000"}, Script(*[(200, b"[[1]]" if i else b"{}") for i in range(7)]))
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(reader.partitions()) == 3 and sorted(r[0] for r in got) == [f"p{i}" for i in range(7)] and got[0][1] == "[]"
    spark.dataSource.register(rest.CandleSource)
    assert spark.read.format("tidemark_rest").option("demo", "true").option("requests", json.dumps(requests)).load().count() == 0


def test_settings():
    s = Settings.from_mapping({"HORIZON_MINUTES": "x", "MIN_BARS_5M": "9", "QUOTE_ALLOWLIST": " usd, ,eur", "EXCLUDE_STABLECOIN_BASE": "off", "ENET_C_VALUES": "1,2"})
    assert (s.horizon_minutes, s.min_bars_5m, s.quote_allowlist, s.exclude_stablecoin_base, s.enet_c_values) == (240, 9, ("USD", "EUR"), False, (1.0, 2.0))
    with pytest.raises(ValueError):
        Settings.from_mapping({"ENET_C_VALUES": "a"})
    assert parse_list(None) == () and parse_flag("Yes", False) and parse_flag(None, True)
