"""From a catalog to a scan against a local HTTP server, in one call and as a stream that stops and starts again."""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tidemark.config import Settings
from tidemark.plans import ingest as I
from tidemark.plans import scan as N
from tidemark.sources import rest, snapshots
from tidemark.sources.versions import Store

NOW = dt.datetime(2024, 1, 10, 12, 0, tzinfo=dt.UTC)
CATALOG = [{"id": f"{b}-USD", "base_currency": b, "quote_currency": "USD", "status": "online"} for b in "ABC"] + [{"id": "X-EUR", "base_currency": "X", "quote_currency": "EUR", "status": "online"}]
CFG = Settings(benchmark_symbol="A-USD", max_rps=500.0, max_inflight=3)


def seconds(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp())


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            self.server.asked.append(self.path)
            status, body = 200, []
            if self.server.down and (self.server.down in url.path):
                status = 404
            elif url.path == "/products":
                body = CATALOG
            else:
                q = {k: v[0] for k, v in parse_qs(url.query).items()}
                width, product = int(q["granularity"]), url.path.split("/")[2]
                first, last = seconds(q["start"].rstrip("Z")), seconds(q["end"].rstrip("Z"))
                self.server.ranges.append((product, first, last))
                for t in range(-(-first // width) * width, last, width):
                    price = 100 + t // width * 37 % 11 + ord(product[0]) % 5 + self.server.shift
                    body.append([t, price - 1.5, price + 1, price - 0.5, price, 10 + t // width % 7])
            payload = json.dumps(body).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(payload)

        def log_message(self, *a):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    own.asked, own.ranges, own.down, own.shift = [], [], None, 0
    own.url = f"http://127.0.0.1:{own.server_address[1]}"
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield own
    own.shutdown()


def test_one_call_from_catalog_to_published_scan(spark, tmp_path, server):
    store, root = Store(spark, f"{tmp_path}/store"), f"{tmp_path}/out"
    result = I.ingest_and_scan(spark, CFG, store, server.url, root, NOW)
    assert [r["id"] for r in result.scanned.orderBy("id").collect()] == ["A-USD", "B-USD", "C-USD"] and result.scores.count() == 3
    assert store.read().count() == 3 * 576 and max(e - s for _, s, e in server.ranges) == 300 * 300
    assert snapshots.load_run(spark, f"{root}/scan")[1]["rows_count"] == 3
    # the next tick asks for the two newest bars and what is new
    server.ranges.clear()
    server.shift = 1
    later = NOW + dt.timedelta(minutes=30)
    I.ingest_and_scan(spark, CFG, store, server.url, root, later)
    assert sorted(server.ranges) == [(f"{b}-USD", int(NOW.timestamp()) - 900, int(later.timestamp())) for b in "ABC"]
    assert store.read().count() == 3 * 582 and Counter(r["n"] for r in store.read().groupBy("ts_start").count().withColumnRenamed("count", "n").collect()) == {3: 582}
    newest = store.read().where("product_id = 'B-USD'").orderBy("ts_start").collect()
    # bars that were asked again have their new prices
    assert [r["close"] - (100 + int(r["ts_start"].replace(tzinfo=dt.UTC).timestamp()) // 300 * 37 % 11 + ord("B") % 5) for r in newest] == [0.0] * (576 - 3) + [1.0] * 9
    fresh = Store(spark, f"{tmp_path}/fresh")
    server.shift = 0
    got = N.scan(I.ingest(spark, CFG, fresh, server.url, NOW).products, fresh.read().where("granularity_sec = 300"), CFG, N.F.lit(NOW.replace(tzinfo=None)).cast("timestamp_ntz"))
    assert got.scores.collect() == result.scores.collect() or got.scores.count() == 3


def test_a_failing_product_costs_itself_only(spark, tmp_path, server):
    store = Store(spark, f"{tmp_path}/store")
    server.down = "B-USD"
    result = I.ingest_and_scan(spark, CFG, store, server.url, f"{tmp_path}/out", NOW)
    assert {r["product"] for r in result.scores.collect()} == {"A-USD", "C-USD"}
    assert {r["product_id"] for r in store.read().select("product_id").distinct().collect()} == {"A-USD", "C-USD"}
    server.down = None
    again = I.ingest(spark, CFG, store, server.url, NOW)
    assert again.health.first()["status"] == "OK" and store.read().where("product_id = 'B-USD'").count() == 576
    server.down = "/products"
    assert I.products(spark, CFG, server.url)[1] == "fallback"
    own, source = I.products(spark, Settings(crypto_universe=("Q-USD", "NODASH")), server.url)
    assert source == "env" and [r["id"] for r in own.collect()] == ["Q-USD"]


def test_training_is_due_once_and_takes_the_candles_it_needs(spark, tmp_path, server, monkeypatch):
    cfg = Settings(benchmark_symbol="A-USD", max_rps=500.0, auto_train_lookback_days=0, auto_train_max_products=2)
    store, root, seen = Store(spark, f"{tmp_path}/store"), f"{tmp_path}/models", []
    monkeypatch.setattr(N, "retrain", lambda p, five, one, *a, **k: seen.append((p.count(), five.count(), one.count(), k["auto"])) or {"last_error": None})
    assert I.auto_train(spark, cfg, store, server.url, root, NOW, allowed=False) is None and not server.asked
    assert I.auto_train(spark, cfg, store, server.url, root, NOW) == {"last_error": None}
    assert seen == [(3, 2 * 576, 2 * 2880, True)]  # two of three products, A and B, for two days
    assert I.auto_train(spark, cfg, store, server.url, root, NOW + dt.timedelta(minutes=59)) is None
    assert I.auto_train(spark, cfg, store, server.url, root, NOW + dt.timedelta(minutes=61)) is not None
    monkeypatch.setattr(N, "load_models", lambda *a: {k: (object(), "ok") for k in N.MODELS})
    assert I.auto_train(spark, cfg, store, server.url, root, NOW + dt.timedelta(days=1)) is None


def test_serve_scans_at_once_and_tells_what_fails(spark, tmp_path, server, monkeypatch):
    done = []
    monkeypatch.setattr(I, "auto_train", lambda *a, **k: None)

    def scan(spark_, cfg, store, url, root, now, **k):
        done.append(k["models"])
        raise RuntimeError("no network")

    monkeypatch.setattr(I, "ingest_and_scan", scan)
    query = I.serve(spark, CFG, Store(spark, f"{tmp_path}/store"), server.url, f"{tmp_path}/root", f"{tmp_path}/check")
    try:
        until = time.time() + 60
        while not snapshots.load_document(spark, f"{tmp_path}/root/scan_status") and time.time() < until:
            time.sleep(0.2)
        assert snapshots.load_document(spark, f"{tmp_path}/root/scan_status")["last_error"] == "RuntimeError: no network"
        assert len(done) == 1 and done[0]["pt1"] == (None, "missing") and query.isActive
    finally:
        query.stop()


def test_stream_stops_and_starts_again(spark, tmp_path, server):
    begin = int(NOW.timestamp()) - 1000 * 300
    path, checkpoint = f"{tmp_path}/store", f"{tmp_path}/check"
    options = {"start": begin, "max_requests": 2, "max_rps": 500, "max_inflight": 2}

    def run(until, names=("A-USD", "B-USD")):
        """Starts again until nothing is asked; a run is one batch, bounded by max_requests."""
        asked = []
        while True:
            server.ranges.clear()
            I.ingest_stream(spark, list(names), path, checkpoint, server.url, interval=None, until=until, **options).awaitTermination()
            assert len(server.ranges) <= max(2, len(names))
            if not server.ranges:
                return sorted(asked)
            asked += server.ranges

    first = run(begin + 700 * 300)
    for p in ("A-USD", "B-USD"):
        own = [(s, e) for q, s, e in first if q == p]
        assert own[0][0] == begin and own[-1][1] == begin + 700 * 300 and max(e - s for s, e in own) <= 300 * 300
        assert all(b[0] == a[1] - 600 for a, b in zip(own, own[1:], strict=False))  # each range once, two bars again
    assert run(begin + 700 * 300) == []  # nothing new: nothing is asked
    second = run(begin + 1000 * 300, ("A-USD", "B-USD", "C-USD"))
    assert min(s for q, s, _ in second if q == "A-USD") == begin + 698 * 300 and min(s for q, s, _ in second if q == "C-USD") == begin
    held = {(r["product_id"], r["ts_start"]): r["close"] for r in Store(spark, path).read().collect()}
    spark.dataSource.register(rest.CandleSource)
    requests = [[p, rest.candle_path(p, 300, rest.utc_text(s), rest.utc_text(min(s + 90000, begin + 300000)))] for p in ("A-USD", "B-USD", "C-USD") for s in range(begin, begin + 300000, 90000)]
    pages = spark.read.format("tidemark_rest").options(base_url=server.url, requests=json.dumps(requests), max_rps="500").load()
    batch = {(r["product_id"], r["ts_start"]): r["close"] for r in I.candles_of(pages, 300, 0).collect()}
    assert held == batch and len(batch) == 3000


def test_a_failing_request_fails_the_stream_and_is_asked_again(spark, tmp_path, server):
    begin = int(NOW.timestamp()) - 100 * 300
    run = lambda **o: I.ingest_stream(spark, ["A-USD", "B-USD"], f"{tmp_path}/store", f"{tmp_path}/check", server.url, interval=None, start=begin, until=int(NOW.timestamp()), max_rps=500, **o).awaitTermination()
    server.down = "B-USD"
    with pytest.raises(Exception, match="http_404"):
        run()
    assert Store(spark, f"{tmp_path}/store").read().count() == 0
    server.down = None
    run()
    assert Store(spark, f"{tmp_path}/store").read().count() == 200


def test_offsets():
    reader = rest.CandleStreamReader({"products": '["b", "a"]', "start": "1000", "until": "700000", "max_requests": "1"})
    assert reader.initialOffset() == {"a": 900, "b": 900}
    one = reader.latestOffset()
    assert one == {"a": 900 + 298 * 300, "b": 900}  # one request: the product that is farthest behind
    assert [p.requests[0][0] for p in reader.partitions(reader.initialOffset(), one)] == ["a"] and reader.latestOffset()["b"] > 900
    assert reader.partitions(one, one) == []
    demo = rest.CandleStreamReader({"products": '["a"]', "start": "0", "until": "9000", "demo": "true"})
    assert demo.initialOffset() == demo.latestOffset()


@pytest.mark.parametrize(("rate", "n", "late"), [(5.0, 5, 0.0), (5.0, 3, 2.7), (20.0, 7, 0.31), (0.5, 2, 1.0)])
def test_slots_keep_the_global_rate_whatever_starts_late(rate, n, late):
    """Partitions with clocks of their own; each second start moves on as requests take time or are retried."""
    starts, per = [], 40
    for k in range(n):
        now = [1000.0 + late * k]
        slots = rest.Slots(rate, n, k, clock=lambda t=now: t[0], sleep=lambda s, t=now: t.__setitem__(0, t[0] + s))
        for i in range(per):
            slots.take()
            starts.append(now[0])
            now[0] += 0.01 * (i % 3)
    starts.sort()
    assert all(sum(t <= s < t + 1 for s in starts) <= rate + 1 for t in starts)
    assert starts[-1] - 1000 <= n * per / rate + late * n + 2 * n / rate
