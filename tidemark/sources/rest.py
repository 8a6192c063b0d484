"""REST candle source as a Spark data source: one input partition per request range.

A reader partition asks for its own requests only and retries what may pass. Every request, a retry too, starts in
a slot of the wall clock that belongs to its partition alone, so all partitions together keep the global rate without
shared state. ``demo`` reads nothing.

``readStream`` reads the same pages as a stream: the offset holds how far each product has been asked."""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Statuses that are worth another try, tries, and delays in seconds.
RETRY_STATUSES = frozenset({429, 500, 502, 503, 504})
TRIES, FIRST_DELAY, MOST_DELAY, JITTER, TIMEOUT = 5, 1.0, 30.0, 0.25, 20.0

#: Bars of a request at most, and newest bars that are asked for again.
MOST_BARS, BARS_AGAIN = 300, 2

Transport = Callable[[str, float], tuple[int, bytes]]


@dataclass
class Health:
    """Counters of a reader; a success clears the streak of backoffs."""

    last_429: float | None = None
    last_backoff: float | None = None
    backoff_count: int = 0
    recent_errors: list[str] = field(default_factory=list)

    def status(self, demo: bool = False) -> str:
        return "DEMO_MODE" if demo else "WARN" if self.recent_errors or self.backoff_count else "OK"


class TokenBucket:
    """At most ``rate`` requests a second with bursts of twice that."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = max(0.1, rate), clock, sleep
        self.capacity = max(2.0, 2 * rate)
        self.tokens, self.at = self.capacity, clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


class Slots:
    """Start times of reader k of n: of the ``rate`` slots a second that the wall clock is cut into, every n-th.

    No slot has two readers, however late one starts or retries, so no second holds more than rate + 1 starts; readers
    with equal shares of m requests end after about m / rate seconds."""

    def __init__(self, rate: float, n: int = 1, k: int = 0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.n, self.k, self.clock, self.sleep = max(0.1, rate), n, k, clock, sleep
        self.last = -1

    def take(self) -> None:
        now = self.clock()
        at = max(self.last + 1, math.ceil(now * self.rate))
        self.last = at + (self.k - at) % self.n
        wait = self.last / self.rate - now
        if wait > 0:
            self.sleep(wait)


def jittered(delay: float, share: float = JITTER, rng: random.Random | None = None) -> float:
    return delay * (1 + share * ((rng or random).random() * 2 - 1))


def urllib_transport(url: str, timeout: float) -> tuple[int, bytes]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"Accept": "application/json"}), timeout=timeout) as r:
            return r.status, r.read()
    except HTTPError as e:
        return e.code, e.read()


def fetch(url: str, transport: Transport, bucket: TokenBucket | Slots, health: Health, sleep: Callable[[float], None] = time.sleep) -> object:
    """The decoded body; transport errors and retry statuses back off, doubling with jitter; other statuses raise at once."""
    delay, error = FIRST_DELAY, ""
    for _ in range(TRIES):
        bucket.take()
        try:
            status, body = transport(url, TIMEOUT)
        except OSError as e:
            error = f"{type(e).__name__}: {e}"
        else:
            if status == 200:
                health.backoff_count, health.recent_errors = 0, []
                return json.loads(body)
            error = f"http_{status}"
            if status == 429:
                health.last_429 = time.time()
            if status not in RETRY_STATUSES:
                health.recent_errors.append(error)
                raise RuntimeError(error)
        health.recent_errors.append(error)
        health.backoff_count += 1
        health.last_backoff = jittered(delay)
        sleep(health.last_backoff)
        delay = min(MOST_DELAY, 2 * delay)
    raise RuntimeError(error)


class Requests(InputPartition):
    def __init__(self, requests: list[tuple[str, str]], n: int = 1, k: int = 0):
        self.requests, self.n, self.k = requests, n, k


def dealt(requests: list[tuple[str, str]], workers: int) -> list[Requests]:
    """Requests in turn to as many partitions as may be in flight."""
    n = min(workers, len(requests))
    return [Requests(requests[k::n], n, k) for k in range(n)]


def pages(base: str, partition: Requests, rate: float, transport: Transport, *, fail: bool = False) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(key, payload, error, backoffs) of each request: a payload that is no list becomes an empty list; a request that fails for
    good has no payload but the error, so it costs its own rows and not the job; with fail it raises."""
    slots = Slots(rate, partition.n, partition.k)
    for key, path in partition.requests:
        waits: list[float] = []
        sleep = lambda s, w=waits: (w.append(s), time.sleep(s))
        try:
            got = fetch(base + path, transport, slots, Health(), sleep)
        except (RuntimeError, ValueError) as e:
            if fail:
                raise
            yield key, None, f"{type(e).__name__}: {e}", len(waits)
        else:
            yield key, json.dumps(got if isinstance(got, list) else []), None, len(waits)


class CandleReader(DataSourceReader):
    def __init__(self, options: dict[str, str], transport: Transport = urllib_transport):
        self.demo = options.get("demo", "false").lower() == "true"
        self.base = options.get("base_url", "").rstrip("/")
        self.requests = [tuple(r) for r in json.loads(options.get("requests", "[]"))]
        self.workers = max(1, int(options.get("max_inflight", "5")))
        self.rate = float(options.get("max_rps", "5"))
        self.transport = transport

    def partitions(self) -> list[Requests]:
        return dealt(self.requests, self.workers) or [Requests([])]

    def read(self, partition: Requests) -> Iterator[tuple[str, str | None, str | None, int]]:
        if not self.demo:
            yield from pages(self.base, partition, self.rate, self.transport)


class CandleStreamReader(DataSourceStreamReader):
    """Pages of a stream. The offset is {product: seconds up to which it has been asked}.

    A batch asks every product from two bars before its start offset, up to the last full bar, in requests of at most 300 bars;
    ``max_requests`` bounds a batch, split evenly over the products that lack bars. A product that is new in the options
    begins at ``start``. Spark logs an offset before the range is planned and replays a range that was not committed, so after
    a stop each range is asked again only if its batch had not ended. How far the log reaches is kept in
    ``progress``, a file that the driver reaches, since Spark does not tell a restarted source before it asks for more."""

    def __init__(self, options: dict[str, str], transport: Transport = urllib_transport):
        self.base = options.get("base_url", "").rstrip("/")
        self.demo = options.get("demo", "false").lower() == "true"
        self.products = sorted(set(json.loads(options.get("products", "[]"))))
        self.width = int(options.get("granularity", "300"))
        self.start = int(options.get("start", "0")) // self.width * self.width
        self.until = int(options["until"]) if "until" in options else None
        self.most = int(options.get("max_requests", "1000"))
        self.workers = max(1, int(options.get("max_inflight", "5")))
        self.rate = float(options.get("max_rps", "5"))
        self.fail = options.get("on_error", "fail").lower() == "fail"
        self.progress = options.get("progress")
        self.transport = transport
        self.planned: dict[str, int] | None = None

    def _file(self, text: str | None = None) -> str | None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.progress) if "://" in self.progress else (fs.LocalFileSystem(), self.progress)
        if text is None:
            if system.get_file_info(path).type == fs.FileType.NotFound:
                return None
            with system.open_input_stream(path) as f:
                return f.read().decode()
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{path}.new") as f:
            f.write(text.encode())
        system.move(f"{path}.new", path)
        return None

    def initialOffset(self) -> dict:
        self.planned = {}
        return {p: self.start for p in self.products}

    def latestOffset(self) -> dict:
        if self.planned is None:
            self.planned = json.loads((self._file() if self.progress else None) or "{}")
        now = self.until if self.until is not None else int(time.time())
        end = now // self.width * self.width
        at = {p: self.planned.get(p, self.start) for p in self.products}
        behind = [p for p in self.products if at[p] < end]
        each = max(1, self.most // max(1, len(behind)))
        ahead = behind if len(behind) <= self.most else sorted(behind, key=lambda p: (at[p], p))[: self.most]
        step = each * MOST_BARS * self.width - BARS_AGAIN * self.width  # the bars asked again are in the requests too
        return {**{p: t for p, t in self.planned.items() if p not in at}, **at, **{p: min(end, at[p] + step) for p in ([] if self.demo else ahead)}}

    def partitions(self, start: dict, end: dict) -> list[Requests]:
        self.planned = dict(end)
        if self.progress:
            self._file(json.dumps(end, sort_keys=True))
        requests = []
        for p in sorted(end):
            begin = start.get(p, self.start)
            if end[p] > begin:
                at = max(self.start, begin - BARS_AGAIN * self.width)
                while at < end[p]:
                    upto = min(end[p], at + MOST_BARS * self.width)
                    requests.append((p, candle_path(p, self.width, utc_text(at), utc_text(upto))))
                    at = upto
        return dealt(requests, self.workers)

    def read(self, partition: Requests) -> Iterator[tuple[str, str | None, str | None, int]]:
        yield from pages(self.base, partition, self.rate, self.transport, fail=self.fail)

    def commit(self, end: dict) -> None:
        """Nothing to free: what a batch has read is in its checkpoint."""


class CandleSource(DataSource):
    """spark.dataSource.register(CandleSource); format("tidemark_rest") with options base_url and
    requests (JSON list of [key, path]); max_rps, max_inflight, demo. As a stream: products (JSON list of ids),
    granularity, start and until (epoch seconds), max_requests, progress, on_error (fail or skip)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_rest"

    def schema(self) -> str:
        return "key string, payload string, error string, backoffs int"

    def reader(self, schema) -> CandleReader:
        return CandleReader(dict(self.options))

    def streamReader(self, schema) -> CandleStreamReader:
        return CandleStreamReader(dict(self.options))


def failures(pages: DataFrame) -> DataFrame:
    """(product_id, error) of the requests that failed, keyed by product."""
    return pages.where("error IS NOT NULL").select(F.col("key").alias("product_id"), "error")


def health(pages: DataFrame, *, demo: bool = False) -> DataFrame:
    """One row about a read: requests, errors, rate limits, backoffs and the status (OK, WARN, DEMO_MODE)."""
    counts = pages.agg(F.count(F.lit(1)).alias("requests"), F.count("error").alias("errors"), F.count_if(F.contains("error", F.lit("http_429"))).alias("rate_limited"), F.coalesce(F.sum("backoffs"), F.lit(0)).alias("backoffs"))
    return counts.withColumn("status", F.lit("DEMO_MODE") if demo else F.when(F.col("errors") > 0, "WARN").otherwise("OK"))


#: The product catalog's path.
CATALOG_PATH = "/products"


def parse_catalog(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """(id, base_currency, quote_currency, status) from pages of JSON arrays of objects; anything else gives no rows."""
    rows = pages.select(F.explode(F.from_json(payload, "array<struct<id: string, base_currency: string, quote_currency: string, status: string>>")).alias("r"))
    return rows.select("r.*").where("id IS NOT NULL")


def utc_text(seconds: int) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(seconds))


def candle_path(product: str, granularity: int, start: str, end: str) -> str:
    return f"/products/{product}/candles?granularity={granularity}&start={start}&end={end}"


def request_pages(plan: DataFrame, base_url: str, *, rate: float = 5.0, inflight: int = 5, transport: Transport = urllib_transport) -> DataFrame:
    """Pages of a table of requests (key, path), asked by as many tasks as may be in flight; the requests never meet in the driver.
    Write the result: whatever reads it again would ask again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for batch in batches:
            asked = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            rows = list(pages(base_url.rstrip("/"), Requests(asked, inflight, TaskContext.get().partitionId()), rate, transport))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], ["key", "payload", "error", "backoffs"])

    return plan.select("key", "path").repartition(inflight).mapInArrow(run, CandleSource({}).schema())
