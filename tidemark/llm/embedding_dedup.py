"""Near-duplicate embeddings by product quantisation over inverted lists.

Fit: coarse centroids and residual sub-codebooks are learned on a bounded sample (``SAMPLE``
vectors in hash order); every vector is indexed in the list of its nearest centroid.

Search: the ends of a link lie at most ``reach`` apart and on either side of the plane halfway
between their centroids, so one of them is within reach / 2 of it. Each vector, as a query, visits
every list whose plane is that near and whose counted radius it reaches; no link is lost, whatever
the number of lists. Where vectors do not cluster, many lists stay and the work is a fixed share of
all pairs. In a list, table lookups give the distance from the query to each item's code. A true
link at distance d has a code distance of at most d + (the item's own quantisation error), so that
bound drops no link; what passes is reranked by the exact cosine in double precision. A link
between lists counts where the end nearer to the plane is the query, so both ends get it once.

Bit-equal vectors are one node with a count. Neighbouring lists form shards; a query goes once to
each shard that it visits. Shards are cut into blocks of at most about ``BLOCK`` items and queries;
a block pair emits partial counts and spanning links per row, never its pairs.

Edge cases: null, empty, zero or non-finite vectors and rows without an id link with nothing and
are their own component; vectors of different dimensions never link; rows that repeat an id are
separate vectors, but different ones for which no smaller id stands are one node: they get one component
and the sum of their links;
components of any finite size are scaled before squaring; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

THRESHOLD = 0.9
SAMPLE = 20_000
LIST_ROWS, MOST_LISTS = 128, 4096
PARTS, CODES = 8, 256
BLOCK = 8192
#: Queries and items compared at once, rows of a dealt batch, pairs held before they are counted.
CHUNK, DEALT, HELD = 2048, 8192, 1_000_000
#: Above any rounding of the distances in the bounds.
SLACK = 1e-5


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest centroids, nearest first."""
    d = (c * c).sum(1) - 2 * (x @ c.T)
    if k == 1:
        return d.argmin(1)[:, None]
    k = min(k, len(c))
    some = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.take_along_axis(d, some, 1).argsort(1, kind="stable"), 1)


class Quantiser:
    def __init__(self, sample: np.ndarray, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        lists = min(MOST_LISTS, max(1, len(sample) // 8), 1 << max(0, (rows // LIST_ROWS).bit_length()))
        self.centroids = k_means(sample, lists, rng)
        rest = sample - self.centroids[nearest(sample, self.centroids, 1)[:, 0]]
        self.cuts = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], CODES, rng) for a, b in self.spans()]

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True))

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(own list, codes, quantisation error, distance to the centroid) of unit vectors."""
        own = nearest(x, self.centroids, 1)[:, 0]
        rest = x - self.centroids[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for s, (a, b) in enumerate(self.spans()):
            codes[:, s] = nearest(rest[:, a:b], self.books[s], 1)[:, 0]
            error += ((rest[:, a:b] - self.books[s][codes[:, s]]) ** 2).sum(1)
        return own.astype(np.int32), codes, np.sqrt(error), np.sqrt((rest * rest).sum(1))

    def visits(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
        """Which of the lists each unit vector must visit; radius belongs to lists, below 0 if empty."""
        c, mine = self.centroids[lists], self.centroids[own]
        d = np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T))
        more = d - ((x - mine) ** 2).sum(1)[:, None]
        heads, at = np.unique(own, return_inverse=True)
        h = self.centroids[heads]
        gap = np.sqrt(np.maximum(0, (h * h).sum(1)[:, None] + (c * c).sum(1) - 2 * (h @ c.T)))[at]
        return (more <= reach * gap + SLACK) & (np.sqrt(d) <= radius + reach + SLACK) & (radius >= 0)

    def tables(self, query: np.ndarray) -> list[np.ndarray]:
        """Per part, -2 times the products of queries and codewords."""
        return [(-2 * (query[:, a:b] @ book.T)).astype(np.float32) for (a, b), book in zip(self.spans(), self.books, strict=True)]

    def distances(self, query: np.ndarray, tables: list[np.ndarray], where: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the codes of a list; tables are those of the queries."""
        centre = self.centroids[where]
        fixed = np.zeros(len(codes))  # what a code adds to the distance from the centroid
        for s, (a, b) in enumerate(self.spans()):
            book = self.books[s]
            fixed += ((book * book).sum(1) + 2 * (book @ centre[a:b]))[codes[:, s]]
        out = (((query - centre) ** 2).sum(1)[:, None] + fixed).astype(np.float32)
        for s, table in enumerate(tables):
            out += table[:, codes[:, s]]
        return out


def shards_of(centroids: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Shard of each list: neighbouring lists together, at most BLOCK items in a shard of several."""
    out, n = np.empty(len(centroids), np.int64), 0
    open_ = [np.arange(len(centroids))]
    while open_:
        own = open_.pop()
        if len(own) == 1 or items[own].sum() <= BLOCK:
            out[own] = n
            n += 1
            continue
        c = centroids[own] - centroids[own].mean(0)
        own = own[np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")]
        run = items[own].cumsum()
        cut = min(max(1, int(np.searchsorted(run, run[-1] / 2))), len(own) - 1)
        open_ += [own[:cut], own[cut:]]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def usable_rows(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, vector as bytes or null, hash of the bytes, dimension). Vectors are scaled by a power of two, which changes
        no cosine, so that their largest component is near 1."""
        import xxhash

        for batch in batches:
            blobs: list[bytes | None] = [None] * batch.num_rows
            dims: list[int | None] = [None] * batch.num_rows
            vectors = batch.column(1)
            size = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for d in np.unique(size[known & (size > 0)]).tolist():
                rows = np.flatnonzero(known & (size == d))
                flat = vectors.take(pa.array(rows)).flatten()
                x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)  # nulls become nan
                most = np.abs(x).max(axis=1)
                ok = np.isfinite(x).all(axis=1) & (most > 0)
                rows, x = rows[ok], x[ok]
                x = np.ldexp(x, -np.frexp(most[ok])[1][:, None]) + 0.0
                for r, v in zip(rows.tolist(), x.astype(dtype), strict=True):
                    blobs[r], dims[r] = v.tobytes(), d
            keys = [xxhash.xxh3_128_digest(b) if b else None for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(blobs, pa.binary()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32())], ["id", "vector", "key", "dim"])

    return run


def index_rows(q: Quantiser, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes, error, far = q.index(unit(matrix(batch.column("vector"), dtype).astype(np.float64)))
                cols = [pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(far)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "vector")), *cols], ["id", "n", "vector", "own", "codes", "error", "far"])

    return run


def shard_visits(q: Quantiser, dtype: str, reach: float, radius: np.ndarray, shard: np.ndarray):
    """Function of a batch: (row, shard) of every shard that a row visits."""
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(np.diff(shard[order], prepend=-1))

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = unit(matrix(batch.column("vector"), dtype).astype(np.float64))
        visited = q.visits(x, batch.column("own").to_numpy(), order, radius[order], reach)
        return np.nonzero(np.logical_or.reduceat(visited, starts, axis=1))

    return of


def visit_counts(visits, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(shards, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(visits(batch)[1], minlength=shards)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["shard", "n"])

    return run


def deal_rows(visits, shard: np.ndarray, item_blocks: np.ndarray, query_blocks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as an item to its shard's block and as a query to the blocks of the shards it visits."""
        for batch in batches:
            if not batch.num_rows:
                continue
            mix = ((batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            out = []
            for role, (row, where), times in ((0, (np.arange(batch.num_rows), shard[batch.column("own").to_numpy()]), query_blocks), (1, visits(batch), item_blocks)):
                n = times[where]
                row, where = np.repeat(row, n), np.repeat(where, n)
                each = np.arange(len(row)) - np.repeat(n.cumsum() - n, n)
                ib, qb = (mix[row] % item_blocks[where], each) if role == 0 else (each, mix[row] % query_blocks[where])
                out.append((where, ib, qb, np.full(len(row), role), row))
            *keys, row = (np.concatenate(c) for c in zip(*out, strict=True))
            for at in range(0, len(row), DEALT):
                cols = [pa.array(k[at : at + DEALT].astype(np.int32)) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, *batch.take(pa.array(row[at : at + DEALT])).columns], ["shard", "ib", "qb", "role", *batch.schema.names])

    return run


def search_rows(q: Quantiser, dtype: str, threshold: float, radius: np.ndarray):
    names = ["id", "links", "centre"]
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        role = t.column("role").to_numpy()
        items, queries = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not len(items) or not len(queries):
            return
        ids, n, own, error = (t.column(c).to_numpy() for c in ("id", "n", "own", "error"))
        x = unit(matrix(t.column("vector").combine_chunks(), dtype).astype(np.float64))
        codes = matrix(t.column("codes").combine_chunks(), np.uint8)
        items = items[np.argsort(own[items], kind="stable")]
        lists, starts = np.unique(own[items], return_index=True)
        ends = [*starts[1:].tolist(), len(items)]

        def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = (x[a] * x[b]).sum(1) >= threshold
            keep &= ids[a] != ids[b]
            a, b = a[keep], b[keep]
            # between lists the end nearer to the plane is the query that counts
            more = lambda i, j: ((x[i] - q.centroids[own[j]]) ** 2).sum(1) - ((x[i] - q.centroids[own[i]]) ** 2).sum(1)
            here, there = more(a, b), more(b, a)
            keep = (own[a] == own[b]) | (here < there) | ((here == there) & (ids[a] < ids[b]))
            return a[keep], b[keep]

        def counted(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
            # a query counts its items; an item of another list counts the query
            links = np.bincount(a, weights=n[b], minlength=len(ids))
            back = own[a] != own[b]
            links += np.bincount(b[back], weights=n[a[back]], minlength=len(ids))
            label = ids.copy()
            while True:
                low = np.minimum(label[a], label[b])
                after = label.copy()
                np.minimum.at(after, a, low)
                np.minimum.at(after, b, low)
                if (after == label).all():
                    break
                label = after
            rows = np.unique(np.concatenate([a, b]))
            return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(links[rows].astype(np.int64)), pa.array(label[rows])], names)

        held, size = [], 0
        for i in range(0, len(queries), CHUNK):
            asked = queries[i : i + CHUNK]
            tables = q.tables(x[asked])
            visited = q.visits(x[asked], own[asked], lists, radius[lists], reach)
            for k, where in enumerate(lists.tolist()):
                at = np.flatnonzero(visited[:, k])
                if not len(at):
                    continue
                some = [table[at] for table in tables]
                for j in range(starts[k], ends[k], CHUNK):
                    own_items = items[j : min(j + CHUNK, ends[k])]
                    close = q.distances(x[asked[at]], some, where, codes[own_items]) <= ((reach + error[own_items] + 1e-4) ** 2)[None, :]
                    a, b = np.nonzero(close)
                    for m in range(0, len(a), 65536):
                        pair = linked(asked[at[a[m : m + 65536]]], own_items[b[m : m + 65536]])
                        if len(pair[0]):
                            held.append(pair)
                            size += len(pair[0])
                        if size >= HELD:
                            yield counted(held)
                            held, size = [], 0
        if held:
            yield counted(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("shard", "ib", "qb")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                now = tuple(key[:, at].tolist())
                if held and now != last:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, end - at))
                last = now
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    dtype = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = scratch.table(rows.mapInArrow(usable_rows(dtype), "id long, vector binary, key binary, dim int"), "rows")
    same = rows.where("key IS NOT NULL").groupBy("key", "dim").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    same = scratch.table(same, "distinct")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.createDataFrame([], "id long, links long, centre long")
    for dim, count in sorted((r["dim"], r["count"]) for r in same.groupBy("dim").count().collect()):
        own = same.where(F.col("dim") == dim)
        sample = [r["vector"] for r in own.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
        q = Quantiser(unit(np.stack([np.frombuffer(v, dtype) for v in sample]).astype(np.float64)), count)
        indexed = own.select("id", "n", "vector").mapInArrow(index_rows(q, dtype), "id long, n long, vector binary, own int, codes binary, error double, far double")
        indexed = scratch.table(indexed, f"indexed-{dim}")
        items, radius = np.zeros(len(q.centroids), np.int64), np.full(len(q.centroids), -1.0)
        for r in indexed.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # at most one row a list
            items[r["own"]], radius[r["own"]] = r["n"], r["far"]
        shard = shards_of(q.centroids, items)
        indexed = indexed.drop("far")
        visits = shard_visits(q, dtype, float(np.sqrt(max(0.0, 2 - 2 * threshold))), radius, shard)
        queries = np.zeros(shard.max() + 1, np.int64)
        for r in indexed.mapInArrow(visit_counts(visits, len(queries)), "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect():  # at most one row a shard
            queries[r["shard"]] = r["n"]
        cut = lambda n: np.maximum(1, -(-n // BLOCK)).astype(int)
        fields = ", ".join(f"{n} {t}" for n, t in indexed.dtypes)
        deal = deal_rows(visits, shard, cut(np.bincount(shard, weights=items)), cut(queries))
        dealt = indexed.mapInArrow(deal, f"shard int, ib int, qb int, role int, {fields}")
        dealt = dealt.repartition(parts, "shard", "ib", "qb").sortWithinPartitions("shard", "ib", "qb")
        hits = scratch.table(dealt.mapInArrow(search_rows(q, dtype, threshold, radius), "id long, links long, centre long"), f"hits-{dim}")
        found = hits if found.isEmpty() else found.unionByName(hits)

    counts = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "_id")
    names = components(found.select(F.col("id").alias("a"), F.col("centre").alias("b")), scratch)
    per_node = same.select("key", "id", "n").join(counts, F.col("id") == F.col("_id"), "left").join(names, F.col("id") == F.col("node"), "left")
    per_node = per_node.select(F.col("key").alias("_key"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "key").join(per_node, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.component, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
