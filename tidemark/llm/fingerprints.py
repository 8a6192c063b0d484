"""SimHash document fingerprints and a Hamming-radius search over permuted block tables.

Terms are word pairs and single words, hashed to ``BITS`` bits and weighted by 1 + log of their
count (pairs weigh double); every term votes +/- its weight on each bit. Likeness is 1 minus the
share of differing bits.

Search: the fingerprint is cut into blocks with a radius each, such that two fingerprints within
the whole radius lie within that of one block at least; one table per block holds the fingerprints
by that block, and a query asks it for every value within the block's radius. A pair counts in the
first table that finds it. Equal fingerprints are one row with a count, and only the stated queries
search. Texts of five-word shingle similarity 0.8 differ in 11 bits at the median and in 22 at most
(486 edited documents; 30 generated texts), so ``NEAR_RADIUS`` is what finds near copies;
``RADIUS`` only finds almost equal texts.

The query needs each document beside the next one by id: rows are dealt to id ranges, and the
first document of a range is dealt to the range before as well, so no task sees more than a range.

Edge cases: null text counts as empty and has the zero fingerprint; null ids come first; rows that
repeat an id follow each other by text hash; a single document is its own next; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_buckets, free_name, ordered_buckets
from .shingles import mix, text_words

BITS = 128
RADIUS, NEAR_RADIUS = 3, 23
RANGES_A_TASK = 3
#: Weights are whole multiples of 1 / WEIGHT. A block's sum stays below 2**24, so single precision adds exactly, in any
#: order: machines agree on every bit.
WEIGHT, WEIGHT_ROWS = 64, 4096
#: Rows of whole groups and pairs that a search task compares at once.
SEARCH_ROWS, SEARCH_PAIRS = 65_536, 2_000_000


def fingerprint(text: str) -> bytes:
    """BITS/8 bytes; zero for a text without words. Words are lower-cased in A-Z only."""
    h = text_words(text)
    if not len(h):
        return bytes(BITS // 8)
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])
    votes = np.zeros(BITS)
    for terms, weight in ((h, 1.0), (pairs, 2.0)):
        term, count = np.unique(terms, return_counts=True)
        if not len(term):
            continue
        raw = np.stack([mix(term ^ np.uint64(0x5851F42D4C957F2D)), mix(term + np.uint64(0x14057B7EF767814F))], axis=1)
        w = np.rint(WEIGHT * weight * (1 + np.log(count))).astype(np.float32)
        for at in range(0, len(term), WEIGHT_ROWS):
            own = w[at : at + WEIGHT_ROWS]
            bits = np.unpackbits(raw[at : at + WEIGHT_ROWS].view(np.uint8).reshape(-1, BITS // 8), axis=1)
            votes += 2.0 * (own @ bits.astype(np.float32)) - own.sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs and, last, hexadecimal fingerprints of whole texts in ``out`` (underscores before it if docs has one).

    Null and empty texts, and texts without words, have the zero fingerprint; equal texts have equal ones."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t or "").hex()).astype(object)

    return docs.withColumn(free_name(docs, out), F.pandas_udf(run, "string")(F.col(text_col)))


def block_radii(radius: int) -> list[int]:
    """Radius of each block (-1: no table); those plus one add up to radius + 1, so no pair escapes them all."""
    m = max(k for k in (2, 4, 8) if k <= max(2, radius + 1))
    return [(radius + 1) // m + (i < (radius + 1) % m) - 1 for i in range(m)]


def _halves(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(len(column), -1)


def _blocks(halves: np.ndarray, m: int) -> np.ndarray:
    """Fingerprints as rows of m numbers."""
    return np.ascontiguousarray(halves).view(f">u{BITS // 8 // m}").reshape(len(halves), m).astype(np.uint64)


def table_rows(radii: list[int]):
    width = BITS // len(radii)
    flips = [np.array([sum(1 << i for i in some) for k in range(r + 1) for some in combinations(range(width), k)], np.uint64) for r in radii]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(fp, n, by, asks) -> a row per table: a print at its own block, a query at each value near it."""
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            blocks = _blocks(_halves(batch.column("fp")), len(radii))
            for k, flip in enumerate(flips):
                if not len(flip):
                    continue
                for at, rows in [(flip[:1], np.flatnonzero(~asks)), (flip, np.flatnonzero(asks))]:
                    step = max(1, SEARCH_ROWS // len(at))
                    for i in range(0, len(rows), step):
                        some = rows[i : i + step]
                        lead = (blocks[some, k][:, None] ^ at).ravel().view(np.int64)
                        cols = batch.take(pa.array(np.repeat(some, len(at)))).columns
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lead), k, np.int32)), pa.array(lead), *cols], ["block", "lead", *batch.schema.names])

    return run


def search_rows(radii: list[int], radius: int, inner: int):
    names = ["fp", "asks", "n", "n_inner", "by"]

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        block, lead, n, by = (t.column(c).to_numpy() for c in ("block", "lead", "n", "by"))
        asks = t.column("asks").to_numpy()
        fp = _halves(t.column("fp"))
        prints, m = fp.astype(np.uint64), len(radii)
        start = np.concatenate([[True], (block[1:] != block[:-1]) | (lead[1:] != lead[:-1])])
        group = start.cumsum() - 1
        # sorted by asks inside a group: its prints come first
        size = np.bincount(group[~asks], minlength=group[-1] + 1)
        first = np.flatnonzero(start)
        within, tight, least = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.full(len(n), np.iinfo(np.int64).max)
        queries = np.flatnonzero(asks & (size[group] > 0))
        counts = size[group[queries]]
        ends = counts.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        for lo in range(0, total, SEARCH_PAIRS):
            pair = np.arange(lo, min(lo + SEARCH_PAIRS, total))
            k = np.searchsorted(ends, pair, side="right")
            q = queries[k]
            item = first[group[q]] + pair - (ends[k] - counts[k])
            apart = np.bitwise_count(prints[q] ^ prints[item]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(apart <= radius)
            q, item, apart = q[near], item[near], apart[near]
            differ = np.bitwise_count(_blocks(fp[q], m) ^ _blocks(fp[item], m)).astype(np.int64) <= np.array(radii)
            keep = ~(differ & (np.arange(m) < block[q][:, None])).any(axis=1)  # no table before finds the pair
            q, item, apart = q[keep], item[keep], apart[keep]
            np.add.at(within, q, n[item])
            np.add.at(tight, q, np.where(apart <= inner, n[item], 0))
            np.minimum.at(least, item, by[q])
        rows = np.flatnonzero((within > 0) | (least < np.iinfo(np.int64).max))
        if not len(rows):
            return None
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([t.column("fp").combine_chunks().take(at), pa.array(asks[rows]), pa.array(within[rows]), pa.array(tight[rows]), pa.array(least[rows])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "lead")], axis=1)
            at = 0
            if size >= SEARCH_ROWS:  # cut where a group ends
                new = np.flatnonzero((key != np.concatenate([last, key[:-1]])).any(axis=1))
                if len(new):
                    at = int(new[0])
                    if (got := solve(pa.Table.from_batches([*held, batch.slice(0, at)]))) is not None:
                        yield got
                    held, size = [], 0
            held.append(batch.slice(at))
            size += batch.num_rows - at
            last = key[-1:]
        if held and (got := solve(pa.Table.from_batches(held))) is not None:
            yield got

    return run


def search(prints: DataFrame, queries: DataFrame, *, radius: int, inner: int = RADIUS) -> DataFrame:
    """prints (fp), queries (fp, by) -> one row of a found print (asks false: the smallest by of the queries within
    the radius) and of a query (asks true: rows of prints within the radius and within the inner one)."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    radii = block_radii(radius)
    code = F.unhex("fp").alias("fp")
    rows = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).select(code, "n", F.lit(0).cast("long").alias("by"), F.lit(False).alias("asks"))
    asked = queries.groupBy("fp").agg(F.min("by").alias("by")).select(code, F.lit(0).cast("long").alias("n"), "by", F.lit(True).alias("asks"))
    dealt = rows.unionByName(asked).mapInArrow(table_rows(radii), "block int, lead long, fp binary, n long, by long, asks boolean")
    dealt = dealt.repartition(parts, "block", "lead").sortWithinPartitions("block", "lead", "asks")
    found = dealt.mapInArrow(search_rows(radii, radius, inner), "fp binary, asks boolean, n long, n_inner long, by long")
    found = found.groupBy("fp", "asks").agg(F.sum("n").alias("n"), F.sum("n_inner").alias("n_inner"), F.min("by").alias("by"))
    return found.withColumn("fp", F.lower(F.hex("fp")))


def within_radius(prints: DataFrame, queries: DataFrame, *, col: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """(_q, n_within): rows of prints within the radius of each distinct query fingerprint.

    Null fingerprints of either side are left out; a query far from all prints has no row; repeated queries have one."""
    known = F.col("fp").isNotNull()
    found = search(prints.select(F.col(col).alias("fp")).where(known), queries.select(F.col(col).alias("fp"), F.lit(0).cast("long").alias("by")).where(known), radius=radius)
    return found.where("asks").select(F.col("fp").alias("_q"), F.col("n").alias("n_within"))


def compared_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text and the likeness to it and to the next document.

    The edited text replaces the last half of the code points by as many first ones of the next
    document in ascending id order (after the last: the first)."""
    import zstandard

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    # more ranges than tasks even out what tasks get
    splits = ordered_buckets(docs, id_col, RANGES_A_TASK * parts)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[int, tuple] = {}
            for b, doc, tie in zip(arrow_buckets(batch.column(0), splits).tolist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (doc is not None, doc if doc is not None else 0, tie)
                if b not in first or own < first[b][0]:
                    first[b] = (own, doc, tie)
            cols = list(zip(*((b, k[0], d, t) for b, (k, d, t) in first.items()), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], batch.schema.field(0).type), pa.array(cols[3], pa.int64())], ["bucket", "known", "doc_id", "tie"])

    # the first document of every non-empty range, by id and text hash; one row a range
    found = rows.select("doc_id", "tie").mapInArrow(starts, f"bucket int, known boolean, doc_id {kind}, tie long")
    firsts = {r["bucket"]: r["first"] for r in found.groupBy("bucket").agg(F.min(F.struct("known", "doc_id", "tie")).alias("first")).collect()}
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # the first range follows the last
    id_of = {b: firsts[b]["doc_id"] for b in used}

    first_ties = {b: firsts[b]["tie"] for b in used}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            keep, bucket, guest, blobs = [], [], [], []
            ranges = arrow_buckets(batch.column("doc_id"), splits).tolist()
            for i, (b, doc, tie, text) in enumerate(zip(ranges, *(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text")), strict=True)):
                blob = press.compress(text.encode("utf-8"))
                keep.append(i), bucket.append(b), guest.append(False), blobs.append(blob)
                if doc == id_of[b] and tie == first_ties[b]:
                    keep.append(i), bucket.append(before[b]), guest.append(True), blobs.append(blob)
            part = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(guest), part.column("doc_id"), part.column("tie"), pa.array(blobs, pa.binary())], ["bucket", "guest", "doc_id", "tie", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # the row that waits for the next one: (bucket, id, text, fingerprint)
        for batch in batches:
            out: list[tuple] = []
            for bucket, guest, doc, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True):
                text = unpress.decompress(blob).decode("utf-8")
                own = fingerprint(text)
                if held is not None and held[0] == bucket:
                    _, id_, mine, print_ = held
                    cut = len(mine) - len(mine) // 2
                    edited = mine[:cut] + text[: len(mine) // 2]
                    changed = fingerprint(edited)
                    out.append((id_, len(mine), hashlib.sha256(edited.encode("utf-8")).hexdigest(), print_.hex(), changed.hex(), likeness(print_, changed), likeness(print_, own)))
                held = None if guest else (bucket, doc, text, own)
            if out:
                types[0] = batch.schema.field("doc_id").type
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    dealt = rows.select("doc_id", "tie", "text").mapInArrow(deal, f"bucket int, guest boolean, doc_id {kind}, tie long, text binary")
    # a guest closes its range: it comes after all rows of the range
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "tie")
    return dealt.mapInArrow(compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "fingerprints")
    made = scratch.table(compared_with_next(docs), "prints")
    is_query = F.col("doc_id") % 100 == 0
    queries = made.where(is_query).select(F.col("fingerprint").alias("fp"), F.col("doc_id").cast("long").alias("by"))
    found = scratch.table(search(made.select(F.col("fingerprint").alias("fp")), queries, radius=NEAR_RADIUS), "found")
    # for the queries (ids divisible by 100) how many other documents are almost equal and how many near;
    # for every document the first query that it is near to
    counts = found.where("asks").select(F.col("fp").alias("_q"), (F.col("n_inner") - 1).alias("n_within"), (F.col("n") - 1).alias("n_near"))
    joined = made.join(counts, (F.col("fingerprint") == F.col("_q")) & is_query, "left").drop("_q")
    members = found.where("NOT asks").select(F.col("fp").alias("_f"), F.col("by").alias("near_query"))
    return joined.join(members, F.col("fingerprint") == F.col("_f"), "left").drop("_f")
