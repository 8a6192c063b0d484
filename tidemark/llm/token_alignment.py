"""Alignment of two tokenizers over the same bytes, by merge-path partitioning.

1. Each task encodes its texts with both tokenizers; the ends of all tokens of a batch, as byte offsets that rise from
   text to text, are two ascending arrays whatever the lengths of the texts.
2. Merging A's ends with B's is a path through a grid. Binary searches on evenly spaced diagonals, all at once, find where
   the path crosses them: that cuts the merge into pieces of equal work, each independent of the others.
3. A piece emits its overlaps: pairs of ends that are equal. An overlap that a diagonal would part is put into the piece
   before it; groups are what lies between overlaps, so one that begins in a piece and ends in a later one is stitched
   from their tokens by its two bounding overlaps.
4. Each text keeps its distinct id pairs with counts. Sums over the corpus are a partial aggregate; the most frequent
   pairs, up to a fixed number, come back to the texts by a broadcast, so no hot pair is shuffled; the others by a join.

Edge cases: null and empty texts, and texts whose bytes a tokenizer changes, have no tokens: zeros and an empty digest.
Texts of any length are encoded and merged whole; ids may repeat or be null, every row is counted by itself; pairs
with equal counts are all their B id's highest; an empty table gives no rows; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .token_tables import Pair

#: Steps of the merge in a piece; characters of text that a task encodes at once.
PIECE, AT_ONCE = 1 << 15, 1 << 20
#: Pairs that are broadcast at most.
HOT_PAIRS = 100_000
#: A pair as one number: A's id times this plus B's id.
SHIFT = 1 << 32


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def merge_cuts(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending arrays (of a first where equal) crosses every piece-th diagonal: i of a and j
    of b come before it. Equal ends are never parted. First (0, 0), last (len(a), len(b))."""
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        more = a[mid] <= b[d[open_] - 1 - mid]
        low[open_] = np.where(more, mid + 1, low[open_])
        high[open_] = np.where(more, high[open_], mid)
    i, j = low, d - low
    inner = np.flatnonzero((i > 0) & (j < len(b)))
    j[inner] += a[i[inner] - 1] == b[j[inner]]
    return i, j


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the ends that both have, ascending. Both arrays rise strictly."""
    i, j = merge_cuts(a, b, piece)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i0, i1, j0, j1 in zip(i, i[1:], j, j[1:], strict=False):
        own, other = a[i0:i1], b[j0:j1]
        if len(own) and len(other):
            at = np.minimum(np.searchsorted(other, own), len(other) - 1)
            hit = np.flatnonzero(other[at] == own)
            found.append((hit + i0, at[hit] + j0))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Aligner:
    """Aligned batches of texts."""

    def __init__(self, a_path: str, b_path: str, piece: int = PIECE):
        self.pair, self.piece = Pair(a_path, b_path), piece
        n = len(self.pair.a_len), len(self.pair.b_len)
        # decimal ids with the mark behind them, padded by NUL
        self.words = np.array([b"%d%c" % (i, mark) for size, marks in zip(n, (b",|", b",;"), strict=True) for mark in marks for i in range(size)])
        self.base = [0, n[0], 2 * n[0], 2 * n[0] + n[1]]

    def __call__(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """n_a, n_b, n_links, groups (bytes) of each text, and pairs of all texts with the text's number and their count."""
        a, b, n_a, n_b = self.pair.encode(texts)
        i, j = overlaps(np.cumsum(self.pair.a_len[a]), np.cumsum(self.pair.b_len[b]), self.piece)
        owner = np.repeat(np.arange(len(texts)), n_a)[i] if len(i) else np.zeros(0, np.int64)
        # every token as its decimal id and the mark behind it, in the order of the groups: A's, then B's
        last = [np.zeros(len(x), bool) for x in (a, b)]
        last[0][i] = last[1][j] = True
        group = [np.cumsum(x) - x for x in last]
        order = np.empty(len(a) + len(b), np.int64)
        j_before, i_within = np.concatenate([[0], j + 1]), np.append(i + 1, len(a))
        order[np.arange(len(a)) + j_before[group[0]]] = a + np.where(last[0], self.base[1], self.base[0])
        order[np.arange(len(b)) + i_within[group[1]]] = b + np.where(last[1], self.base[3], self.base[2])
        ends = np.cumsum(n_a + n_b)
        groups = [self.words[order[e - n : e]].tobytes().translate(None, b"\0")[:-1] for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]
        pairs, at = np.unique(a[i].astype(np.int64) * SHIFT + b[j], return_inverse=True)
        own, count = np.unique(owner * max(1, len(pairs)) + at, return_counts=True)
        return {"n_a": n_a, "n_b": n_b, "n_links": np.bincount(owner, minlength=len(texts)), "groups": groups, "owner": own // max(1, len(pairs)), "pair": pairs[own % max(1, len(pairs))], "count": count}


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about most in all; a larger row is alone."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def align_rows(a_path: str, b_path: str):
    names = ["row", "n_a", "n_b", "n_links", "groups_sha256", "pairs", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(a_path, b_path)
        for batch in batches:
            rows, column = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for start, end in _runs(sizes, AT_ONCE):
                got = align([x or "" for x in column.slice(start, end - start).to_pylist()])
                ends = pa.array(np.searchsorted(got["owner"], np.arange(end - start + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.slice(start, end - start),
                        *[pa.array(got[n].astype(np.int64)) for n in names[1:4]],
                        pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]], pa.string()),
                        pa.ListArray.from_arrays(ends, pa.array(got["pair"])),
                        pa.ListArray.from_arrays(ends, pa.array(got["count"].astype(np.int32))),
                    ],
                    names,
                )

    return run


def group_rows(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(a_path, b_path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for start, end in _runs(sizes, AT_ONCE):
                got = align([x or "" for x in batch.column(1).slice(start, end - start).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array([g.decode() for g in got["groups"]])], ["id", "groups"])

    return run


def token_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, groups): the groups of every row of docs as text, `a1,a2|b1;a3|b2,b3`."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(group_rows(*(paths or default_paths())), f"id {kind}, groups string")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, total, best) from links (pair, n): each pair's links in the corpus, and whether no other A id has more with
    its B id. The highest count of each B id is one row an id of B's vocabulary."""
    total = links.groupBy("pair").agg(F.sum("n").cast("long").alias("total"))
    most = Window.partitionBy(F.pmod("pair", F.lit(SHIFT)))  # at most A's vocabulary in each
    return total.withColumn("best", F.col("total") == F.max("total").over(most))


def hot_cut(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach; 1 if all pairs are that few."""
    power = F.floor(F.log2("total")).cast("int")
    rows = {r[0]: r[1] for r in pairs.groupBy(power).count().collect()}  # at most 64 rows
    cut, n = 64, 0
    while cut > 0 and n + rows.get(cut - 1, 0) <= most:
        cut -= 1
        n += rows.get(cut, 0)
    return 1 << cut


def align_tokenizers(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs."""
    scratch = Scratch(docs.sparkSession, "alignment")
    numbered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    schema = "row long, n_a long, n_b long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"
    # the id travels inside the number of the row: both come from the same scan
    made = numbered.select("row", "text", "id")
    kind = docs.schema[id_col].dataType.simpleString()
    aligned = scratch.table(made.mapInArrow(with_id(align_rows(*(paths or default_paths()))), f"{schema}, id {kind}"), "aligned")

    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.counts").alias("n"))
    pairs = scratch.table(pair_counts(links), "pairs")
    cut = hot_cut(pairs, hot_pairs)
    hot = F.broadcast(pairs.where(F.col("total") >= cut).withColumnRenamed("pair", "p"))  # at most hot_pairs rows
    named = links.join(hot, F.col("pair") == F.col("p"), "left")
    sums = (F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    parts = named.where("total IS NOT NULL").groupBy("row").agg(*sums)
    if cut > 1:
        rare = named.where("total IS NULL").select("row", "pair", "n").join(pairs.where(F.col("total") < cut), "pair")
        parts = parts.unionByName(rare.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = aligned.drop("pairs", "counts").join(parts.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", whole("n_best"), whole("count_sum"), "groups_sha256")


def with_id(rows):
    """rows over (row, text), and the third column of its input behind what it makes of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for made in rows(iter([batch])):
                ids = batch.column(2).slice(at, made.num_rows)
                at += made.num_rows
                yield pa.RecordBatch.from_arrays([*made.columns, ids], [*made.schema.names, "id"])

    return run


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
