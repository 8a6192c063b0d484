"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Pieces of equal length are interchangeable, so best fit decreasing runs on the histogram of
lengths (at most ``capacity`` rows, whatever the corpus size): bins with equal space left form
ranges of sequence numbers, and a segment tree over the remaining capacities finds the tightest
open bin for a length in logarithmic time. One step moves a whole range of equal bins. The result
is the plan that the one-document-at-a-time algorithm makes, as a short list of moves.

The cluster's part: one pass encodes texts and numbers each task's pieces of a length; per-task
counts give every piece its rank among its length by an ordinary join; a binary search in the
moves turns a rank into (sequence, offset).

Edge cases: null and empty texts are one piece with the end id alone; texts longer than the
capacity are cut, nothing is dropped; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import default_vocabulary, encoder

CAPACITY = 2048
END_ID = 0
#: Documents encoded at once; bounds the memory of a task besides its longest text.
ENCODE_ROWS = 512


class CapacityTree:
    """Number of open bin ranges by remaining capacity, with successor search."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity >= need that an open bin has."""
        at = self.leaves + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Moves (first_rank, length, first_bin, offset, per_bin) in rank order, and the bin count.

    Ranks number all pieces by decreasing length. The pieces of a move fill bins first_bin,
    first_bin + 1, ... with per_bin pieces each, from the offset on."""
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}
    moves: list[tuple[int, int, int, int, int]] = []
    bins = rank = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(n, left // each)
            if full:
                moves.append((rank, length, first, capacity - room, each))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and 0 < left < each:  # the last pieces of this length share one bin
                moves.append((rank, length, first + full, capacity - room, each))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return np.array(moves, dtype=np.int64).reshape(-1, 5), bins


def token_pieces(docs: DataFrame, *, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """One row per piece, with the task that made it and its number among the task's pieces of its length."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                source, piece, start, length, crc, nth, blobs = [], [], [], [], [], [], []
                for row, raw in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    for k in range(0, len(raw), 4 * capacity):
                        own = raw[k : k + 4 * capacity]
                        n = len(own) // 4
                        source.append(row)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        nth.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            blobs.append(own)
                arrays = [part.column(0).take(pa.array(source, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(source), pa.int32()), pa.array(nth, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(blobs, pa.binary())] if with_ids else []), names + ["ids"] * with_ids)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all docs with sequence_id and offset; with_ids adds their token ids (unsigned 32-bit, little-endian)."""
    scratch = Scratch(docs.sparkSession, "packing")
    made = token_pieces(docs, vocabulary=vocabulary or default_vocabulary(), capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    pieces = scratch.table(made, "pieces")

    counts = pieces.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    moves, _ = best_fit_decreasing(histogram, capacity)
    lengths = sorted(histogram, reverse=True)
    first_rank = np.zeros(capacity + 1, dtype=np.int64)
    first_rank[lengths] = np.cumsum([0, *(histogram[x] for x in lengths[:-1])]) if lengths else 0

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    offsets = counts.select(F.col("length").alias("_length"), F.col("task").alias("_task"), before.alias("_before"))
    ranked = pieces.join(offsets, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    ranked = ranked.withColumn("rank", F.col("_before") + F.col("nth")).drop("_length", "_task", "_before", "task", "nth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.schema.get_field_index("rank")
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + first_rank[length]
            move = moves[np.searchsorted(moves[:, 0], rank, side="right") - 1]
            bin_, slot = np.divmod(rank - move[:, 0], move[:, 4])
            keep = [c for k, c in enumerate(batch.columns) if k != n]
            names = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(move[:, 2] + bin_), pa.array(move[:, 3] + slot * length)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{n} {t}" for n, t in ranked.dtypes if n != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
