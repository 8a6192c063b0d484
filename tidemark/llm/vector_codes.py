"""Product codes of vectors: 64 integer entries for each of 16 parts, found exactly through a GNAT of the entries.

1. Vectors become integers with DataFrame functions, in one written table.
2. A round: every task assigns its parts to their nearest entries and gives sums and counts, at most one row for each
   entry and part; their totals, which do not grow with the table, make the next codebooks on the driver.
3. After the last round the parts are assigned again; errors are summed over equal labels.

Edge cases: null vectors, and those with a null or non-finite component, are dropped. Vectors are padded with zeros to the
longest one's length, rounded up to whole parts; an empty vector is all zeros. Components beyond ``bound`` (2^27 for 64
dimensions) count as that bound, which keeps every distance in 64 bits; sums of errors stop at the largest long. Ids may repeat or be
null: null ids come last for the first entries, vectors of equal ids by their components. With fewer than 64 vectors
there are as many entries. Entries may be equal; the lower index takes what is as near. Null labels are one label. An
empty table gives no rows; only id, vector and label are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small
from .gnat import Gnat

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts that a task assigns at once.
AT_ONCE = 8192
LABELS_BROADCAST = 100_000
MOST = (1 << 63) - 1


def bound(width: int) -> int:
    """Largest component for which the squared distance of two vectors stays below 2^62."""
    return min((1 << 30), int((2.0**62 / max(1, width)) ** 0.5) // 2)


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def integers(vector: Column, width: int) -> Column:
    """floor(SCALE * x) for each component, within the bound, padded with zeros."""
    most = float(bound(width))
    one = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(most)), F.lit(-most))), F.lit(int(most))), F.lit(-int(most))).cast("int")
    return F.concat(F.transform(vector, one), F.array_repeat(F.lit(0), F.lit(width) - F.size(vector)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def round_sums(codebooks: list[np.ndarray], width: int):
    """A task's sums and counts of what each entry gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(c) for c in codebooks]
        sums = [np.zeros_like(c) for c in codebooks]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                x = matrix(batch.column(0).slice(at, AT_ONCE), width)
                for k, part in enumerate(cut(x, len(codebooks))):
                    index, _ = trees[k].nearest(part)
                    np.add.at(sums[k], index, part)
                    counts[k] += np.bincount(index, minlength=len(codebooks[k]))
        used = [(k, e) for k, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in used], pa.int32()),
                pa.array([e for _, e in used], pa.int32()),
                pa.array([int(counts[k][e]) for k, e in used], pa.int64()),
                pa.array([sums[k][e].tolist() for k, e in used], pa.list_(pa.int64())),
            ],
            ["part", "entry", "n", "sums"],
        )

    return run


def code_rows(codebooks: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(c) for c in codebooks]
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                own = batch.slice(at, AT_ONCE)
                found = [t.nearest(p) for t, p in zip(trees, cut(matrix(own.column(2), width), len(codebooks)), strict=True)]
                codes = np.stack([i for i, _ in found], 1).astype(np.uint8)
                error = np.sum([d for _, d in found], axis=0)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error.astype(np.int64))], ["id", "label", "code", "error"])

    return run


def next_codebooks(vectors: DataFrame, codebooks: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Entries replaced by the floors of their parts' means; entries without parts stay."""
    made = vectors.select("x").mapInArrow(round_sums(codebooks, width), "part int, entry int, n long, sums array<long>")
    one = made.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    total = one.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(20,0)")).alias("sum"))
    out = [c.copy() for c in codebooks]
    for r in total.collect():  # at most entries * width rows
        out[r["part"]][r["entry"], r["at"]] = int(r["sum"]) // r["n"]
    return out


def train_codebooks(vectors: DataFrame, width: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (entries x width / parts each) of a written table (id, x)."""
    first = vectors.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), width)
    codebooks = cut(start, parts)
    for _ in range(rounds if len(first) else 0):
        codebooks = next_codebooks(vectors, codebooks, width)
    return codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def compress_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) for every usable vector. entries is 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    scratch = Scratch(df.sparkSession, "codes")
    kept = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = parts * max(1, -(-longest // parts))
    vectors = scratch.table(kept.select("id", "label", integers(F.col("v"), width).alias("x")), "integers")
    codebooks = train_codebooks(vectors, width, parts=parts, entries=entries, rounds=rounds)
    types = dict(vectors.dtypes)
    coded = vectors.select("id", "label", "x").mapInArrow(code_rows(codebooks, width), f"id {types['id']}, label {types['label']}, code string, error long")
    coded = scratch.table(coded, "coded")
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = scratch.table(by_label, "labels")
    out = coded.join(small(by_label, by_label.count(), LABELS_BROADCAST), F.col("label").eqNullSafe(F.col("l")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _assign(books: str) -> str:
    gap = "x[i] - c[i]"
    return f"""SELECT r, p.part, min(struct_pack(d := CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: ({gap}) * ({gap}))) AS BIGINT), e := e)) AS m
  FROM p JOIN {books} b ON b.part = p.part GROUP BY r, p.part"""


def _update(assigned: str, books: str) -> str:
    return f"""SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM (
      SELECT part, e, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT p.part, a.m.e AS e, unnest(range(1, len(x) + 1)) AS place, unnest(x) AS v FROM p JOIN {assigned} a ON a.r = p.r AND a.part = p.part)
      GROUP BY part, e, place) GROUP BY part, e) n ON n.part = b.part AND n.e = b.e"""


OP13_SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM k, (SELECT unnest(range(0, {PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= {ENTRIES}),
a0 AS MATERIALIZED ({_assign("b0")}),
b1 AS MATERIALIZED ({_update("a0", "b0")}),
a1 AS MATERIALIZED ({_assign("b1")}),
b2 AS MATERIALIZED ({_update("a1", "b1")}),
a2 AS MATERIALIZED ({_assign("b2")}),
f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS digest FROM b2)
SELECT k.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, s.digest AS codebooks_sha256
FROM k JOIN f ON f.r = k.r, s
"""
