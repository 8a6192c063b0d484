"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Rows fall into blocks by a seeded hash; one aggregate counts them, in MOST_BLOCKS parts that add up
   to as many blocks as the rows need.
2. The driver draws the blocks x shards matrix of row counts (multivariate hypergeometric: rows
   sum to block counts, columns to the exact shard sizes). It has MOST_BLOCKS rows at most.
3. Local permutation: rows of a block in seeded random order are cut into runs of the drawn counts.
4. Exchange, and a second permutation: a shard's slots follow a fresh random key; counts per
   (shard, key range) give each range its offset, so no task ever orders a whole shard.

Law "rows": shard sizes differ by one row at most. The main path is DataFrame operations; the
driver's part is the matrix. Edge cases: null text has 0 bytes; rows equal in doc_id, size and
crc32 are interchangeable, so ties cannot change the result; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, literal_table

SHARDS = 16
#: Blocks at least and at most, both powers of two; key ranges of a shard at least; rows that a block or a range should
#: have at most, until there are MOST_BLOCKS blocks.
BLOCKS, MOST_BLOCKS = 1024, 16_384
RANGES = 256
TASK_ROWS = 4_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Exact draw by inversion around the mode; sizes beyond 1e9 are fine, unlike numpy's."""
    lo, hi = max(0, drawn - bad), min(good, drawn)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (total + 2)))
    sd = (drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1))) ** 0.5
    width = int(14 * sd) + 50
    a, b = max(lo, mode - width), min(hi, mode + width)
    k = np.arange(a, b, dtype=np.float64)  # log p(k+1)/p(k)
    step = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    cum = np.cumsum(np.exp(logp - logp.max()))
    return a + int(np.searchsorted(cum, rng.random() * cum[-1], side="right"))


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row counts from each block to each shard, with exact row and column sums."""
    rng = np.random.default_rng(seed)
    total = sum(blocks)
    extra = set(rng.permutation(shards)[: total % shards].tolist())
    left = [total // shards + (s in extra) for s in range(shards)]
    out = []
    for n in blocks:
        row, pool, need = [], sum(left), n
        for s in range(shards):
            c = hypergeometric(rng, left[s], pool - left[s], need)
            row.append(c)
            pool -= left[s]
            need -= c
        left = [x - c for x, c in zip(left, row, strict=True)]
        out.append(row)
    return out


def blocks_for(rows: int) -> int:
    """The least power of two from BLOCKS to MOST_BLOCKS with at most TASK_ROWS rows a block, if there is one."""
    blocks = BLOCKS
    while blocks < MOST_BLOCKS and blocks * TASK_ROWS < rows:
        blocks *= 2
    return blocks


def shuffle_shards(df: DataFrame, key: list[str], *, shards: int = SHARDS, blocks: int | None = None, ranges: int | None = None, seed: int = 23) -> DataFrame:
    """df and, last, shard (0..shards-1) and slot (0.. without gaps in each shard), uniformly shuffled.

    key: columns that tell rows apart; rows equal in all of them are interchangeable. Underscores go before a
    name that df has. A task orders the rows of a block, or of a shard's range; both follow the counted rows unless given."""
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    block, at, ends, shard, slot, range_, offset = (free_name(df, n) for n in ("_block", "_at", "_ends", "shard", "slot", "_range", "_offset"))
    salted = lambda k: F.xxhash64(F.lit(seed * 1000 + k), *[F.col(c) for c in key])
    part = F.pmod(salted(0), F.lit(blocks or MOST_BLOCKS)).cast("int")
    parts = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most MOST_BLOCKS rows
    total = sum(r["n"] for r in parts)
    blocks, ranges = blocks or blocks_for(total), ranges or max(RANGES, -(-total // (shards * TASK_ROWS)))
    counts = dict.fromkeys(range(blocks), 0)
    for r in parts:
        counts[r["part"] % blocks] += r["n"]
    rows = df.withColumn(block, (part % blocks).cast("int"))
    matrix = communication_matrix([counts[b] for b in range(blocks)], shards, seed)
    drawn = literal_table(spark, [{"b": b, "ends": np.cumsum(m).tolist()} for b, m in enumerate(matrix)], "b int, ends array<bigint>")
    drawn = drawn.select(F.struct("b", "ends").alias(ends))

    order = Window.partitionBy(block).orderBy(salted(1), *key)
    placed = rows.withColumn(at, F.row_number().over(order) - 1).join(F.broadcast(drawn), F.col(block) == F.col(ends)["b"])
    placed = placed.withColumn(shard, F.size(F.filter(F.col(ends)["ends"], lambda e: e <= F.col(at))).cast("int"))
    placed = placed.withColumn(range_, F.pmod(salted(2), F.lit(ranges)).cast("int"))
    exchanged = scratch.table(placed.drop(block, at, ends), "exchanged")

    sizes = exchanged.groupBy(F.col(shard).alias("s"), F.col(range_).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("r")) - F.col("n")
    offsets = F.broadcast(sizes.withColumn("before", before).select(F.struct("*").alias(offset)))  # shards * ranges rows
    inner = Window.partitionBy(shard, range_).orderBy(salted(3), *key)
    out = exchanged.withColumn(at, F.row_number().over(inner) - 1)
    out = out.join(offsets, (F.col(shard) == F.col(offset)["s"]) & (F.col(range_) == F.col(offset)["r"]))
    return out.withColumn(slot, (F.col(offset)["before"] + F.col(at)).cast("long")).drop(offset, at, range_)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shuffle_shards(rows, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
