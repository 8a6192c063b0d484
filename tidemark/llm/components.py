"""Connected components of a link table by repeated local contraction.

A round joins what it can inside each task (union-find over the task's links), which leaves a
star per local group; each member keeps its smallest centre and the other centres become links of
the next, much smaller round. Members are renamed from the last round back to the first. No round
gathers a component in one task: hot members only meet in partial aggregates and plain joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TASK_LINKS = 500_000


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """(member, smallest member of its group), centres left out."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    members = [x for x in parent if parent[x] != x]
    return members, [find(x) for x in members]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        v, p = local_stars(t.column(0).to_numpy(), t.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(p, pa.int64())], ["v", "p"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TASK_LINKS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a long, b long) -> (node, component) for every linked node; component is the smallest node."""
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    rounds: list[DataFrame] = []
    while True:
        stars = scratch.table(edges.withColumn("key", F.least("a", "b")).hint("rebalance", "key").select("a", "b").mapInArrow(_contract, "v long, p long"), "stars")
        centres = stars.select(F.col("p").alias("c")).distinct()
        chosen = stars.groupBy("v").agg(F.min("p").alias("q"))
        chosen = scratch.table(chosen.join(centres, F.col("v") == F.col("c"), "left"), "chosen")
        # members that are no one's centre are done: they follow q. Centres meet again next round.
        rounds.append(chosen.where("c IS NULL").select("v", "q"))
        between = stars.join(chosen.select(F.col("v").alias("w"), "q"), F.col("v") == F.col("w")).where("p <> q")
        above = chosen.where("c IS NOT NULL")
        edges = scratch.table(between.select(F.col("p").alias("a"), F.col("q").alias("b")).unionByName(above.select(F.col("v").alias("a"), F.col("q").alias("b"))).distinct(), "links")
        if not edges.head(1):
            break
    names = rounds.pop().select(F.col("v").alias("node"), F.col("q").alias("component"))
    while rounds:
        later = names.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        earlier = rounds.pop().join(later, F.col("q") == F.col("_n"), "left").select(F.col("v").alias("node"), F.coalesce("_c", "q").alias("component"))
        names = scratch.table(earlier.unionByName(names), "names")
    smallest = names.select(F.col("component").alias("node"), "component").distinct()
    return scratch.table(names.unionByName(smallest), "components")
