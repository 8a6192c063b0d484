from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm.common import Scratch
from tidemark.llm.components import components, local_stars


def brute(edges):
    label = {x: x for e in edges for x in e}
    while True:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
        if not changed:
            return label


@pytest.mark.parametrize("seed", [0, 1])
def test_random_chain_star(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (160, 2)) if e[0] != e[1]]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)] + [(-3, 9000)]
    frame = spark.createDataFrame([edges[i] for i in rng.permutation(len(edges))] + [(7, 7)], "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components(frame, Scratch(spark, "t")).collect()}
    assert got == brute(edges)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_local_stars():
    v, p = local_stars(np.array([1, 2, 9]), np.array([2, 3, 8]))
    assert dict(zip(v, p)) == {2: 1, 3: 1, 9: 8}
