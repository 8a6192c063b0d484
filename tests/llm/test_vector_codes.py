from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm.gnat import Gnat, squared
from tidemark.llm.vector_codes import OP13_SQL, bound, compress_vectors, op13_vector_codes

FIELDS = ("code", "error", "label_error", "codebooks_sha256")


def brute(rows: list[tuple], parts: int = 16, entries: int = 64, rounds: int = 2) -> list[tuple]:
    """The stated rule, loop by loop."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = parts * max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    most = bound(width)
    vectors = [[max(-most, min(most, math.floor(min(max(256 * float(x), -2e30), 2e30)))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, vectors[k]))[:entries]
    d = width // parts
    own = lambda k, p: vectors[k][p * d : (p + 1) * d]
    books = [[own(k, p) for k in order] for p in range(parts)]

    def assign(k, p):
        return min((sum((a - b) ** 2 for a, b in zip(own(k, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = defaultdict(list)
            for k in range(len(kept)):
                held[assign(k, p)[1]].append(own(k, p))
            new.append([[sum(x) // len(held[e]) for x in zip(*held[e], strict=True)] if e in held else c for e, c in enumerate(books[p])])
        books = new
    found = [[assign(k, p) for p in range(parts)] for k in range(len(kept))]
    errors = [sum(x for x, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), x, min(by_label[label], 2**63 - 1), digest) for (i, _, label), f, x in zip(kept, found, errors, strict=True)]


def values(df) -> list[tuple]:
    return sorted(((-1 if r[0] is None else r[0], *(r[f] for f in FIELDS)) for r in df.collect()))


@pytest.mark.parametrize(("n", "d", "spread"), [(1, 3, 5), (2, 1, 1), (64, 4, 3), (64, 4, 2000), (200, 2, 12), (256, 7, 1 << 26)])
def test_gnat_is_exact_with_ties_and_equal_entries(n, d, spread):
    rng = np.random.default_rng(n + d)
    entries = rng.integers(-spread, spread + 1, (n, d))
    queries = np.concatenate([rng.integers(-spread, spread + 1, (3000, d)), entries])
    for degree, leaf in ((6, 6), (2, 1), (3, 9)):
        tree = Gnat(entries, degree, leaf)
        index, best = tree.nearest(queries)
        want = squared(queries, entries)
        assert (index == want.argmin(1)).all() and (best == want.min(1)).all()
        if spread == 2000:
            assert tree.measured < 0.8 * want.size  # whole subtrees were left out
    assert len(Gnat(entries).nearest(queries[:0])[0]) == 0


def test_gnat_of_equal_entries():
    index, best = Gnat(np.zeros((40, 3), int)).nearest(np.ones((5, 3), int))
    assert index.tolist() == [0] * 5 and best.tolist() == [3] * 5


def test_edges_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 32)], int(i % 3) if i % 4 else None) for i in rng.permutation(90)]
    rows += [(3, rows[0][1], 1), (None, rows[1][1], None), (200, None, 1), (201, [1.0, None], 1), (202, [math.nan] * 32, 1), (203, [math.inf] * 32, 1), (204, [], 9), (205, [1e300, -1e300], 9), (-7, [0.5] * 30, 2)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    assert values(compress_vectors(df)) == sorted((-1 if i is None else i, *x) for i, *x in brute(rows))
    few = rows[:5]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>, label int")
    assert values(compress_vectors(df)) == sorted(brute(few))
    assert values(compress_vectors(df, parts=4, entries=3, rounds=1)) == sorted(brute(few, 4, 3, 1))
    assert compress_vectors(df.limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(OP13_SQL)
    at = [want.columns.index(c) for c in ("vec_id", *FIELDS)]
    assert values(op13_vector_codes(spark, sf)) == sorted(tuple(r[k] for k in at) for r in want.fetchall())
