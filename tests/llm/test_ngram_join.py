from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import ngram_join as N
from tests.llm.test_components import brute


def sets(docs, k):
    out = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


def want(docs, k, percent):
    s = sets(docs, k)
    ids = sorted(s)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    label = brute(links)
    ends = [x for link in links for x in link]
    return {d: (len(s[d]), label.get(d, d), ends.count(d)) for d in ids}


def corpus(seed, groups=12, size=9, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(55)]
    docs, d = [], 0
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(8, words))] + (passage if r.random() < 0.4 else [])
        for _ in range(r.randint(1, size)):
            copy = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            docs.append((d, r.choice((" ", "  ", "\n")).join(copy)))
            d += 1
    return docs


def found(frame, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in N.jaccard_components(frame, **options).collect()}


@pytest.mark.parametrize(("seed", "k", "percent", "most"), [(1, 4, 85, 12), (2, 5, 80, 1024), (3, 2, 60, 12)])
def test_links_and_components_equal_brute_force(spark, monkeypatch, seed, k, percent, most):
    monkeypatch.setattr(N, "FREQUENT", 6)  # so that combinations are used on small data
    monkeypatch.setattr(N, "MOST_FREQUENT", most)
    docs = corpus(seed) + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, " \n"), (905, "a b"), (906, "x " * 3000)]
    frame = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, node string")
    assert found(frame, words=k, percent=percent) == want(docs, k, percent)


@pytest.mark.parametrize("counts", [True, False])
def test_one_large_near_group_in_many_blocks(spark, monkeypatch, counts):
    monkeypatch.setattr(N, "FREQUENT", 6)
    monkeypatch.setattr(N, "MOST_FREQUENT", 20)
    monkeypatch.setattr(N, "LIST_BLOCK", (16, 100_000))
    monkeypatch.setattr(N, "GROUP_BLOCK", (8, 100_000))
    docs = corpus(5, groups=2, size=60, words=50)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    expected = want(docs, 4, 85)
    if counts:
        assert found(frame, words=4, percent=85) == expected
    else:
        got = N.jaccard_components(frame, words=4, percent=85, count_links=False)
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: v[1] for d, v in expected.items()}


@pytest.mark.parametrize("percent", [50, 60, 67, 80, 85, 95])
@pytest.mark.parametrize("shares", [(0, 1, 0), (0, 0, 1), (0.1, 0.5, 0.4)])
def test_linked_sets_share_a_signature(percent, shares):
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        n = int(rng.integers(2, 60))
        universe = rng.integers(0, 1 << 63, 3 * n, dtype=np.int64).astype(np.uint64)
        kind = rng.choice(3, size=len(universe), p=shares)
        frequent, most = np.sort(universe[kind > 0]), np.sort(universe[kind == 2])
        a = universe[:n]
        drop, add = rng.integers(0, n // 2 + 1), rng.integers(0, n // 2 + 1)
        b = np.concatenate([rng.permutation(a)[drop:], universe[n : n + add]])
        common = len(np.intersect1d(a, b))
        if drop + add == 0 or 100 * common < percent * (len(a) + len(b) - common):
            continue
        x, y = (set(N.signatures(np.sort(s), frequent, most, percent)[0].tolist()) for s in (a, b))
        assert x & y


def test_common_counts_and_sketches():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    sets_ = [np.sort(rng.choice(universe, size=int(rng.integers(1, 200)), replace=False)) for _ in range(60)]
    common = N.common_counts(sets_)
    linked = N.sketch_linked(np.array([len(s) for s in sets_]), [N.parity(s, N.sketch_bits(len(s))) for s in sets_], 40)
    for i, a in enumerate(sets_):
        near = linked(i, np.arange(60))
        for j, b in enumerate(sets_):
            both = len(np.intersect1d(a, b))
            assert j <= i or common[i, j] == both
            assert near[j] or 100 * both < 40 * (len(a) + len(b) - both)


def test_empty_repeated_and_null_ids(spark):
    frame = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (0, "q"), (5, "r"), (5, "a b c d e f"), (7, ""), (8, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["n_links"]) for r in N.jaccard_components(frame, words=4, percent=60).collect())
    assert got == [("0", 1, 0, 0), ("1", 2, 1, 2), ("1", 2, 1, 2), ("5", 1, 5, 0), ("5", 3, 1, 2), ("7", 0, 7, 0), ("8", 0, 8, 0), ("None", 2, None, 0)]
    assert N.jaccard_components(frame.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "y"), (None, "a b c d e", "z"), (0, "q", "x"), (None, "s t", "x"), (None, "s t", "x"), (3, "A b  c d e", "x"), (7, "", "x"), (8, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _key string").withColumnRenamed("_key", "_gone")
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in N.drop_near_copies(frame).collect())
    assert got == [("0", "q"), ("1", "a b c d e"), ("7", ""), ("8", ""), ("None", "s t")]
    assert N.drop_near_copies(frame).columns == frame.columns
    assert N.drop_near_copies(frame.limit(0)).count() == 0


def test_long_shingles(spark):
    docs = corpus(9, groups=4, size=4, words=40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(frame, words=9, percent=60) == want(docs, 9, 60)
    with pytest.raises(ValueError, match="words"):
        N.shingle_set("a b", 65)


def test_links_of_large_sets_are_compared_in_integers():
    """Sets whose counts single precision cannot tell apart: at the threshold, and one word short of it."""
    whole = np.arange(2_000_000, dtype=np.uint64)
    for common, linked in ((1_700_000, True), (1_699_999, False)):
        part = whole[:common]
        got = N.set_links(np.array([len(whole), len(part)]), [whole.tobytes(), part.tobytes()], 85)
        assert got[0, 1] == got[1, 0] == linked and not got[0, 0]
