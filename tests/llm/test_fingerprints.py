from __future__ import annotations

import hashlib

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm.fingerprints import BITS, compared_with_next, fingerprint, likeness, op7_fingerprints, within_radius


def brute(docs):
    out = {}
    docs = sorted(docs)
    for i, (doc, text) in enumerate(docs):
        nxt, n = docs[(i + 1) % len(docs)][1] or "", len(text or "")
        edited = (text or "")[: n - n // 2] + nxt[: n // 2]
        f, e, g = fingerprint(text or ""), fingerprint(edited), fingerprint(nxt)
        out[doc] = (n, hashlib.sha256(edited.encode()).hexdigest(), f.hex(), e.hex(), likeness(f, e), likeness(f, g))
    return out


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op7_fingerprints(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == brute(docs)
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    for r in rows:
        want = sum((prints[r["doc_id"]] ^ p).bit_count() <= 3 for p in prints.values()) - 1 if r["doc_id"] % 100 == 0 else None
        assert r["n_within"] == want
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows if r["n_chars"] > 200]) > 0.9


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "é b c d"), (4, "x " * 5000)]
    frame = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, bucket string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in compared_with_next(frame).collect()}
    assert got == brute([(d, t or "") for d, t in docs])
    assert compared_with_next(frame.limit(0)).count() == 0
    assert len(compared_with_next(frame.where("doc_id = 3")).collect()) == 1


def test_radius_search_finds_all(spark):
    rng = np.random.default_rng(0)
    base = [int.from_bytes(rng.bytes(BITS // 8), "big") for _ in range(20)]
    prints = []
    for b in base:
        for k in range(6):
            flip = sum(1 << int(i) for i in rng.choice(BITS, size=k, replace=False))
            prints.append(f"{b ^ flip:0{BITS // 4}x}")
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {r["_q"]: r["n_within"] for r in within_radius(frame, frame).collect()}
    for p in prints:
        assert got[p] == sum((int(p, 16) ^ int(q, 16)).bit_count() <= 3 for q in prints)


def test_radius_search_is_complete_at_any_radius(spark):
    rng = np.random.default_rng(1)
    base = [int.from_bytes(rng.bytes(BITS // 8), "big") for _ in range(15)]
    prints = [f"{b ^ sum(1 << int(i) for i in rng.choice(BITS, size=k, replace=False)):0{BITS // 4}x}" for b in base for k in (0, 0, 5, 10, 19, 20, 21, 30)]
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    for radius in (0, 1, 9, 20, 23):
        got = {r["_q"]: r["n_within"] for r in within_radius(frame, frame, radius=radius).collect()}
        assert got == {p: sum((int(p, 16) ^ int(q, 16)).bit_count() <= radius for q in prints) for p in prints}


def test_near_copies_are_found_and_named(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for k in range(30):
        text = [words[i] for i in rng.integers(0, len(words), 200)]
        copy = list(text)
        for at in rng.choice(200, 4, replace=False):  # two words of a hundred
            copy[at] = words[rng.integers(len(words))]
        docs += [(100 * k, " ".join(text)), (100 * k + 1, " ".join(copy)), (100 * k + 2, " ".join(words[i] for i in rng.integers(0, len(words), 200)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op7_fingerprints(spark, str(tmp_path)).collect()}
    for k in range(30):
        assert rows[100 * k]["n_near"] == 1 and rows[100 * k + 1]["near_query"] == 100 * k
        assert rows[100 * k + 2]["near_query"] is None and rows[100 * k + 1]["n_near"] is None


def test_repeated_rows_and_null_ids(spark):
    docs = [(None, "a b c d"), (None, "a b c d"), (1, "e f g"), (1, "e f g"), (1, "h"), (2, "a b c d")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = compared_with_next(frame).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"], r["fingerprint"]) for r in rows) == sorted((d or 0, len(t), fingerprint(t).hex()) for d, t in docs)
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == 7}) == 1


def test_votes_are_exact_in_any_order(monkeypatch):
    from tidemark.llm import fingerprints as M

    text = " ".join(f"w{i % 700} w{i * 7 % 9001}" for i in range(20_000))
    want = fingerprint(text)
    for rows in (1, 7, 1000):
        monkeypatch.setattr(M, "WEIGHT_ROWS", rows)
        assert fingerprint(text) == want
