from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tidemark.llm")
from tidemark.llm.packing import best_fit_decreasing, op5_packing, pack
from tidemark.llm.tokens import default_vocabulary


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 40))
def test_moves_equal_one_at_a_time_best_fit(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    moves, bins = best_fit_decreasing(histogram, capacity)
    order = sorted(lengths, reverse=True)
    room = [capacity] * bins
    for k, (rank, length, first, offset, each) in enumerate(moves.tolist()):
        end = moves[k + 1, 0] if k + 1 < len(moves) else len(order)
        for i in range(rank, end):
            assert order[i] == length
            b, slot = divmod(i - rank, each)
            assert capacity - room[first + b] == offset + slot * length
            room[first + b] -= length
    assert sorted(room) == plain_best_fit(lengths, capacity)


def check(rows, docs, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    want = {}
    for doc, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), capacity):
            own = np.array(ids[p : p + capacity], "<u4")
            want.setdefault((doc, p // capacity, p, len(own), zlib.crc32(own.tobytes())), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(1)
    assert got == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == len(plain_best_fit([r["length"] for r in rows], capacity))


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op5_packing(spark, sf).collect(), docs, 2048)


def test_edge_cases(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (4, ""), (5, "word " * 300), (6, "<|endoftext|> it's ÀÉ x")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, rank int, length int")
    check(pack(docs, capacity=64).collect(), rows, 64)
    assert pack(docs.limit(0)).count() == 0


def test_ids_equal_the_library(monkeypatch):
    import random

    from tokenizers import Tokenizer

    from tidemark.llm import tokens as T

    r = random.Random(2)
    alphabet = ["a", "B", "é", "ß", "İ", "Σ", "\u0301", "5", ",", ".", "'s", "'", "-", " ", " ", "\n", "\t", "\u00a0", "\u2009", "😀", "中", "\0", "ok", "the", "H\u0331", "<|startoftext|>", "<|StartOfText|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(600)]
    texts += ["", " ", "x " * 4000 + "yy", "q" * 9000 + " z" * 10, "don,t; a. b.. c., (d) e) it's,", "sixteenletterswo sixteenlettersworseventeen", "a" * 17, "a" * 16]
    path = T.default_vocabulary()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    for piece, cache in ((2_000_000, 400_000), (50, 60)):
        monkeypatch.setattr(T, "PIECE", piece)
        monkeypatch.setattr(T, "CACHE_WORDS", cache)
        encode = T.Encoder(path)
        for at in range(0, len(texts), 100):
            got = [np.frombuffer(b, "<u4").tolist() for b in encode(texts[at : at + 100])]
            assert got == want[at : at + 100]
