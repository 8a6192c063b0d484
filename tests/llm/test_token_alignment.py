from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm.token_alignment import Aligner, align_tokenizers, default_paths, merge_cuts, op12_alignment, overlaps, token_groups
from tidemark.llm.token_tables import CUT, Pair

PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "日本", "🙂", "1", "23", ".", ",", "▁", "<s>", "<|endoftext|>", "\xa0", "\x00", "the", "<0x41>", "\r\n", "ﬁ", "\x85", "İ"]


@pytest.fixture(scope="module")
def pair():
    return Pair(*default_paths())


def plain(pair: Pair, text: str | None) -> tuple[list[int], list[int]]:
    """Ids straight from the two libraries."""
    text = text or ""
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    same = text and b"".join(pair.a_bytes[i] for i in a) == raw == b"".join(pair.b_bytes[i] for i in b)
    return (a, b) if same else ([], [])


def plain_groups(pair: Pair, a: list[int], b: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """Groups and links, token by token."""
    ends_a = np.cumsum([len(pair.a_bytes[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(pair.b_bytes[i]) for i in b]).tolist()
    at_a, at_b = defaultdict(list), defaultdict(list)
    common = np.array(sorted({*ends_a} & {*ends_b}))
    for ids, ends, at in ((a, ends_a, at_a), (b, ends_b, at_b)):
        for i, k in zip(ids, np.searchsorted(common, ends).tolist() if len(ends) else [], strict=True):
            at[k].append(str(i))
    out = [",".join(at_a[k]) + "|" + ",".join(at_b[k]) for k in range(len(common))]
    links = [(int(at_a[k][-1]), int(at_b[k][-1])) for k in range(len(common))]  # no token is empty: one ends there on each side
    return ";".join(out), links


def brute(pair: Pair, texts: list[str | None]) -> list[tuple]:
    docs = [plain(pair, t) for t in texts]
    groups = [plain_groups(pair, a, b) for a, b in docs]
    count = Counter(link for _, links in groups for link in links)
    most: dict[int, int] = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [
        (len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for (a, b), (g, links) in zip(docs, groups, strict=True)
    ]


def values(rows) -> list[tuple]:
    return sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_merge_path_finds_all_overlaps_whatever_the_pieces(piece):
    rng = np.random.default_rng(piece)
    for _ in range(60):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(0, 40))) for _ in range(2))
        i, j = overlaps(a, b, piece)
        assert a[i].tolist() == b[j].tolist() == sorted({*a.tolist()} & {*b.tolist()})
        ci, cj = merge_cuts(a, b, piece)
        steps = np.diff(ci + cj)
        assert ci[0] == cj[0] == 0 and (ci[-1], cj[-1]) == (len(a), len(b)) and (steps <= piece + 1).all() and (np.diff(ci) >= 0).all() and (np.diff(cj) >= 0).all()


def test_chunks_have_the_ids_of_the_text(pair):
    text = "The word, its 12 ends  and\n more's. " * 40 + "x" * 50 + " é ü " * 9
    assert len(CUT.split(text)) > 5
    for texts in ([text], [text, "", "The word,", "▁ no", text[7:]], ["\x00", text]):
        a, b, n_a, n_b = pair.encode(texts)
        want = [plain(pair, t) for t in texts]
        assert a.tolist() == [i for x, _ in want for i in x] and b.tolist() == [i for _, x in want for i in x]
        assert n_a.tolist() == [len(x) for x, _ in want] and n_b.tolist() == [len(x) for _, x in want]


def test_full_cache_starts_anew(pair, monkeypatch):
    monkeypatch.setattr("tidemark.llm.token_tables.CACHE_CHUNKS", 5)
    for k in range(9):
        text = " ".join(f"w{k}{i}" for i in range(4))
        assert pair.encode([text])[0].tolist() == plain(pair, text)[0]


def test_fast_ids_below_u3000(pair):
    assert pair.fast is not None
    for c in map(chr, range(0x3000)):
        for s in ("a" + c + "b", " " + c, c + " " + c + "1", c + "'s", "  " + c + "  x"):
            assert pair.fast.encode_ordinary(s) == pair.a.encode(s, add_special_tokens=False).ids, (c, s)


def test_groups_of_hostile_texts(pair):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(30))) for _ in range(400)] + ["", "▁", " ", "w " * 9000]
    align = Aligner(*default_paths(), piece=37)
    got = align(texts)
    want = [plain_groups(pair, *plain(pair, t))[0] for t in texts]
    assert [g.decode() for g in got["groups"]] == want and any(want)
    assert got["n_links"].tolist() == [len(w.split(";")) if w else 0 for w in want]


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_edges_equal_brute_force(spark, pair, hot):
    texts = ["one two two", None, "", "▁", "one two two", "the <s> the\n\nthe", "é" * 300, " lead and  double ", "x " * 3000]
    ids = [1, 2, 3, 4, 1, None, 7, 8, 9]
    docs = spark.createDataFrame(list(zip(ids, texts, ["own"] * 9, [5] * 9, strict=True)), "doc_id long, text string, pairs string, row int").repartition(3)
    got = align_tokenizers(docs, hot_pairs=hot).collect()
    want = [(-1 if i is None else i, *row) for i, row in zip(ids, brute(pair, texts), strict=True)]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted((i, *w) for i, *w in want)
    assert align_tokenizers(docs.limit(0)).count() == 0
    named = {r["id"]: r["groups"] for r in token_groups(docs.where("doc_id > 1")).collect()}
    assert named[2] == named[3] == named[4] == "" and named[8] == plain_groups(pair, *plain(pair, texts[7]))[0]


def test_query_equals_brute_force(spark, sf, pair):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], *w) for r, w in zip(rows, brute(pair, [r["text"] for r in rows]), strict=True))
    assert values(op12_alignment(spark, sf).collect()) == want
