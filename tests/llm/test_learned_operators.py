from __future__ import annotations

import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
from tidemark.llm import embedding_dedup as E
from tidemark.llm import quality as Q
from tidemark.llm.embedding_dedup import near_duplicates, op1_embedding_dedup
from tidemark.llm.html_blocks import blocks_of
from tidemark.llm import html_extract as H
from tidemark.llm.html_extract import block_vectors, entry_slots, extract, main_texts, op8_html_extract, padded, trained, training_page
from tidemark.llm.html_pages import PageMaker
from tests.llm.test_components import brute


def embedding_truth(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    unit = {i: ok[i] / np.linalg.norm(ok[i]) for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(ok[a]) == len(ok[b]) and unit[a] @ unit[b] >= threshold]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    label = brute(links)
    return {i: (n[i], label.get(i, i)) for i, _ in rows}, len(links)


def test_embedding_recall_at_spread_similarities(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(120):
        base = rng.standard_normal(48)
        base /= np.linalg.norm(base)
        for _ in range(5):
            other = rng.standard_normal(48)
            other -= (other @ base) * base
            c = np.sqrt(rng.uniform(0.88, 1.0))
            v = c * base + np.sqrt(1 - c * c) * other / np.linalg.norm(other)
            rows.append((len(rows), (v * rng.uniform(0.5, 3)).tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    truth, links = embedding_truth(rows)
    got = {r["vec_id"]: r for r in near_duplicates(frame).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert 0.97 * 2 * links <= found <= 2 * links
    assert all(got[i]["n_links"] <= truth[i][0] for i in got)
    assert np.mean([got[i]["component_id"] == truth[i][1] for i in got]) > 0.95


def test_embedding_links_across_hundreds_of_lists(spark, monkeypatch):
    """Alike vectors with links close to the threshold: their ends often lie in lists far down each other's order."""
    monkeypatch.setattr(E, "LIST_ROWS", 8)
    monkeypatch.setattr(E, "BLOCK", 700)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2400, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.sqrt(0.2) * x
    x[:, 0] += np.sqrt(0.8)
    rows = list(enumerate(x.tolist()))
    assert len(E.Quantiser(x, len(rows)).centroids) >= 256
    truth, links = embedding_truth(rows)
    assert links > 1000
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(n for n, _ in got.values()) == 2 * links
    assert got == truth


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.001]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, float("inf")]), (11, [-1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    truth, _ = embedding_truth(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(frame).collect()}
    assert got == truth
    assert near_duplicates(frame.limit(0)).count() == 0


def test_embedding_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    truth, _ = embedding_truth(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op1_embedding_dedup(spark, sf).collect()}
    assert got == truth


def test_chain_equals_enumeration():
    rng = np.random.default_rng(1)
    e, change = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    p, pairs, z = Q.chain(e, np.array([4]), change)
    scores, marks = [], []
    for m in range(16):
        y = [(m >> k) & 1 for k in range(4)]
        scores.append(sum(e[0, t] * y[t] for t in range(4)) + sum(change[y[t], y[t + 1]] for t in range(3)))
        marks.append(y)
    w = np.exp(np.array(scores))
    assert z[0] == pytest.approx(np.log(w.sum()))
    np.testing.assert_allclose(p[0], (w[:, None] * np.array(marks)).sum(0) / w.sum())
    assert pairs.sum() == pytest.approx(3)


def test_embedding_extremes_and_repeated_ids(spark):
    huge, tiny = [1e200, 1e200, 0.0], [1e-200, 1e-200, 1e-220]
    rows = [(1, huge), (2, tiny), (3, [1.0, 1.0, 0.0]), (4, [0.0, 0.0, 1e-300]), (5, [0.0, 0.0, -1.0]), (6, [0.0, 0.0, 5e-324]), (7, [1.0, float("inf"), 0.0]), (8, [1.0, None, 0.0]), (9, [])]
    frame = spark.createDataFrame(rows + [(10, [0.0, 0.0, -2.0]), (10, [0.0, 0.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(frame).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 4), (5, 1, 5), (6, 2, 4), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 5), (10, 2, 4)]


def test_quality_reads_whole_words_lines_and_texts(spark, monkeypatch):
    long = b"x" * 16
    assert Q.word_slots(long + b"tail-one-aaa") != Q.word_slots(long + b"tail-two-aaa")
    rng = np.random.default_rng(4)
    field = Q.Field(*rng.standard_normal((3, Q.FEATURES)) * 0.3, rng.standard_normal((2, 2)))
    texts = ["\n".join(" ".join(rng.choice(["a", "bb", "ccc", "9"], 5)) for _ in range(n)) for n in (1, 2, 7, 40)]
    whole = [field.marginals(Q.lines_of(t)) for t in texts]
    # neighbours' features count, the ends have one neighbour
    x = Q.line_features(Q.lines_of(texts[2]))
    e = x @ field.own
    e[1:] += x[:-1] @ field.before
    e[:-1] += x[1:] @ field.after
    assert np.allclose(whole[2], Q.chain(e[None, :], np.array([7]), field.change)[0][0])
    lined = [Q.lines_of(t) for t in texts]
    parts = np.concatenate([Q.line_features(x) for x in lined]) @ field.weights()
    n = np.array([len(x) for x in lined])
    split = np.split(Q.emissions(parts, n), n.cumsum()[:-1])
    assert np.allclose(split[3], Q.emissions(Q.line_features(lined[3]) @ field.weights(), n[3:]))
    monkeypatch.setattr(Q, "LINES", 3)
    for t, w in zip(texts, whole, strict=True):
        assert np.allclose(field.marginals(Q.lines_of(t)), w)
    y = [0, 1, 0, 1]
    again = Q.fit(texts, y, rounds=2)
    monkeypatch.setattr(Q, "KEPT", 0)
    assert np.allclose(Q.fit(texts, y, rounds=2).own, again.own)


def test_quality_names_that_clash_and_sample_bound(spark, monkeypatch):
    rows = [(i, "good words here\nand there" if i % 2 else "$$$ ### 111", 7, 7, 7, 7, "h") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted int, _id int, _y int, hash string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = Q.classify(docs, labels)
    assert got.columns == [*docs.columns, "_score", "_predicted"] and got.where("score = 7 and predicted = 7").count() == 40
    assert got.where("_predicted = doc_id % 2").count() == 40
    monkeypatch.setattr(Q, "SAMPLE_SIZE", 600)  # two or three documents a label
    assert Q.classify(docs, labels).where("_predicted = doc_id % 2").count() == 40


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op3_quality(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert got["held_out"].tolist() == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert np.mean([(good > b).mean() for b in bad]) > 0.9
    assert ((held.score >= 0.3) == (held.predicted == 1)).all() and (held[held.quality == 1].predicted == 1).mean() > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a\n" * 3000, 5), (4, "x" * 50000, 5)], "doc_id long, text string, predicted_by int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in Q.classify(docs, none).collect()}
    assert len(got) == 4 and {r["score"] for r in got.values()} == {0.5}
    assert Q.classify(docs.limit(0), none).count() == 0
    assert Q.classify(docs, spark.createDataFrame([(1, 1), (3, 0), (2, None)], "doc_id long, quality int")).where(F.col("score").between(0, 1)).count() == 4


def test_blocks():
    html = "<body><p>a &amp; b<p>c<br>d  <b>e</b></p><ul><li>x<li>y</ul><!-- <p>no</p> --><script>if (a<b) '<p>'</script><a href='>'>l</a> t <textarea>q"
    assert [b.text for b in blocks_of(html)] == ["a & b", "c d e", "x", "y", "l t"]
    assert blocks_of("") == [] and [b.text for b in blocks_of("plain &lt; text")] == ["plain < text"]


def test_unclosed_and_nested_elements_hide_nothing_else():
    text = lambda html: [b.text for b in blocks_of(html)]
    for tag in ("svg", "noscript", "object", "iframe", "template"):
        assert text(f"<article><p>one</p><{tag}><p>two</p></article><p>three</p>") == ["one", "two", "three"]
        inside = ["x", "y", "z"] if tag in ("noscript", "object") else []  # what these hold may be the article's
        assert text(f"<p>one</p><{tag} a=b><p>x</p><{tag}>y</{tag}><p>z</p></{tag}><p>two</p>") == ["one", *inside, "two"]
        assert text(f"<p>one<{tag}/>two</p>") == ["onetwo"]
    assert text("<p>a</p><script>b<p>c") == ["a"] and text("<p>a</p><!-- b <p>c") == ["a"] and text("<p>a <!-- b") == ["a"]
    assert text("<p>a</p><!--><p>b</p>") == ["a", "b"] and text("<p>a</p><!---><p>b</p><!-- c --><p>d</p>") == ["a", "b", "d"]
    assert text("<p>a</p><!----><p>b</p><!-- > --><p>c</p><!--") == ["a", "b", "c"]
    assert text("<p>a<b><i>b</b><p>c</i></p><div>d<li>e</div>f") == ["ab", "c", "d", "e", "f"]


def test_long_and_deep_pages_take_linear_time_and_bounded_memory():
    model, start = trained(), time.time()
    deep = main_texts(model, ["<article>" + "<b><p>word and more.</p>" * 20_000, "<a " * 200_000, "<svg>" * 20_000, "</b>" * 20_000 + "<b>" * 20_000])
    assert deep[0].count("\n") == 19_999 and time.time() - start < 60
    blocks = blocks_of("<article>" + "".join(f"<p class=c{i}>{'w ' * (i % 90)}." for i in range(300)), entry_slots)
    whole = trained().logits(*padded([block_vectors(blocks)]))[0]
    x = block_vectors(blocks_of("".join(f"<p>{'a ' * 70}{w}" for w in ("one two three", "four five six")) + "".join("<p>" + " ".join("long" * 9 + c for c in w) for w in ("abc", "def"))))
    assert (x[0] != x[1])[384:416].any() and (x[2] != x[3])[384:416].any()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(H, "LONG", 64)
        assert np.allclose(trained().page_logits(blocks), whole, atol=1e-4)


def test_labeller_on_new_generated_pages():
    maker, model, right, n = PageMaker(4242), trained(), 0, 0
    for _ in range(60):
        x, y = training_page(maker)
        if len(x):
            right += int(((model.logits(*padded([x]))[0] > 0) == (y > 0)).sum())
            n += len(y)
    assert right / n > 0.98


def test_extraction_equals_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op8_html_extract(spark, sf).collect():
        body = re.search(r"<article[^>]*>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_extraction_edges(spark):
    pages = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (3, "<article><p>" + "w " * 20000, "m"), (4, "<<<>>>&&", "m")], "page_id long, html string, text string")
    got = {r["page_id"]: r["main_text"] for r in extract(pages).collect()}
    assert got[1] == got[2] == "" and len(got) == 4
    assert extract(pages.limit(0)).count() == 0
    clash = extract(pages.withColumnRenamed("text", "main_text"))
    assert clash.columns == ["page_id", "html", "main_text", "_main_text"] and clash.where("main_text = 'm'").count() == 4
