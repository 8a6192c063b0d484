from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from math import comb

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
from tidemark.llm.quality_rules import OP11_SQL, RULES, apply_cuts, certified_cuts, measure, most_rejected, op11_quality_rules, quality_rules

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


TEXTS = [None, "", " \n\t ", "a a a a", "a b c a b c", "x y\nx y\n\nx y\r\nx y\r", "# # $ | <b> & * %", "é 🙂 é \xa0   b\x0bc\x0cd", "one", "a b", "\x85 \x1c x", "w " * 40 + "z", " ".join(f"u{i}" for i in range(30000)), "p q r " * 4000]


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)], "doc_id long, text string, measures string")
    got = {r["doc_id"]: tuple(r["_measures"][f] for f in FIELDS) for r in measure(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_binomial_bound_is_exact(spark):
    cases = [(0, 0.01, 0.05), (10, 0.01, 0.05), (299, 0.01, 0.05), (298, 0.01, 0.05), (2000, 0.01, 0.001), (500, 0.2, 0.01), (100_000, 0.01, 0.002)]
    for n, risk, error in cases:
        got = spark.range(1).select(most_rejected(F.lit(n).cast("long"), risk, F.lit(error)).alias("k")).first()["k"]
        if n > 5000:
            assert 0 < got < n * risk
            continue
        p, tail, want = Fraction(str(risk)), Fraction(0), -1
        for k in range(int(n * risk) + 2):
            tail += comb(n, k) * p**k * (1 - p) ** (n - k)
            want = k if tail <= error else want
        assert got == want


def prose(i: int) -> str:
    return " ".join(f"word{(i * 31 + k * 7) % 997}x{k}" for k in range(60))


def corpus(spark, strata=("en", None)):
    """Good prose, a few good texts with symbols, and symbol-ridden bad texts."""
    rows = []
    for s, lang in enumerate(strata):
        for i in range(700):
            mark = "".join(f" #{k}" for k in range(20)) if i < 3 else ""
            rows.append((len(rows), f"{prose(i)} n{s}{mark}", lang, 1))
        rows += [(len(rows) + i, f"{prose(5000 + i)} {s}" + "".join(f" #$%{k}" for k in range(40)), lang, 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t, x) for i, t, x, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")
    return docs, labels


def test_cuts_reject_bad_texts_within_the_bound(spark):
    docs, labels = corpus(spark)
    found = quality_rules(docs, labels, risk=0.1, error=0.1).join(labels, "doc_id").collect()
    bad, good = [r for r in found if r["quality"] == 0], [r for r in found if r["quality"] == 1]
    assert all(not r["kept"] and "symbols" in r["failed_rules"] for r in bad)
    assert sum(not r["kept"] for r in good) <= len(good) * 0.01
    measured = measure(docs)
    cuts = certified_cuts(measured, labels, risk=0.1, error=0.1).collect()
    assert {(r["stratum"], r["rule"]) for r in cuts} >= {("en", "symbols"), (None, "symbols")}
    for r in cuts:
        assert r["cut"] is None or (r["cut"] >= r["proposed"] and r["rejected"] <= r["n"] * 0.02)
    # as strict a risk as these few labels cannot certify: nothing is rejected
    assert all(r["kept"] for r in quality_rules(docs, labels, risk=0.001, error=0.01).collect())


def test_good_texts_stop_a_cut(spark):
    """Good texts of the holdout as full of symbols as the bad ones keep the rule from being certified."""
    docs, labels = corpus(spark, ("en",))
    measured = measure(docs)
    flipped = labels.withColumn("quality", F.when(F.col("doc_id") >= 720, 1).otherwise(F.col("quality")))
    halves = measured.join(flipped, "doc_id").where("doc_id >= 700 AND measures.digest >= '8'").count()
    assert halves > 5
    cuts = certified_cuts(measured, flipped, risk=0.1, error=0.1, price=0)
    assert all(r["rejected"] is None or r["rejected"] <= r["n"] * 0.02 for r in cuts.collect())


def test_edges(spark):
    docs, labels = corpus(spark, ("en",))
    assert quality_rules(docs.limit(0), labels).count() == 0
    none = quality_rules(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["measures"]["base_failed"]) for r in none) and len(none) == docs.count()
    odd = labels.unionByName(spark.createDataFrame([(0, None), (None, 1), (1, 7), (2, 0), (None, None)], "doc_id long, quality int"))
    twice = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None), (None, "a b", "zz")], docs.schema))
    clash = twice.select("*", F.lit(1).alias("measures"), F.lit(2).alias("kept"), F.lit(3).alias("failed_rules"), F.lit(4).alias("_cuts"), F.lit(5).alias("stratum"), F.lit(6).alias("rule"))
    out = quality_rules(clash, odd)
    assert out.columns == [c for c in clash.columns if c != "text"] + ["_measures", "_failed_rules", "_kept"] and out.count() == twice.count()
    assert {r["_failed_rules"][0] for r in out.where("doc_id IS NULL").collect()} == {"base"}
    measured = measure(docs)
    assert all(r["cut"] is None or r["rule"] in RULES for r in certified_cuts(measured, labels).collect())
    assert apply_cuts(measured, certified_cuts(measured, labels.limit(0))).where("kept").count() == docs.count()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    con, sf = duckdb.connect(), f"/root/testdata/{size}"
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(OP11_SQL)
    names = ["doc_id", *FIELDS, "kept", "failed_rules"]
    at = [want.columns.index(c) for c in names]
    got = sorted(tuple(r[c] for c in names) for r in op11_quality_rules(spark, sf).collect())
    assert got == sorted(tuple(r[k] for k in at) for r in want.fetchall())
