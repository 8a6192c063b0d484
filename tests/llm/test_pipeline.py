from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from tidemark.llm.quality import is_held_out, lines_of, train
from tests.llm.test_native_operators import fill, plain_redact
from tests.llm.test_ngram_join import want
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Every stage's rows, in order, from the whole table with extra columns of clashing names."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(-1, None, "en", "odd", 0), (-2, "", "en", "odd", 0), (-3, " \n", "en", None, 2), (-4, "x", "en", "odd", 1), (-4, "x", "en", "odd", 1)], docs.schema)
    docs = docs.unionByName(more).withColumns({n: F.lit("own") for n in ("score", "predicted", "secret_spans", "copies", "size", "_copy", "_key", "_gone", "rank")})
    out = [docs.collect()]
    docs.write.parquet(f"{folder}/0")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, spark.read.parquet(f"{folder}/{k}"), sf).write.parquet(f"{folder}/{k + 1}")
        got = spark.read.parquet(f"{folder}/{k + 1}")
        if k < len(pipeline.STAGES) - 1:
            assert got.columns == docs.columns and got.where("score <> 'own' or copies <> 'own' or _key <> 'own'").isEmpty()
        out.append(got.collect())
    return out


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_quality_keeps_what_the_field_accepts(spark, sf, stages):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = train(docs, labels)
    good = lambda r: field.score(field.quality(lines_of(r["text"] or ""))) >= 0.3
    assert ids(stages[1]) == ids(filter(good, stages[0]))
    held = {r["doc_id"]: r["quality"] for r in labels.where(is_held_out("doc_id")).collect()}
    kept = ids(stages[1])
    assert sum(d in kept for d, q in held.items() if q == 1) > 0.95 * sum(q == 1 for q in held.values())


def test_one_of_each_group_of_near_copies_stays(stages):
    rows = sorted(stages[1], key=lambda r: r["doc_id"])
    label = want([(i, r["text"]) for i, r in enumerate(rows)], 5, 80)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(label[i][1] if label[i][0] else (r["doc_id"], r["text"]), r["doc_id"])
    assert ids(stages[2]) == Counter(first.values())


def test_secrets_are_masked(stages):
    before = {r["doc_id"]: r for r in stages[2]}
    assert ids(stages[3]) == ids(stages[2])
    for r in stages[3]:
        old = before[r["doc_id"]]
        assert r["text"] == (None if old["text"] is None else plain_redact(old["text"]))
        assert r["n_chars"] == (old["n_chars"] if r["text"] is None else len(r["text"])) and r["source"] == old["source"]


def test_mix_comes_near_its_targets(stages):
    words = lambda r: len((r["text"] or "").encode().split())
    sources = sorted({r["source"] for r in stages[3] if r["source"] is not None}) + [None] * any(r["source"] is None for r in stages[3])
    size, taken, largest = Counter(), Counter(), Counter()
    for r in stages[3]:
        size[r["source"]] += words(r)
        largest[r["source"]] = max(largest[r["source"]], words(r))
    for r in stages[4]:
        taken[r["source"]] += words(r)
    for s, target in zip(sources, fill([size[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], 3), strict=True):
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6
    have = ids(stages[3])
    assert all(n <= 3 * have[d] for d, n in ids(stages[4]).items())
    texts = {(r["doc_id"], r["text"]) for r in stages[3]}
    assert all((r["doc_id"], r["text"]) in texts for r in stages[4])


def test_packing_holds_every_token(stages):
    check(stages[5], [(r["doc_id"], r["text"]) for r in stages[4]], 2048)


def test_run_equals_its_stages_and_takes_empty_tables(spark, sf, tmp_path):
    assert pipeline.run(spark, sf).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
