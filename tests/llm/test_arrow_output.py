from __future__ import annotations

import zlib

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import arrow_output as A
from tidemark.llm.arrow_output import SequenceFile, op9_arrow_output, read_documents, write_sequences
from tidemark.llm.common import Scratch
from tidemark.llm.tokens import default_vocabulary


def want(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    out, start = [], 0
    for doc, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_round_trip(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, op9_arrow_output(spark, sf).collect())) == want(docs)


def test_rows_and_masks(spark):
    rows = [(None, None), (2, "a b"), (3, "c " * 900), (4, "")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, bucket string, ids string")
    files = write_sequences(docs, Scratch(spark, "t").path("s"), length=8, buckets=1)
    manifest, files = files, files.collect()
    assert len(files) == 1 and files[0]["tokens"] == sum(x[2] for x in want(rows))
    f = SequenceFile(files[0]["uri"])
    flat, used = [], 0
    for i in range(-(-files[0]["tokens"] // 8)):
        ids, mask = f.row(i)
        assert len(ids) == len(mask) == 8 and not ids.flags.owndata
        flat.extend(ids[mask == 1].tolist())
        used += int(mask.sum())
    assert used == files[0]["tokens"] == len(flat)
    got = sorted(map(tuple, read_documents(manifest).collect()), key=lambda r: r[1])
    assert got == want(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    files = write_sequences(docs, Scratch(spark, "t").path("s"))
    assert files.count() == 0 and read_documents(files).count() == 0


def test_docs_in_batches_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(A, "DOCS_ROWS", 3)
    monkeypatch.setattr(A, "BUCKET_BYTES", 40)
    docs = spark.createDataFrame([(i // 2, f"word {i} " * (i % 5)) for i in range(40)], "doc_id long, text string")
    files = write_sequences(docs, Scratch(spark, "t").path("s"), length=8)
    assert files.count() > 12 and files.agg({"rows": "sum"}).first()[0] == 40
    got = sorted(map(tuple, read_documents(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(i // 2 for i in range(40))
    # rows of one id may come in either order, each with its own ids
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in want((i // 2, f"word {i} " * (i % 5)) for i in range(40)))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(40)]


def test_a_bucket_of_several_files(spark, monkeypatch):
    monkeypatch.setattr(A, "FILE_TOKENS", 50)
    monkeypatch.setattr(A, "BUCKETS", 2)
    monkeypatch.setattr(A, "BUCKET_BYTES", 40)
    rows = [(i, f"word {i} " * (i % 7)) for i in range(60)]
    files = write_sequences(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t").path("s"), length=8)
    listed = sorted(files.collect(), key=lambda r: (r["bucket"], r["part"]))
    assert {r["bucket"] for r in listed} == {0, 1} and max(r["part"] for r in listed) > 2
    assert [r["start"] for r in listed] == [sum(r["tokens"] for r in listed[:k]) for k in range(len(listed))]
    assert sorted(map(tuple, read_documents(files).collect()), key=lambda r: r[1]) == want(rows)
