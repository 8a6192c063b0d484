"""Token ids in the Arrow IPC file format: fixed-size-list rows for zero-copy random access.

Documents are dealt to buckets of ascending ids; one task writes a bucket's files:
``ids-<bucket>-<part>.arrow`` holds rows ``ids: fixed_size_list<uint16|uint32>[length]`` and ``mask:
fixed_size_list<uint8>[length]`` (mask 0 pads the last row), in batches of ``BATCH_ROWS`` rows, and
``docs-<bucket>-<part>.arrow`` holds (doc_id, start, n_tokens) in the file, in batches too. The number of buckets
follows the bytes of text up to BUCKETS; beyond that a bucket has several files of about FILE_TOKENS tokens.
Writer and reader hold a batch at a time. Files are written under a temporary name and renamed, so a repeated
task replaces its file whole. The folder may be in any store that pyarrow's file systems and Spark both reach.
Which files there are stands in a table, ``manifest`` in the folder; the driver sees none of its rows.

Edge cases: null text counts as empty and gives the end id alone; null ids come first; rows that
repeat an id are ordered by their ids' hash; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_buckets, ordered_buckets
from .tokens import default_vocabulary, encoder

LENGTH = 2048
END_ID = 1
BATCH_ROWS = 64
ENCODE_ROWS = 512
#: More buckets than tasks even out what tasks get; a bucket has about BUCKET_BYTES of text at most.
BUCKETS_A_TASK, BUCKET_BYTES = 3, 64 << 20
#: Buckets at most, whose bounds every task holds; tokens after which a bucket's next file begins; reading tasks for each of the
#: shuffle's tasks at most.
BUCKETS, FILE_TOKENS, READERS_A_TASK = 65_536, 1 << 25, 64
#: Rows of a batch of a docs file.
DOCS_ROWS = 8192


def file_system(uri: str):
    """pyarrow's file system and path for a Hadoop-style URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Appends token ids; writes full rows of ``length`` ids and, at the end, one padded row."""

    def __init__(self, sink, length: int, dtype: str):
        self.length, self.dtype = length, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.uint8(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = self.total = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.length * BATCH_ROWS:
            flat = np.concatenate(self.held)
            whole = len(flat) // (self.length * BATCH_ROWS) * self.length * BATCH_ROWS
            for at in range(0, whole, self.length * BATCH_ROWS):
                self._write(flat[at : at + self.length * BATCH_ROWS], self.length * BATCH_ROWS)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = (np.arange(len(flat)) < used).astype(np.uint8)
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-self.n // self.length) * self.length, dtype=self.dtype)
            padded[: self.n] = flat
            self._write(padded, self.n)
        self.out.close()


class DocsFile(NamedTuple):
    file: pa.RecordBatchFileWriter
    schema: pa.Schema


class SequenceFile:
    """Random access to one written file; rows and token ranges are views of the mapped file."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        local = type(fs).__name__ == "LocalFileSystem"
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.batches:
            if len(self.batches) > 4:
                self.batches.clear()
            got = self.reader.get_batch(k)
            self.batches[k] = tuple(got.column(c).flatten().to_numpy(zero_copy_only=True) for c in ("ids", "mask"))
        return self.batches[k]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        k, r = divmod(i, BATCH_ROWS)
        return tuple(x[r * self.length : (r + 1) * self.length] for x in self.batch(k))

    def tokens(self, start: int, n: int) -> np.ndarray:
        size = BATCH_ROWS * self.length
        parts = [self.batch(k)[0][max(0, start - k * size) : start + n - k * size] for k in range(start // size, (start + n - 1) // size + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_sequences(docs: DataFrame, folder: str, *, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """Write all docs in ascending id order below folder; returns the manifest, one row per file: bucket, part, uri, docs_uri, start,
    tokens, rows."""
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not buckets:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        buckets = min(max(BUCKETS_A_TASK * parts, -(-size // BUCKET_BYTES)), BUCKETS)
    splits = ordered_buckets(docs, id_col, buckets)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        get, press = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                raws = [np.frombuffer(r + end, "<u4") for r in get([t or "" for t in part.column(1).to_pylist()])]
                if any(len(r) and r.max() > np.iinfo(np.dtype(dtype)).max for r in raws):
                    raise ValueError(f"ids do not fit {dtype}")
                blobs = [press.compress(r.astype(dtype).tobytes()) for r in raws]
                yield pa.RecordBatch.from_arrays([pa.array(arrow_buckets(part.column(0), splits)), part.column(0), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "doc_id", "tie", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard

        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        unpress = zstandard.ZstdDecompressor()
        done: list[dict] = []
        now: dict = {}

        def flush() -> None:
            columns = [pa.array(now["ids"], now["docs"].schema.field(0).type), pa.array(now["starts"], pa.int64()), pa.array(now["lengths"], pa.int64())]
            now["docs"].file.write_batch(pa.RecordBatch.from_arrays(columns, schema=now["docs"].schema))
            now["rows"] += len(now["ids"])
            for name in ("ids", "starts", "lengths"):
                now[name].clear()

        def finish() -> None:
            if not now:
                return
            flush()
            now["out"].close()
            now["docs"].file.close()
            for sink in now["sinks"]:
                sink.close()
            for kind in ("ids", "docs"):
                fs.move(f"{now['tmp']}.{kind}", f"{root}/{kind}-{now['bucket']:06d}-{now['part']:06d}.arrow")
            done.append({"bucket": now["bucket"], "part": now["part"], "tokens": now["out"].total, "rows": now["rows"]})
            now.clear()

        def manifest() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pylist(done, pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("tokens", pa.int64()), ("rows", pa.int64())]))
            done.clear()
            return rows

        for batch in batches:
            for bucket, doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if now.get("bucket") != bucket or now["out"].total >= FILE_TOKENS:
                    part = now["part"] + 1 if now.get("bucket") == bucket else 0
                    finish()
                    tmp = f"{root}/.{bucket:06d}-{uuid.uuid4().hex}"
                    sinks = [fs.open_output_stream(f"{tmp}.{kind}") for kind in ("ids", "docs")]
                    schema = pa.schema([("doc_id", batch.schema.field(1).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    now.update(bucket=bucket, part=part, tmp=tmp, sinks=sinks, out=SequenceWriter(sinks[0], length, dtype), docs=DocsFile(pa.ipc.new_file(sinks[1], schema), schema), rows=0, ids=[], starts=[], lengths=[])
                ids = np.frombuffer(unpress.decompress(blob.as_buffer()), dtype)
                now["ids"].append(doc)
                now["starts"].append(now["out"].total)
                now["lengths"].append(len(ids))
                now["out"].append(ids)
                if len(now["ids"]) >= DOCS_ROWS:
                    flush()
            if len(done) >= DOCS_ROWS:
                yield manifest()
        finish()
        if done:
            yield manifest()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.mapInArrow(encode, f"bucket int, doc_id {kind}, tie long, ids binary").repartition(parts, "bucket")
    written = dealt.sortWithinPartitions("bucket", "doc_id", "tie").mapInArrow(write, "bucket int, part int, tokens long, rows long")
    written.write.parquet(f"{folder}/manifest/sizes")
    sizes = spark.read.schema(written.schema).parquet(f"{folder}/manifest/sizes")
    # what lies before a bucket from the sums of BUCKETS buckets at most, what lies before a file from its bucket's files
    sums = sizes.groupBy(F.col("bucket").alias("_b")).agg(F.sum("tokens").alias("_all"))
    sums = sums.select("_b", (F.sum("_all").over(Window.orderBy("_b")) - F.col("_all")).alias("_before"))
    own = F.sum("tokens").over(Window.partitionBy("bucket").orderBy("part")) - F.col("tokens")
    uri = lambda kind: F.format_string(f"%s/{kind}-%06d-%06d.arrow", F.lit(folder), "bucket", "part")
    files = sizes.join(F.broadcast(sums), F.col("bucket") == F.col("_b"))
    files = files.select("bucket", "part", uri("ids").alias("uri"), uri("docs").alias("docs_uri"), (F.col("_before") + own).alias("start"), "tokens", "rows")
    files.write.parquet(f"{folder}/manifest/files")
    return spark.read.schema(files.schema).parquet(f"{folder}/manifest/files")


def read_documents(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the manifest and the written files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = file_system(r["docs_uri"])
                ids = SequenceFile(r["uri"])
                with fs.open_input_file(path) as f:
                    docs = pa.ipc.open_file(f)
                    for k in range(docs.num_record_batches):
                        part = docs.get_batch(k)
                        start, n = (part.column(c).to_numpy() for c in ("start", "n_tokens"))
                        crcs = [zlib.crc32(ids.tokens(a, m).astype("<u4").tobytes()) for a, m in zip(start.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(start + r["start"]), part.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(files.count(), READERS_A_TASK * parts))
    listed = files.select("uri", "docs_uri", "start").repartition(tasks, "uri")
    return listed.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op9_arrow_output(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_sequences(docs, Scratch(spark, "arrow").path("sequences"))
    return read_documents(files)
