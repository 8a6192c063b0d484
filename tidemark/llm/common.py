"""Shared plumbing: scratch tables in the shared folder, checked broadcasts, ordered buckets.

Every intermediate that cuts lineage is a Parquet table below ``spark.checkpoint.dir``, so a
lost executor costs only its own running tasks.
"""

from __future__ import annotations

import bisect
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured: a temporary one on a local master (tests), else an error,
    since executors on other machines would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


#: Rows of an Arrow batch between the JVM and Python: whole texts and sets make wide rows.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches for the session's plans from here on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Scratch:
    """Tables of one operator run below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: the lineage above it is cut."""
        path = self.path(name)
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete scratch tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast df if its counted rows are within limit; else leave the join to the planner."""
    return F.broadcast(df) if rows <= limit else df


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A bounded driver-side table as a plain literal relation (no RDD)."""
    import json

    text = json.dumps(rows)
    one = spark.range(1).select(F.from_json(F.lit(text), f"array<struct<{schema}>>").alias("r"))
    return one.select(F.inline("r"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, case ignored as Spark does."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Keys that are sampled for each bucket's bounds, and in all.
KEYS_A_BUCKET, KEYS = 40, 1_000_000


def ordered_buckets(df: DataFrame, key: str, parts: int) -> list:
    """Split points of key for at most ``parts`` buckets of about equal row counts.

    They come from a sample of about KEYS_A_BUCKET keys a bucket (about KEYS at most) over the whole table,
    as for any range partitioning; where they fall only decides the balance."""
    keys = df.select(key).where(F.col(key).isNotNull())
    n = keys.count()
    if parts < 2 or not n:
        return []
    share = min(KEYS_A_BUCKET * parts, KEYS) / n
    got = sorted(r[0] for r in (keys if share >= 1 else keys.sample(share, seed=7)).collect())
    return sorted({got[len(got) * k // parts] for k in range(1, parts)}) if got else []


def arrow_buckets(column: pa.Array, splits: list) -> np.ndarray:
    """Number of split points <= key for each row; null keys are in bucket 0."""
    if pa.types.is_integer(column.type):
        at = np.searchsorted(np.array(splits, np.int64), column.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(column.is_null().to_numpy(zero_copy_only=False), 0, at).astype(np.int32)
    return np.array([0 if k is None else bisect.bisect_right(splits, k) for k in column.to_pylist()], np.int32)
