"""Volume profiles that grow by a day: kept slot volumes in versions, one partition a day.

A new day reads that day's bars only and adds its partition; days that no product counts any more are dropped. The medians
come from the kept volumes, 288 small rows a product and day, never from the bars of the days before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.candles import completed, keep_last
from ..sources.versions import AGE, KEEP, Conflict, Log
from .features import profile_of, slot_volumes

SCHEMA = "product_id STRING, slot INT, volume DOUBLE"


class ProfileStore:
    """Slot volumes below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, Log(spark, root)

    @staticmethod
    def bars_of(candles: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
        """5-minute candles of bars that end on first to last; of a store, its other days are pruned."""
        stamp = lambda d: F.lit(dt.datetime.combine(d, dt.time()) - dt.timedelta(minutes=5)).cast("timestamp_ntz")
        after = last + dt.timedelta(days=1)
        own = candles.where((F.col("ts_start") >= stamp(first)) & (F.col("ts_start") < stamp(after)))
        if "day" in candles.columns:  # the bar that ends at midnight lies in the day before
            own = own.where(F.col("day").between(F.lit(first - dt.timedelta(days=1)), F.lit(last))).drop("day")
        return own

    def add(self, candles: DataFrame, cfg: Settings, first: dt.date, last: dt.date | None = None, *, tries: int = 20) -> int:
        """Slot volumes of the days first to last (one day without last) replace what is kept of them; returns the version."""
        last = last or first
        end = F.lit(dt.datetime.combine(last + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")
        rows = slot_volumes(completed(keep_last(self.bars_of(candles, first, last)), end))
        folder = self.log.new_folder()
        rows.repartition("day").write.partitionBy("day").parquet(f"{self.log.root}/{folder}")
        asked = {f"day={first + dt.timedelta(days=k)}" for k in range((last - first).days + 1)}
        fresh = {n: folder for n, _ in self.log._names(folder) if n in asked}
        for _ in range(tries):
            base, entry = self.log.latest()
            parts = {p: f for p, f in (entry or {}).get("parts", {}).items() if p not in asked} | fresh
            needed = self._needed(parts, cfg.tod_rvol_lookback_days)
            try:
                return self.log.append({"parts": {p: f for p, f in parts.items() if p in needed}}, expect=base + 1)
            except Conflict:
                continue
        raise Conflict(f"{self.log.root}: no version after {tries} tries")

    def _read(self, parts: dict[str, str]) -> DataFrame:
        schema = f"{SCHEMA}, day DATE, v STRING"
        if not parts:
            return self.spark.createDataFrame([], schema).drop("v")
        paths = [f"{self.log.root}/{folder}/{part}" for part, folder in sorted(parts.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.log.root}/data").parquet(*paths).drop("v")

    def _needed(self, parts: dict[str, str], lookback: int) -> set[str]:
        """Partitions of days that are among the last ``lookback`` days of some product."""
        if len(parts) <= lookback:
            return set(parts)
        days = self._read(parts).select("product_id", "day").distinct()
        newest = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("day")))
        kept = days.withColumn("_n", newest).where(F.col("_n") <= lookback).select("day").distinct()
        return {f"day={r['day']}" for r in kept.collect()}  # at most one row a kept day

    def volumes(self, version: int | None = None) -> DataFrame:
        """(product_id, slot, volume, day) that is kept."""
        entry = self.log.latest()[1] if version is None else self.log.entry(version)
        return self._read((entry or {}).get("parts", {}))

    def profile(self, cfg: Settings, today: dt.date, products: DataFrame | None = None) -> DataFrame:
        """The volume profile as of today, which must not lie before a kept day; products (product_id): those to tell about beside
        the ones that have volumes."""
        kept = self.volumes()
        every = kept.select("product_id")
        return profile_of(kept, every.unionByName(products.select("product_id")) if products is not None else every, cfg, F.lit(today))

    def vacuum(self, keep: int = KEEP, age: float = AGE) -> None:
        self.log.vacuum(keep, age)
