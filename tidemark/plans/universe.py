"""The product universe: normalise, filter, count, rank, cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings

#: The priority list, in rank order.
PRIORITY = [
    "BTC-USD", "ETH-USD", "SOL-USD", "XRP-USD", "ADA-USD", "DOGE-USD", "AVAX-USD", "LINK-USD", "DOT-USD", "LTC-USD", "BCH-USD",
    "ATOM-USD", "UNI-USD", "AAVE-USD", "ETC-USD", "FIL-USD", "NEAR-USD", "ALGO-USD", "HBAR-USD", "ARB-USD", "OP-USD", "INJ-USD",
    "SUI-USD", "APT-USD", "SEI-USD", "IMX-USD", "GRT-USD", "RNDR-USD", "STX-USD",
    "BTC-USDT", "ETH-USDT", "SOL-USDT", "XRP-USDT", "ADA-USDT", "DOGE-USDT", "AVAX-USDT", "LINK-USDT", "DOT-USDT",
    "BTC-USDC", "ETH-USDC", "SOL-USDC", "XRP-USDC", "ADA-USDC", "DOGE-USDC",
]
UNRANKED = 1_000_000


def priority_rank(id_: Column) -> Column:
    """Place in the priority list; beyond it 1,000,000."""
    ranks = F.create_map(*[x for i, p in enumerate(PRIORITY) for x in (F.lit(p), F.lit(i))])
    return F.coalesce(F.try_element_at(ranks, id_), F.lit(UNRANKED))


def normalised(catalog: DataFrame) -> DataFrame:
    """Trimmed upper-case id, base and quote, lower-case status; missing values are empty."""
    clean = lambda c, f: f(F.trim(F.coalesce(c, F.lit(""))))
    return catalog.withColumns({"id": clean("id", F.upper), "base": clean("base_currency", F.upper), "quote": clean("quote_currency", F.upper), "status": clean("status", F.lower)}).drop("base_currency", "quote_currency")


def tradable(products: DataFrame, cfg: Settings) -> DataFrame:
    """Ids with a dash, an open status and an allowed quote; empty status and quote pass."""
    status = (F.col("status") == "") | F.col("status").isin("online", "active")
    quote = (F.col("quote") == "") | F.col("quote").isin(*cfg.quote_allowlist)
    return products.where((F.instr("id", "-") > 0) & status & quote)


def is_stable(cfg: Settings) -> Column:
    return F.col("base").isin(*cfg.stablecoin_bases) if cfg.exclude_stablecoin_base else F.lit(False)


def live_universe(catalog: DataFrame, cfg: Settings, *, cap: bool = True) -> DataFrame:
    """(id, base, quote, status, rank, ...) in universe order, capped at universe_max if positive."""
    kept = tradable(normalised(catalog), cfg).where(~is_stable(cfg))
    out = kept.withColumn("status", F.when(F.col("status") == "", "spot").otherwise(F.col("status"))).withColumn("rank", priority_rank(F.col("id")))
    if cap and cfg.universe_max > 0:
        rest = [c for c in out.columns if c not in ("id", "rank")]
        out = out.orderBy("rank", "id", *rest).limit(cfg.universe_max)
    return out


def env_universe(spark: SparkSession, cfg: Settings, ids: DataFrame | None = None) -> DataFrame:
    """Configured ids with a dash; no other filter applies. ids: a table (id) to take them from instead of the settings."""
    if ids is None:
        given = F.explode(F.array(*map(F.lit, cfg.crypto_universe or ()))) if cfg.crypto_universe else F.explode(F.array().cast("array<string>"))
        ids = spark.range(1).select(given.alias("id"))
    rows = ids.where(F.instr("id", "-") > 0)
    parts = F.split("id", "-")
    out = rows.select("id", parts[0].alias("base"), parts[1].alias("quote"), F.lit("env").alias("status"))
    return out.limit(cfg.universe_max) if cfg.universe_max > 0 else out


def fallback_universe(spark: SparkSession, cfg: Settings, known: DataFrame | None = None) -> DataFrame:
    """The priority list itself, when the catalog cannot be read; of it only what a table of known products (id) has, if given."""
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, PRIORITY))).alias("rank", "id"))
    rows = rows.select("id", F.substring_index("id", "-", 1).alias("base"), F.substring_index("id", "-", -1).alias("quote"), F.lit("fallback").alias("status"), "rank")
    rows = rows.where(F.col("quote").isin(*cfg.quote_allowlist) & ~is_stable(cfg))
    if known is not None:
        rows = rows.join(known.select("id"), "id", "left_semi")
    return rows.orderBy("rank").limit(cfg.universe_max) if cfg.universe_max > 0 else rows


def universe_meta(catalog: DataFrame, cfg: Settings, source: str = "live") -> DataFrame:
    """One row: source, count, full_count and how many stable bases were left out."""
    rows = tradable(normalised(catalog), cfg)
    kept = F.count_if(~is_stable(cfg))
    return rows.agg(kept.alias("count"), kept.alias("full_count"), F.count_if(is_stable(cfg)).alias("excluded_stablecoin_base_count")).withColumn("source", F.lit(source))


def quote_distribution(catalog: DataFrame, cfg: Settings) -> DataFrame:
    return live_universe(catalog, cfg, cap=False).groupBy("quote").agg(F.count(F.lit(1)).alias("n"))


def cache_usable(snapshot: DataFrame, counts: DataFrame, as_of: Column, cfg: Settings) -> DataFrame:
    """One row: is a stored universe (rows with updated_at) fresh enough and not truncated?"""
    held = snapshot.agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("at"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    fresh = F.timestamp_diff("SECOND", F.col("at"), as_of) <= cfg.universe_refresh_minutes * 60
    truncated = (F.lit(cfg.universe_max) <= 0) & (F.col("total") > F.col("n")) & (F.col("n") > 0)
    return held.crossJoin(F.broadcast(total)).select(F.coalesce(fresh, F.lit(False)).alias("fresh"), truncated.alias("truncated"), (F.coalesce(fresh, F.lit(False)) & ~truncated).alias("usable"))


def catalog_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's parts as a product catalog, with cases for every filter."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % n + 1).cast("int"))
    quote = pick(["USD", "usdt", "USDC", "EUR", ""], 5)
    return p.select(
        "p_partkey",
        F.concat(F.upper("p_type"), F.lit("-"), quote).alias("id"),
        F.when(F.col("p_partkey") % 11 == 0, "USDT").otherwise(F.col("p_type")).alias("base_currency"),
        quote.alias("quote_currency"),
        pick(["online", "delisted", "", "ACTIVE"], 4).alias("status"),
    )
