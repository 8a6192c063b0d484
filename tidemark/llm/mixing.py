"""Mixing sources to target weights by capped water-filling.

Targets: every source asks for its weight's share of all words, clamped at ``max_epochs`` times
its own words; what the clamped ones leave goes to the others by weight until none is above its
clamp. The fixed point is found in closed form: with sources sorted by clamp / weight, the first
j are clamped and the others get ``level * weight``.

Sampling: a document is taken ``floor(target / words)`` whole times and, for the fractional
repetition, if it comes early enough in a seeded hash order of its source. The cut in that order
is exact to half a document: words per (source, hash bucket) locate the one bucket where the cut
falls, and only that bucket's rows are ordered. The main path is DataFrame operations.

Edge cases: null text or source counts as empty text or as a source of its own (last in order);
sources without words get target 0 and their documents are not taken; rows that repeat a doc_id
(or have none) share its hash, so they are taken together; texts of any length are counted whole; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, free_name, small

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SOURCES_BROADCAST = 10_000


def seeded_hash(key: Column, seed: int) -> Column:
    """52 uniform bits from md5, the same in any engine."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) -> the same with target."""
    cap = F.col("source_size") * max_epochs
    every = Window.partitionBy()
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = sources.withColumn("cap", cap).withColumns(
        {
            "total": F.sum("source_size").over(every),
            "caps_before": F.sum("cap").over(upto) - F.col("cap"),
            "weights_left": F.sum("weight").over(after),
        }
    )
    level = (F.col("total") - F.col("caps_before")) / F.col("weights_left")
    t = t.withColumn("level", F.when(F.col("cap") / F.col("weight") >= level, level))
    # the first source that is not clamped sets the level; if all are, none exceeds its clamp
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows of docs and, last, size, source_size, target, copies and taken = copies * size.

    Underscores go before a name that docs has."""
    scratch = Scratch(docs.sparkSession, "mixing")
    source, words, h = F.col(source_col), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"), seeded_hash(F.col(id_col), seed)
    sized = docs.select(source.alias("source"), words.alias("size"), F.shiftright(h, 40).alias("bucket"))

    # tables of a row per source (and bucket) from here on; the sources are ordered in one task
    stats = scratch.table(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "words")
    sources = stats.groupBy("source").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    filled = water_fill(sources.withColumn("weight", pick.cast("long")), max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = filled.withColumn("whole", F.floor(ratio)).withColumn("quota", (ratio - F.col("whole")) * F.col("source_size"))

    by_bucket = Window.partitionBy("source").orderBy("bucket")
    run = stats.withColumn("upto", F.sum("words").over(by_bucket))
    cut = run.join(plan, run["source"].eqNullSafe(plan["source"])).select(plan["*"], run["bucket"], (F.col("upto") - F.col("words")).alias("before"), "upto")
    cut = cut.groupBy("source", "source_size", "target", "whole", "quota").agg(
        F.min(F.when(F.col("upto") > F.col("quota"), F.struct("bucket", "before"))).alias("cut")
    )
    cut = scratch.table(cut.select("source", "source_size", "target", "whole", "quota", F.col("cut.bucket").alias("cut_bucket"), F.coalesce("cut.before", F.lit(0)).alias("before")), "cut")
    cuts = small(cut, n := cut.count(), SOURCES_BROADCAST)

    # words are counted again only in the one bucket of a source where its cut falls
    edge = docs.select(source.alias("_source"), h.alias("h"), F.col(text_col).alias("text"))
    edge = edge.join(cuts, edge["_source"].eqNullSafe(cuts["source"]) & (F.shiftright("h", 40) == F.col("cut_bucket")))
    edge = edge.select("source", "h", "before", "quota", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("size").over(Window.partitionBy("source", "h"))
    edge = edge.withColumns({"first": F.col("before") + run - own, "own": own})
    last = edge.where(2 * F.col("first") + F.col("own") <= 2 * F.col("quota")).groupBy("source").agg(F.max("h").alias("cut_hash"))
    plan = scratch.table(cut.join(last.withColumnRenamed("source", "_s"), cut["source"].eqNullSafe(F.col("_s")), "left").drop("_s"), "plan")

    names = {x: free_name(docs, x) for x in ("size", "source_size", "target", "copies", "taken", "_h", "_plan")}
    mine, hashed = F.col(names["_plan"]), F.col(names["_h"])
    plan = small(plan.select(F.struct("*").alias(names["_plan"])), n, SOURCES_BROADCAST)
    joined = docs.withColumn(names["_h"], h).join(plan, source.eqNullSafe(mine["source"])).withColumn(names["size"], words)
    bucket = F.shiftright(hashed, 40)
    early = mine["cut_bucket"].isNull() | (bucket < mine["cut_bucket"]) | ((bucket == mine["cut_bucket"]) & (hashed <= F.coalesce(mine["cut_hash"], F.lit(-1))))
    copies = F.when(mine["source_size"] > 0, mine["whole"] + F.when((mine["quota"] > 0) & early, 1).otherwise(0)).otherwise(0).cast("long")
    made = [F.col(names["size"]), mine["source_size"].alias(names["source_size"]), mine["target"].alias(names["target"]), copies.alias(names["copies"]), (copies * F.col(names["size"])).alias(names["taken"])]
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *made)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|17'), 1, 13) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
t AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) - cap AS caps_before,
        CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights_left
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT (total - caps_before) / weights_left AS level FROM t
      WHERE cap / weight >= (total - caps_before) / weights_left ORDER BY cap / weight, source NULLS LAST LIMIT 1),
p AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM l) * weight, CAST(cap AS DOUBLE))) AS target FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM p),
r AS (SELECT *, floor(ratio) AS whole, (ratio - floor(ratio)) * source_size AS quota FROM q),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.quota,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS BIGINT) - CAST(sum(d.size) OVER (PARTITION BY d.source, d.h) AS BIGINT) AS before,
        CAST(sum(d.size) OVER (PARTITION BY d.source, d.h) AS BIGINT) AS own
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN whole + CASE WHEN quota > 0 AND 2 * before + own <= 2 * quota THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) * size AS taken
FROM c
"""
