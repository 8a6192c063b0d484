"""Quality rules whose cutoffs come with a bound on false rejections, by DataFrame functions only.

1. Every text is measured in its own row: words, symbols, repeated lines, words in repeated three-word windows. Five rules
   turn these into levels from 0 to 1000, higher being worse.
2. Labelled texts, one for each distinct text of a stratum, fall into two halves by their digest, so copies share a half.
   Counts per stratum, rule, level and half are one partial aggregate; all that follows has at most strata * rules * 1001 rows.
3. The first half proposes a cut for each rule: the level from which rejecting gains most, a good text counting PRICE bad ones.
4. The second half, the holdout, certifies. Let k of its n good texts of a stratum be rejected from a level on. The exact
   binomial tail P(Bin(n, risk) <= k) tests "more than ``risk`` of the good texts would be rejected". Levels are tested from the
   mildest down to the proposed one, so a rule's levels need no further correction; over rules and strata the error is
   shared by Bonferroni, and the risk of a stratum by its rules. The mildest certified level at or above the proposed one
   holds: with probability 1 - ERROR, no stratum loses more than RISK of its good texts to all rules together.

Edge cases: a null text has no words; texts of any length are measured whole, each as a few arrays as long as its words
inside one row. A document that fails the base rules is not kept, whatever its label. Null strata are one stratum; a
stratum without enough labels, or without labels at all, certifies nothing and rejects nothing. A document with several labels is good
if one says so; labels of 0 are bad, other values than 0 and 1 and null are no labels. Rows may repeat; an empty table gives no rows; the measures are one
struct column whose name gets underscores where the table has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, small
from .secrets import let

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RULES = ("repeat", "symbols", "dup_lines", "long_words", "short_words")
#: Of a stratum's good texts, the share that all rules together may reject; the chance that any stratum exceeds it.
RISK, ERROR = 0.05, 0.05
#: Bad texts that a good one counts for when the first half proposes a cut.
PRICE = 10
STRATA_BROADCAST = 100_000


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window that is found twice or more."""
    windows = let(
        words,
        lambda w: F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))),
    )
    same = lambda x, y: y.isNotNull() & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    again = let(F.array_sort(windows), lambda s: F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))), lambda x: x["i"]))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    covered = F.aggregate(F.array_sort(again), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step)
    return F.coalesce(covered["n"], F.lit(0)).cast("long")


def measure(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs and, last, a struct ``measures``: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines,
    n_repeat_words, base_failed, digest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    ruled = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    both = let(
        F.struct(counted.alias("c"), ruled.alias("l")),
        lambda m: F.struct(
            m["c"]["n_words"].alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            m["l"]["n_lines"].alias("n_lines"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["c"]["n_repeat_words"].alias("n_repeat_words"),
            ((m["c"]["n_words"] < 50) | (100 * m["c"]["n_repeat_words"] > 50 * m["c"]["n_words"])).alias("base_failed"),
            F.md5(text.cast("binary")).alias("digest"),
        ),
    )
    return docs.withColumn(free_name(docs, "measures"), both)


def level(m: Column, rule: str) -> Column:
    """0 to 1000, higher is worse; null where nothing can be measured."""
    part = lambda scale, a, b: F.floor(F.try_divide(scale * m[a], m[b])).cast("int")
    thousand = F.lit(1000)
    return {
        "repeat": part(1000, "n_repeat_words", "n_words"),
        "symbols": part(1000, "n_symbols", "word_chars"),
        "dup_lines": part(1000, "n_dup_lines", "n_lines"),
        "long_words": F.least(thousand, part(10, "word_chars", "n_words")),
        "short_words": thousand - F.least(thousand, part(100, "word_chars", "n_words")),
    }[rule]


def most_rejected(n: Column, risk: float, error: Column) -> Column:
    """The largest k with P(Bin(n, risk) <= k) <= error; -1 if there is none."""
    start = F.struct((n * F.log1p(F.lit(-risk))).alias("log"), F.lit(0.0).alias("tail"), F.lit(-1).cast("long").alias("k"))

    def step(acc: Column, k: Column) -> Column:
        tail = acc["tail"] + F.exp(acc["log"])
        after = acc["log"] + F.log(F.greatest(n - k, F.lit(1)).cast("double")) - F.log(k + 1.0) + F.log(F.lit(risk / (1 - risk)))
        return F.struct(after.alias("log"), tail.alias("tail"), F.when(tail <= error * (1 - 1e-9), k).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * risk).cast("long")), start, step)["k"]


def certified_cuts(measured: DataFrame, labels: DataFrame, *, measures: str = "measures", id_col: str = "doc_id", stratum_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality", risk: float = RISK, error: float = ERROR, price: int = PRICE) -> DataFrame:
    """(stratum, rule, n, proposed, cut, rejected): n good texts in the holdout, the level from which the first half would
    reject, the certified level from which texts are rejected (null: none), and the good texts of the holdout from there on."""
    m = F.col(measures)
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_id).alias("_label_id")).agg(F.max(label_col).alias("_good"))
    rows = measured.where(~m["base_failed"]).select(F.col(id_col).alias("_id"), F.col(stratum_col).alias("stratum"), m.alias("m")).join(marks, F.col("_id") == F.col("_label_id"))
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), level(F.col("m"), r).alias("level")) for r in RULES])
    texts = rows.groupBy("stratum", "m.digest").agg(F.max("_good").alias("good"), F.first("m").alias("m"))
    one = texts.select("stratum", "good", (F.substring("digest", 1, 1) >= "8").alias("held"), F.explode(levels).alias("l")).where("l.level IS NOT NULL")
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    good, held = F.col("good") == 1, F.col("held")
    counts = one.groupBy("stratum", "l.rule", "l.level").agg(count(~held & good, "fit_good"), count(~held & ~good, "fit_bad"), count(held & good, "held_good"))

    counts = Scratch(measured.sparkSession, "rules").table(counts, "counts")
    strata = counts.select("stratum").distinct().count()  # null is one of them

    own = Window.partitionBy("stratum", "rule")
    down = own.orderBy(F.desc("level"))
    cut = counts.select("stratum", "rule", "level", *[F.sum(c).over(down).alias(c) for c in ("fit_good", "fit_bad", "held_good")], F.sum("held_good").over(own).alias("n"))
    gain = F.col("fit_bad") - price * F.col("fit_good")
    cut = cut.withColumn("proposed", F.max(F.struct(gain.alias("gain"), F.col("level").alias("level"))).over(own))
    cut = cut.where("proposed.gain > 0 AND level >= proposed.level")
    plan = cut.groupBy("stratum", "rule").agg(F.first("n").alias("n"), F.first("proposed.level").alias("proposed"), F.collect_list(F.struct("level", "held_good")).alias("levels"))
    plan = plan.withColumn("most", most_rejected(F.col("n"), risk / len(RULES), F.lit(error / (max(1, strata) * len(RULES)))))
    held_at = F.array_min(F.filter("levels", lambda x: x["held_good"] <= F.col("most")))
    return plan.select("stratum", "rule", "n", "proposed", held_at["level"].alias("cut"), held_at["held_good"].alias("rejected"))


def apply_cuts(measured: DataFrame, cuts: DataFrame, *, measures: str = "measures", stratum_col: str = "lang") -> DataFrame:
    """measured and, last, failed_rules (array: "base" and the rules whose cut the text reaches) and kept."""
    own, failed, kept = (free_name(measured, n) for n in ("_cuts", "failed_rules", "kept"))
    wide = cuts.groupBy("stratum").agg(F.struct(F.col("stratum").alias("of"), *[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(r) for r in RULES]).alias(own)).select(own)
    m, c = F.col(measures), F.col(own)
    out = measured.join(small(wide, wide.count(), STRATA_BROADCAST), F.col(stratum_col).eqNullSafe(c["of"]), "left")
    hits = [F.when(m["base_failed"], F.lit("base")), *[F.when(~m["base_failed"] & (level(m, r) >= c[r]), F.lit(r)) for r in RULES]]
    out = out.withColumn(failed, F.array_compact(F.array(*hits)))
    return out.withColumn(kept, F.size(failed) == 0).drop(own)


def quality_rules(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", stratum_col: str = "lang", **settings) -> DataFrame:
    """docs without its text and, last, measures, failed_rules and kept."""
    scratch = Scratch(docs.sparkSession, "rules")
    made = measure(docs, text_col=text_col)
    name = made.columns[-1]
    measured = scratch.table(made.drop(text_col), "measured")
    cuts = scratch.table(certified_cuts(measured, labels, measures=name, stratum_col=stratum_col, **settings), "cuts")
    return apply_cuts(measured, cuts, measures=name, stratum_col=stratum_col)


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    m = F.col("measures")
    return out.select("doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


_LEVELS = {
    "repeat": "1000 * n_repeat_words // n_words",
    "symbols": "1000 * n_symbols // word_chars",
    "dup_lines": "1000 * n_dup_lines // n_lines",
    "long_words": "least(1000, 10 * word_chars // n_words)",
    "short_words": "1000 - least(1000, 100 * word_chars // n_words)",
}

OP11_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
v AS (SELECT r, i FROM u QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
y AS (SELECT r, count(DISTINCT i + k) AS n FROM v, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
x AS (SELECT r, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS s FROM d),
m AS MATERIALIZED (
  SELECT d.r, doc_id, lang, md5(t) AS digest, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(s) AS BIGINT) AS n_lines,
    CAST(len(s) - len(list_distinct(s)) AS BIGINT) AS n_dup_lines, coalesce(y.n, 0) AS n_repeat_words
  FROM d JOIN x ON x.r = d.r LEFT JOIN y ON y.r = d.r),
f AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
g AS MATERIALIZED ({" UNION ALL ".join(f"SELECT r, lang, digest, '{k}' AS rule, {v} AS level FROM f WHERE NOT base_failed" for k, v in _LEVELS.items())}),
q AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
e AS (SELECT lang, digest, max(q.good) AS good, min(r) AS r FROM f JOIN q USING (doc_id) WHERE NOT base_failed GROUP BY lang, digest),
c AS (
  SELECT e.lang, g.rule, g.level, count(*) FILTER (e.digest < '8' AND good = 1) AS fg, count(*) FILTER (e.digest < '8' AND good = 0) AS fb, count(*) FILTER (e.digest >= '8' AND good = 1) AS hg
  FROM e JOIN g ON g.r = e.r WHERE g.level IS NOT NULL GROUP BY e.lang, g.rule, g.level),
h AS (
  SELECT lang, rule, level, sum(fb) OVER o - {PRICE} * sum(fg) OVER o AS gain, CAST(sum(hg) OVER o AS BIGINT) AS k, CAST(sum(hg) OVER (PARTITION BY lang, rule) AS BIGINT) AS n
  FROM c WINDOW o AS (PARTITION BY lang, rule ORDER BY level DESC)),
best AS (SELECT lang, rule, max(struct_pack(gain := gain, level := level)) AS p FROM h GROUP BY lang, rule),
sizes AS (SELECT DISTINCT lang, n FROM h),
strata AS (SELECT count(*) AS strata FROM (SELECT DISTINCT lang FROM e)),
tails AS (
  SELECT lang, n, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK / len(RULES)}) + (n - i) * ln(1 - {RISK / len(RULES)}))) OVER (PARTITION BY lang, n ORDER BY i) AS tail
  FROM (SELECT lang, n, unnest(range(0, CAST(ceil(n * {RISK / len(RULES)}) AS BIGINT) + 1)) AS i FROM sizes)),
most AS (SELECT lang, n, max(i) AS most FROM tails, strata WHERE tail <= {ERROR} / (strata * {len(RULES)}) GROUP BY lang, n),
cuts AS (
  SELECT h.lang, h.rule, min(h.level) AS cut FROM h JOIN best b ON b.lang IS NOT DISTINCT FROM h.lang AND b.rule = h.rule
  JOIN most t ON t.lang IS NOT DISTINCT FROM h.lang AND t.n = h.n WHERE b.p.gain > 0 AND h.level >= b.p.level AND h.k <= t.most GROUP BY h.lang, h.rule),
hits AS (SELECT g.r, string_agg(g.rule, ',' ORDER BY list_position({list(RULES)}, g.rule)) AS rules FROM g JOIN cuts ON cuts.lang IS NOT DISTINCT FROM g.lang AND cuts.rule = g.rule WHERE g.level >= cuts.cut GROUP BY g.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hits.r IS NULL AS kept,
  CASE WHEN base_failed THEN 'base' ELSE coalesce(hits.rules, '') END AS failed_rules
FROM f LEFT JOIN hits ON hits.r = f.r
"""
