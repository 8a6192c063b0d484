"""Secret scan through a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: an AND of clauses, each an
OR of alternatives, each an AND of trigrams that a match must hold (over ASCII-lower-cased text).
The index posts (trigram, document) for the trigrams the rules name; postings are intersected per
alternative, alternatives united per clause and clauses intersected per rule. Only candidate
documents are verified with the regular expression. A rule without a mandatory trigram has no
query and scans every text.

The main path is DataFrame functions: match offsets come from splitting the text at the matches
and summing lengths, in code points. Matches are leftmost and do not overlap within a rule;
matches that miss the rule's minimum length are dropped after matching.

Candidates come back to the texts by key; while their counted number allows it they are broadcast,
so no text is shuffled. Positions are running sums made in chunks, so the work of a text with many
matches grows with their number times ``CHUNK``.

Edge cases: null text counts as empty (``redact`` leaves it null); repeated rows each keep their own
result; texts of any length are scanned whole; an empty table gives no rows. Rows are keyed by (id, text
hash): rows that collide share candidates, never spans, since spans come from a row's own text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, literal_table, small


@dataclass(frozen=True)
class Rule:
    """A match counts if its group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The patterns of the base kinds, in their order.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Published token formats that the base kinds do not cover.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 64
SMALL_CLASS = 5
#: Elements of a chunk of running values; characters of a block of text.
CHUNK, BLOCK = 128, 1024
#: Candidate keys that are broadcast.
KEYS_BROADCAST = 300_000

Clause = list[list[str]]


def trigram_query(pattern: str) -> list[Clause]:
    """AND of ORs of ANDs of trigrams; empty if nothing is mandatory."""
    clauses: list[Clause] = []

    def flush(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            alts = sorted({tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in strings})
            clauses.append([list(a) for a in alts])

    def exact(node) -> set[str] | None:
        """All strings a node can match, lower-cased, if they are few."""
        op, arg = node
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= SMALL_CLASS:
            return {chr(a).lower() for _, a in arg}
        if op is C.SUBPATTERN:
            return sequence(arg[3])
        if op is C.BRANCH:
            sets = [sequence(s) for s in arg[1]]
            return None if None in sets else set().union(*sets)
        if op is C.MAX_REPEAT and arg[1] <= 2:
            one = sequence(arg[2])
            return None if one is None else {"".join(c) for n in range(arg[0], arg[1] + 1) for c in product(one, repeat=n)}
        return None

    def sequence(nodes) -> set[str] | None:
        got = {""}
        for node in nodes:
            one = exact(node)
            if one is None or len(got) * len(one) > MOST_STRINGS:
                return None
            got = {a + b for a in got for b in one}
        return got

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            one = exact(node)
            if one is not None and len(run) * len(one) <= MOST_STRINGS:
                run = {a + b for a in run for b in one}
                continue
            flush(run)
            run = one if one is not None else {""}
            if one is None and node[0] is C.SUBPATTERN:
                walk(node[1][3])
            elif one is None and node[0] is C.MAX_REPEAT and node[1][0] >= 1:
                walk(node[1][2])
        flush(run)

    walk(P.parse(pattern))
    return clauses


def candidates(rows: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the rules whose trigram query a document satisfies."""
    spark = rows.sparkSession
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    terms = [
        {"trigram": t, "rule": k, "clause": ci, "alt": ai, "terms": len(alt), "clauses": len(q)}
        for k, q in queries.items()
        for ci, clause in enumerate(q)
        for ai, alt in enumerate(clause)
        for t in alt
    ]
    named = sorted({t["trigram"] for t in terms})
    # ASCII letters only: Unicode lower-casing of a whole text costs more and finds no more
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in named]))
    postings = rows.select(F.col(key).alias("key"), low.alias("_low")).select("key", F.explode(found).alias("trigram"))
    lookup = F.broadcast(literal_table(spark, terms, "trigram string, rule string, clause int, alt int, terms int, clauses int"))
    lists = postings.join(lookup, "trigram")
    by_alt = lists.groupBy("key", "rule", "clause", "alt", "terms", "clauses").agg(F.count_distinct("trigram").alias("n")).where("n = terms")
    by_rule = by_alt.groupBy("key", "rule", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return by_rule.groupBy("key").agg(F.collect_set("rule").alias("_rules"))  # at most one entry a rule


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of numbers, what combine makes of 0 and those before it. values must not be empty."""
    fold = lambda array, of: F.aggregate(
        array,
        F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("before")),
        lambda acc, x: F.struct(combine(acc["all"], of(x)).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before")),
    )
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))
    local = F.transform(chunks, lambda c: fold(c, lambda x: x))
    return let(local, lambda parts: F.flatten(F.zip_with(parts, fold(parts, lambda x: x["all"])["before"], lambda p, head: F.transform(p["before"], lambda x: combine(head, x)))))


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of a rule's kept matches."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))

    def spans(own: Column) -> Column:
        counted = own if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
        gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(own)), F.length)
        sizes = F.zip_with(F.zip_with(gaps, own, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("own"))), counted, lambda x, c: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), F.length(c).alias("counted")))
        return let(sizes, placed)

    def placed(sizes: Column) -> Column:
        before = let(F.transform(sizes, lambda x: x["gap"] + x["own"]), lambda steps: running(steps, lambda a, b: a + b))
        made = F.zip_with(sizes, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("order"), (at + x["gap"] + x["own"]).alias("end"), F.lit(rule.kind).alias("kind"), x["counted"].alias("counted")))
        return F.transform(F.filter(made, lambda s: s["counted"] >= rule.least), lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"])).cast(SPANS)

    return let(whole, lambda own: F.when(F.size(own) > 0, spans(own)).otherwise(F.array().cast(SPANS)))


def fast(rule: Rule) -> Rule:
    """The same kept matches from a pattern that only matches those, where that is sure.

    A rule that is one greedy class run keeps exactly the runs of the minimum length or more."""
    nodes = list(P.parse(rule.pattern))
    if rule.group == 0 and len(nodes) == 1 and nodes[0][0] is C.MAX_REPEAT and rule.pattern.endswith("]+"):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least)
    return rule


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs and, last, ``out``: array of (start, order, end, kind), by start, then rule order; underscores go before a
    name that docs has."""
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own_key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    found = candidates(docs.select(own_key.alias("key"), text.alias("text")), "key", "text", tuple(indexed))
    found = scratch.table(found, "candidates")
    key, found_key, kinds, out = (free_name(docs, n) for n in ("_key", "_found", "_rules", out))
    named = found.select(F.col("key").alias(found_key), F.col("_rules").alias(kinds))
    joined = docs.withColumn(key, own_key).join(small(named, found.count(), KEYS_BROADCAST), F.col(key).eqNullSafe(F.col(found_key)), "left")
    spans = []
    for order, rule in enumerate(rules):
        own = rule_spans(text, fast(rule), order)
        if rule in indexed:
            own = F.when(F.array_contains(kinds, rule.kind), own).otherwise(F.array().cast(SPANS))
        spans.append(own)
    return joined.withColumn(out, F.array_sort(F.concat(*spans))).drop(key, found_key, kinds)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text", spans_col: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a text replaced by a mark; overlapping spans become one. A null text stays null."""
    text, spans = F.col(text_col), F.col(spans_col)

    def masked(blocks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            """Characters from a to b, from the blocks that hold them."""
            which = F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int"))
            part = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * BLOCK, F.lit(0)) + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - F.greatest(a - k * BLOCK, F.lit(0)))
            return F.when(b > a, F.array_join(F.transform(which, part), "")).otherwise("")

        def joined(ends: Column) -> Column:
            placed = F.zip_with(spans, ends, lambda s, at: F.struct(s["start"].alias("start"), at.alias("at")))
            pieces = F.transform(F.filter(placed, lambda x: x["start"] >= x["at"]), lambda x: between(x["at"], x["start"]))
            last = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.array_join(F.concat(pieces, F.array(between(last, F.length(text)))), mark)

        before = let(F.transform(spans, lambda s: s["end"]), lambda ends: running(ends, lambda a, b: F.greatest(a, b)))
        return let(before, joined)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, let(blocks, masked)).otherwise(text))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["order"] < len(BASE_RULES))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("secret_spans")).alias("spans"),
    )


def _sql_rule(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    flag = ", 'i'" if p.startswith("(?i)") else ""
    p = p.removeprefix("(?i)")
    cut = f"(?i){p}" if flag else p
    return f"""
SELECT doc_id, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
    "start" := CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
    "order" := {order},
    "end" := CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT),
    kind := '{rule.kind}', counted := length(g[i]))), lambda s: s.counted >= {rule.least})) AS s
FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0{flag}) AS m, regexp_extract_all(t, '{p}', {rule.group}{flag}) AS g, string_split_regex(t, '{cut}') AS parts FROM d)"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql_rule(fast(r), i) for i, r in enumerate(RULES))}),
j AS (SELECT doc_id,
  count(*) FILTER (s.kind = 'assign') AS n_assign, count(*) FILTER (s.kind = 'access') AS n_access, count(*) FILTER (s.kind = 'hex') AS n_hex,
  string_agg(s.kind || ':' || s."start" || ':' || s."end", ',' ORDER BY s."start", s."order") FILTER (s."order" < {len(BASE_RULES)}) AS base,
  string_agg(s.kind || ':' || s."start" || ':' || s."end", ',' ORDER BY s."start", s."order") AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""
