"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once per document, into measurements and one bit per failed rule. Policies
are versioned sets of rules with a bound on failures, applied to the bits later, without reading
texts again; ablations are bitwise aggregates over the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachline.llm.common import BLANKS, materialise, without_blanks, words

SYMBOL_CLASS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named bit; ``fails`` is a SQL condition over the measurements."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A document is rejected when more than ``allowed`` of the policy's rules failed."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0


#: Bit k of a ledger is rule k: append only.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 30 * n_words"),
    Rule("all_capitals", "2 * n_upper > word_chars AND n_words > 0"),
)
POLICIES = (
    Policy("v1", ("few_words", "repeated_windows")),
    Policy("v2", ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "word_length", "all_capitals")),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")


def _repeat_words(tokens: Column) -> Column:
    """Words inside three-word windows that occur at least twice, each word once.

    Windows are compared by 64-bit hash. Sorting (hash, position) puts equal windows side by side;
    the positions of those with an equal neighbour, sorted, cover min(3, gap to the next) words each.
    """

    def windows(ts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ts) - 3), lambda i: F.struct(F.xxhash64(F.get(ts, i), F.get(ts, i + 1), F.get(ts, i + 2)).alias("h"), i.alias("i")))

    def twin(rows: Column) -> Column:
        return F.filter(rows, lambda x, k: (x["h"] == F.get(rows, k - 1)["h"]) | (x["h"] == F.get(rows, k + 1)["h"]))

    def once(value: Column, then) -> Column:
        """then(value), with value computed a single time."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def covered(at: Column) -> Column:
        step = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["p"])).cast("int").alias("n"), i.alias("p")))
        return step["n"]

    def found(ts: Column) -> Column:
        return once(F.sort_array(windows(ts)), lambda rows: once(F.sort_array(F.transform(twin(rows), lambda x: x["i"])), covered))

    # the words are bound once: an optimiser that moves this expression must not split the text for every window
    return once(tokens, lambda ts: F.when(F.size(ts) < 4, F.lit(0)).otherwise(found(ts)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and the measurements of every document; null text has no words and no lines.

    With ``carry``, the whole input row comes along as the struct ``row``.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    on = ["row"] if carry else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit("".join(BLANKS)))) > 0)
    return (
        docs.select(*row, F.col(id_col).alias("doc_id"), text.alias("_text"))
        .select(*on, "doc_id", "_text", words(t).alias("_words"), lines.alias("_lines"))
        .select(
            *on,
            "doc_id",
            F.size("_words").cast("long").alias("n_words"),
            F.length(without_blanks(t)).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOL_CLASS)).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        )
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The measurements and ``failed_bits``: bit k set where rule k failed."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col, carry).withColumn("failed_bits", bits)


def _mask(policy: Policy, rules: tuple[Rule, ...]) -> int:
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[name] for name in policy.rules)


def keeps(policy: Policy, bits: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.bit_count(bits.bitwiseAND(F.lit(_mask(policy, rules)))) <= policy.allowed


def quality_rules(docs: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: measurements, failed_bits, base_failed, kept (by the last policy).

    Null or empty text has zero of everything and fails ``few_words``. Repeated rows are judged
    one by one, a null id stays null, an empty table gives an empty result, and other columns of
    docs are ignored. A text may be of any length: work is in proportion to n log n of its words.
    """
    base = _mask(Policy("base", ("few_words", "repeated_windows")), rules)
    return ledger(docs, rules, id_col, text_col).withColumns(
        {"base_failed": F.col("failed_bits").bitwiseAND(F.lit(base)) != 0, "kept": (F.col("failed_bits").bitwiseAND(F.lit(base)) == 0) & keeps(policies[-1], F.col("failed_bits"), rules)}
    )


def kept_rows(docs: DataFrame, policy: Policy = POLICIES[-1], rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the policy keeps."""
    book = ledger(docs, rules, id_col, text_col, carry=True)
    # a column that isn't deterministic keeps the filter above the measurements, which are then computed once
    book = book.withColumn("held", F.spark_partition_id())
    return book.filter(keeps(policy, F.col("failed_bits"), rules) & (F.col("held") >= 0)).select("row.*")


def ablations(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if it were left out.

    The ledger is first reduced to counts per bit pattern (at most 2^rules rows).
    """
    mask = _mask(policy, rules)
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    at = {r.name: k for k, r in enumerate(rules)}
    rows = [F.struct(F.lit(name).alias("rule"), F.lit(1 << at[name]).cast("long").alias("bit")) for name in policy.rules]
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return (
        patterns.select("bits", "n", F.explode(F.array(*rows)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(total(fails).alias("n_failed"), total(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"), total(F.bit_count(left) <= policy.allowed).alias("n_kept_without"))
    )


def policy_report(docs: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """policy, rule, n_failed, n_failed_alone, n_kept_without, n_kept: the ablations of all policies.

    Texts are read once, for the ledger, which is stored; policies read its bits alone. An empty
    table gives no rows.
    """
    book = materialise(ledger(docs, rules, id_col, text_col).select("failed_bits"), "quality-ledger")
    parts = []
    for policy in policies:
        kept = book.agg(F.count(F.when(keeps(policy, F.col("failed_bits"), rules), 1)).alias("n_kept"))
        parts.append(ablations(book, policy, rules).crossJoin(F.broadcast(kept)).select(F.lit(policy.version).alias("policy"), "*"))  # one row each
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_BOOK = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT doc_id, p, ws[p] || chr(10) || ws[p + 1] || chr(10) || ws[p + 2] AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)
), c AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, p + unnest([0, 1, 2]) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS k FROM g) WHERE k > 1)
  GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '{SYMBOL_CLASS}', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES))})::BIGINT AS failed_bits FROM m
)
"""
SQL = f"{_BOOK}SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b"


def _report_sql() -> str:
    rows = [f"('{p.version}', '{name}', {1 << [r.name for r in RULES].index(name)}, {_mask(p, RULES)}, {p.allowed})" for p in POLICIES for name in p.rules]
    return f"""{_BOOK}
SELECT policy, rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits & mask = bit) AS n_failed_alone,
       count(*) FILTER (bit_count(failed_bits & (mask - bit)) <= allowed) AS n_kept_without, count(*) FILTER (bit_count(failed_bits & mask) <= allowed) AS n_kept
FROM b CROSS JOIN (VALUES {", ".join(rows)}) v(policy, rule, bit, mask, allowed) GROUP BY policy, rule"""


REPORT_SQL = _report_sql()
