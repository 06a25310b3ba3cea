"""Personal data by weakly supervised span classification, in DataFrame operations only.

Four base kinds are found by pattern and checked (part range, Luhn, digit counts). Beyond them,
candidates are tokens that hold a digit, tokens that a key word announces (``password: ..``) and given
names of a gazetteer with a capitalised word after them, where they touch no base span. Regex,
gazetteer and context labelers vote on them, expectation-maximisation over the counts of vote patterns
estimates how far each labeler can be trusted, and its posteriors train a logistic classifier over the
candidate's shape and surroundings, which decides. Those it accepts are spans of kind ``private``.

Patterns are written so that no text makes them backtrack: a match may start only at the start of a
run or where the last match ended, which is where the leftmost match starts anyway.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachline.llm.common import materialise

# The base kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
ADDED = "private"
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CONTEXT = 48
_LAST = (1 << 31) - 1


def _once(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    ones = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def add(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(ones, add), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: _once(F.regexp_replace(p, "^0+", ""), lambda z: (F.length(z) <= 3) & (F.coalesce(z.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(hit, r"\."), part)
    if kind == "card":
        return _once(_digits(hit), lambda d: F.length(d).between(13, 19) & _luhn(d))
    return F.length(_digits(hit)).between(9, 15)


#: Arrays of up to RADIX ** LEVELS items can be scanned.
RADIX, LEVELS = 8, 8


def _scan(values: Column, op, none: int) -> Column:
    """Running op (sum, largest, smallest; ``none`` changes nothing) over an array, in n log n.

    After a level with step d every item holds the op over d * RADIX items up to it.
    """

    def level(d: int):
        def run(a: Column) -> Column:
            def item(x: Column, i: Column) -> Column:
                for j in range(1, RADIX):
                    x = op(x, F.coalesce(F.get(a, i - j * d), F.lit(none)))
                return x

            return F.when(F.size(a) > d, F.transform(a, item)).otherwise(a)

        return run

    for k in range(LEVELS):
        values = _once(values, level(RADIX**k))
    return values


def _placed(hits: Column, gaps: Column) -> Column:
    """array<struct<hit, gap, after, start, end>>, where gaps[i] stands before hits[i] in the text."""
    lengths = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))

    def spans(ends: Column) -> Column:
        one = lambda h, i: F.struct(h.alias("hit"), F.get(gaps, i).alias("gap"), F.get(gaps, i + 1).alias("after"), (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"))
        return F.transform(hits, one)

    return _once(_scan(lengths, lambda x, y: x + y, 0), spans)


def _found(hits: Column, gaps: Column) -> Column:
    none = F.array().cast("array<struct<hit:string,gap:string,after:string,start:int,end:int>>")
    return F.when(F.size(hits) > 0, _once(gaps, lambda g: _placed(hits, g))).otherwise(none)


def _apart(cands: Column, spans: Column) -> Column:
    """The candidates that overlap no span: both in order of their starts, with the furthest span end before and the nearest span start after."""
    as_ = lambda x, kind, i: F.struct(x["start"].alias("a"), F.lit(kind).alias("cand"), x["end"].alias("e"), i.alias("i"))
    ordered = F.sort_array(F.concat(F.transform(spans, lambda x: as_(x, 0, F.lit(-1))), F.transform(cands, lambda x, i: as_(x, 1, i))))

    def kept(marks: Column) -> Column:
        ends = _scan(F.transform(marks, lambda m: F.when(m["cand"] == 0, m["e"]).otherwise(0)), F.greatest, 0)
        begins = F.reverse(_scan(F.reverse(F.transform(marks, lambda m: F.when(m["cand"] == 0, m["a"]).otherwise(_LAST))), F.least, _LAST))
        free = lambda end, begin: F.filter(marks, lambda m, k: (m["cand"] == 1) & (F.get(end, k) <= m["a"]) & (F.get(begin, k) >= m["e"]))
        own = _once(ends, lambda end: _once(begins, lambda begin: free(end, begin)))
        return F.transform(own, lambda m: F.get(cands, m["i"]))

    return F.when((F.size(cands) > 0) & (F.size(spans) > 0), _once(ordered, kept)).otherwise(cands)


# Given names of the gazetteer, words that announce a value, street words.
GIVEN = "Ahmed Alexander Alice Amelia Andrea Anna Antonio Barbara Carlos Carmen Catherine Charles Charlotte Christian Claire Daniel David Diego Elena Elizabeth Emily Emma Fatima Fernando Francisco George Hannah Hans Helen Isabel Jack James Jane Javier Jean John Jose Joseph Juan Julia Karl Laura Lucia Maria Marie Mark Martin Mary Michael Mohammed Nicole Olivia Pablo Patricia Paul Peter Pierre Robert Sarah Sofia Stefan Susan Thomas William".split()
KEYS = "password passwd passphrase pwd secret token login username user name address street account passport contact".split()
STREETS = "Street Road Avenue Lane Square Drive Platz Weg Allee Calle Rue".split()
_KEY = rf"(?i:\b(?:{'|'.join(KEYS)})(?:\x20{{0,2}}[:=]|\x20is)\x20{{0,2}}[\"'(]{{0,2}})"
_WORD = r"[^\x20\x09-\x0D]"
# a token with a digit; or a key word and what it announces; or a given name and a capitalised word
_DIGIT_TOKEN = r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_VALUE = rf"[\"'(]{{0,2}}{_KEY}{_WORD}++"
_NAME = rf"(?=[\"'(]{{0,2}}[A-Z])[\"'(]{{0,2}}(?:{'|'.join(GIVEN)})(?![A-Za-z])(?:\x20[A-Z][a-z]++)?+{_WORD}*+"
_TOKEN = rf"(?<!{_WORD})(?:{_DIGIT_TOKEN}|{_VALUE}|{_NAME})"
#: The same for texts without any digit, where no token need be read to its end.
_NO_DIGIT_TOKEN = rf"(?<!{_WORD})(?:{_VALUE}|{_NAME})"
# what goes before and after the candidate itself: the key word, quotes and brackets
_LEAD = rf"^(?:[\"'(]{{0,2}}{_KEY})?[\"'(\[{{<#*$%&!|,.;:=]*"
_TAIL = r"[\"')\]}>#*$%&!?|,.;:=]+$"

# Labelers: name, what they read, pattern for a vote of yes, pattern for a vote of no.
LABELERS = (
    # regex labelers
    ("assigned", "tok", r"^[A-Za-z_]{2,20}[=:][^=]{6,}$", r"^[0-9]{1,4}$"),
    ("access_key", "tok", r"^[A-Z]{2,5}[A-Z0-9]{12,}$", r"^[a-z]+[0-9]{1,2}$"),
    ("identity_number", "tok", r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$", r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|v?[0-9]+(?:\.[0-9]+)+)$"),
    ("long_mixed", "tok", r"^(?=.{16})(?=[^A-Za-z]*+[A-Za-z])(?:[^0-9]*+[0-9]){3}", r"^.{1,5}$"),
    # gazetteer labelers
    ("names", "tok", rf"^(?:{'|'.join(GIVEN)})(?![A-Za-z])", r"^(?i:https?:|www\.|version|page|chapter|section|fig)"),
    ("prefixes", "tok", r"^(?i:password|passwd|pwd|secret|token|apikey|api_key|akia|asia|ssn|iban|sk-|ghp_)", r"^[0-9.,:%]{1,8}$"),
    # context labelers
    ("announced", "before", _KEY + "$", r"(?i:\b(?:version|page|chapter|section|year|figure|table|license|by-nc|cc)\W{0,3})$"),
    ("addressed", "before", r"(?i:\b(?:mr|mrs|ms|dr|prof|dear|named|called|contact|call|mail|by|from|ssn|iban|passport|card|phone|key)\.?\W{0,3})$", r"(?i:\b(?:saint|san|santa|st|king|queen|license|version)\.?\W{0,3})$"),
    ("street", "after", rf"^\x20[A-Z]\w{{1,30}}\x20(?:{'|'.join(STREETS)})\b", r"^\x20(?:%|percent|years?|times|pages?)"),
)
# Features of the final classifier: what they read, pattern.
FEATURES = (
    ("tok", r"[=:]"),
    ("tok", r"^[A-Z0-9]+$"),
    ("tok", r"[a-z]"),
    ("tok", r"[0-9]"),
    ("tok", r"^.{8}"),
    ("tok", r"^.{14}"),
    ("tok", r"^.{24}"),
    ("tok", r"^(?:[^0-9]*+[0-9]){3}"),
    ("tok", r"^(?:[^0-9]*+[0-9]){7}"),
    ("tok", r"[-/]"),
    ("tok", rf"^(?:{'|'.join(GIVEN)})\x20[A-Z]"),
    ("before", _KEY + "$"),
    ("before", r"(?i:\b(?:mr|mrs|ms|dr|prof|dear)\.?\x20)$"),
    ("after", rf"^\x20[A-Z]\w{{1,30}}\x20(?:{'|'.join(STREETS)})\b"),
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the spans of every base kind, cand (array of start, end, tok, before, after) for every document; no text."""
    t = F.col("t")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    digit = t.rlike("[0-9]")
    all_ = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    some = lambda condition, pattern: F.when(condition, all_(pattern)).otherwise(F.array().cast("array<string>"))
    hits = docs.select(
        "doc_id", "t", some(F.contains(t, F.lit("@")), _EMAIL).alias("email"), some(digit, _IP).alias("ip"), some(digit, _CARD).alias("card"), some(F.contains(t, F.lit("+")), _PHONE).alias("phone"), F.when(digit, all_(_TOKEN)).otherwise(all_(_NO_DIGIT_TOKEN)).alias("token")
    )

    def checked(kind: str, pattern: str) -> Column:
        return F.transform(F.filter(_found(F.col(kind), F.split(t, pattern, -1)), lambda s: _valid(kind, s["hit"])), lambda s: F.struct(s["start"], s["end"]))

    spans = {k: checked(k, p) for k, p in zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE), strict=True)}

    def token(s: Column) -> Column:
        def bare(x: Column) -> Column:
            start = s["start"] + F.length(s["hit"]) - F.length(x)
            tok = F.regexp_replace(x, _TAIL, "")
            return F.struct(start.cast("int").alias("start"), (start + F.length(tok)).cast("int").alias("end"), tok.alias("tok"), F.right(F.concat(s["gap"], F.substr(s["hit"], F.lit(1), F.length(s["hit"]) - F.length(x))), F.lit(CONTEXT)).alias("before"), F.left(s["after"], F.lit(CONTEXT)).alias("after"))

        return _once(F.regexp_replace(s["hit"], _LEAD, ""), bare)

    gaps = F.when(digit, F.split(t, _TOKEN, -1)).otherwise(F.split(t, _NO_DIGIT_TOKEN, -1))
    tokens = F.filter(F.transform(_found(F.col("token"), gaps), token), lambda x: x["tok"].rlike(r"[\p{L}0-9]"))
    placed = hits.select("doc_id", *[v.alias(k) for k, v in spans.items()], tokens.alias("cand"))
    # the spans are bound before they are used again: an optimiser that moves them must not find them anew
    return placed.withColumn("cand", _once(F.concat(*KINDS), lambda base: _once(F.col("cand"), lambda cand: _apart(cand, base))))


def _judged(cands: DataFrame) -> DataFrame:
    """votes (a base-3 number: digit 0 abstains, 1 says yes, 2 says no) and feature bits of every candidate."""
    votes, bits = F.lit(0), F.lit(0)
    for k, (_, field, yes, no) in enumerate(LABELERS):
        votes = votes + F.when(F.col(field).rlike(yes), 3**k).when(F.col(field).rlike(no), 2 * 3**k).otherwise(0)
    for k, (field, pattern) in enumerate(FEATURES):
        bits = bits + F.when(F.col(field).rlike(pattern), 1 << k).otherwise(0)
    return cands.select(votes.cast("int").alias("votes"), bits.cast("int").alias("bits"))


def estimate(patterns: list[tuple[int, int]], rounds: int = 60) -> tuple[float, list[float], dict[int, float]]:
    """EM over (votes, count): the share of private tokens, each labeler's accuracy, a posterior per pattern.

    A labeler that votes is right with its own probability; all start at 0.8, with pseudo-counts
    that keep rare labelers there. A token that nobody votes on stays at the prior.
    """
    n = len(LABELERS)
    share, right = 0.3, [0.8] * n
    digit = lambda v, k: v // 3**k % 3
    posterior: dict[int, float] = {}
    for _ in range(rounds):
        for v, _count in patterns:
            odds = math.log(share / (1 - share))
            for k in range(n):
                if d := digit(v, k):
                    odds += (1 if d == 1 else -1) * math.log(right[k] / (1 - right[k]))
            posterior[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        total = sum(c for _, c in patterns)
        share = min(0.95, max(0.02, (3 + sum(posterior[v] * c for v, c in patterns)) / (10 + total)))
        for k in range(n):
            said = [(c, posterior[v] if digit(v, k) == 1 else 1 - posterior[v]) for v, c in patterns if digit(v, k)]
            right[k] = min(0.99, max(0.55, (16 + sum(c * p for c, p in said)) / (20 + sum(c for c, _ in said))))
    return share, right, posterior


def train(rows: list[tuple[int, float, float]], steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Logistic regression over shape bits: rows are (bits, posterior, count); weights, the bias last."""
    n = len(FEATURES)
    weights = [0.0] * (n + 1)
    total = sum(c for _, _, c in rows) or 1.0
    for _ in range(steps):
        grad = [ridge * w for w in weights]
        for bits, p, c in rows:
            on = [k for k in range(n) if bits >> k & 1] + [n]
            z = sum(weights[k] for k in on)
            d = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p) * c / total
            for k in on:
                grad[k] += d
        weights = [w - rate * 4 * g for w, g in zip(weights, grad, strict=True)]
    return weights


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, spans of every kind (email, ip, card, phone, private).

    Null or empty text has none. Spans are in code points, end exclusive. Repeated rows and null ids
    are documents of their own. An empty table gives an empty result; other columns are ignored.
    Work is in proportion to n log n of the spans and candidates of a text. Not found: names beyond
    the gazetteer's given names, and values without digits that no key word announces.
    """
    found = candidates(docs, id_col, text_col)
    found = materialise(found, "pii-candidates")
    judged = _judged(found.select(F.explode("cand").alias("x")).select("x.tok", "x.before", "x.after")).groupBy("votes", "bits").agg(F.count("*").alias("n"))
    judged = materialise(judged, "pii-votes")
    by_votes = sorted((r.votes, r.n) for r in judged.groupBy("votes").agg(F.sum("n").alias("n")).collect())  # at most 3^9 rows
    _, _, posterior = estimate(by_votes)
    table = ", ".join(f"{v}, {p!r}D" for v, p in posterior.items()) or "0, 0.5D"
    shares = judged.withColumn("p", F.element_at(F.expr(f"map({table})"), F.col("votes")) * F.col("n")).groupBy("bits").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    weights = train([(r.bits, round(r.p / r.n, 9), r.n) for r in sorted(shares.collect())])  # at most 2^14 rows

    def accepted(x: Column) -> Column:
        z = F.lit(weights[-1])
        for k, (field, pattern) in enumerate(FEATURES):
            z = z + F.when(x[field].rlike(pattern), weights[k]).otherwise(0.0)
        return z > 0

    private = F.transform(F.filter("cand", accepted), lambda x: F.struct(x["start"], x["end"]))
    return found.select("doc_id", *KINDS, private.alias(ADDED))


def _written(kinds: tuple[str, ...]) -> Column:
    def texts(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(texts, kinds)), ",")


def digest(spans: DataFrame) -> DataFrame:
    """Counts and digests of the spans; n_spans counts all kinds."""
    every = F.aggregate(F.array(*map(F.size, (*KINDS, ADDED))), F.lit(0), lambda a, x: a + x)
    return spans.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, ADDED)], every.cast("long").alias("n_spans"), F.sha2(_written(KINDS), 256).alias("base_sha256"), _written((*KINDS, ADDED)).alias("spans"))

#: The base kinds by the patterns of their definition: name, pattern, condition on hit and its digits.
_BASE_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INT WHEN digits[length(digits) - i]::INT > 4 THEN 2 * digits[length(digits) - i]::INT - 9 ELSE 2 * digits[length(digits) - i]::INT END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
)


def _sql() -> str:
    hits = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{n}' AS kind, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS gaps FROM d" for k, (n, p, _) in enumerate(_BASE_SQL))
    valid = " ".join(f"WHEN '{n}' THEN {c}" for n, _, c in _BASE_SQL)
    counts = ", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n, _, _ in _BASE_SQL)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, k, kind, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM ({hits})),
s AS (SELECT doc_id, k, kind, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits, (length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')))::BIGINT AS s FROM h),
f AS (SELECT *, s + length(hit) AS e FROM s WHERE CASE kind {valid} END),
c AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n, _, _ in _BASE_SQL)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN c USING (doc_id)"""


#: For what the definition fixes: the spans that the method adds hang on the estimate.
SQL = _sql()
