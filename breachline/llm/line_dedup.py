"""Line dedup by a tree of log templates.

A line falls through a tree: first by its number of tokens, then by the words of one of BLOCKS
stretches of it. Tokens that hold a digit are variable from the start. Lines that vary in at most
FIELDS tokens share at least one stretch, so they meet in some leaf. There tokens are counted by
position, and the rarest 1, 2, .. FIELDS tokens of a line (at most SHARE of it) are variable by
turns, wherever they stand; each choice is a template, told by its fixed tokens and their places.

A template that occurs in at least ``min_docs`` documents is boilerplate, and so is a line of one word
or more that occurs as it is in EXACT_DOCS: the first occurrence (the smallest id) stays, and later
documents lose the line.

Keys of lines and leaves are made in Arrow batches; counting them is Spark's. A leaf that holds more
than CELLS tokens is not brought to one task: its tokens are counted and ranked by aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachline.llm import bytescan
from breachline.llm.common import BLANKS, broadcast_if_small, keyed_join, materialise, ship_code, shuffle_parts

#: Tokens of a line that may vary besides those with digits, in number and as a share; one stretch more than that.
FIELDS, SHARE = 4, 0.4
BLOCKS = FIELDS + 1
#: Shorter lines have no template but their words as they are.
LEAST = 3
#: Documents that share a generalised template, and those that share the words of a line as they are.
MIN_DOCS = 3
EXACT_DOCS = 2
#: Kinds of keys, in their last two bits: masked whole lines, words as they are, leaves.
WHOLE, EXACT, LEAF = 0, 1, 2
#: Tables of at most this many rows (of some dozen bytes) are broadcast, larger ones shuffled.
SMALL_ROWS = 500_000
#: Tokens of a leaf that one task may hold.
CELLS = 2_000_000
_U = np.uint64
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_VARIABLE = _U(0x5DEECE66D1234567)
_STEP = _U(0x9E3779B97F4A7C15)


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, the same with one value for words that hold a digit, and the line (from 0) it stands in."""
    plain, masked, line, newlines = [], [], [], 0
    for piece in bytescan.pieces(text):
        buf = np.frombuffer(piece, dtype=np.uint8)
        start, end = bytescan.word_spans(buf)
        h = bytescan.span_hashes(bytescan.prefix_hashes(bytescan.BYTE[buf]), start, end)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
        breaks = np.flatnonzero(buf == 10)
        plain.append(h)
        masked.append(np.where(digits[end] > digits[start], _VARIABLE, h))
        line.append(np.searchsorted(breaks, start) + newlines)
        newlines += len(breaks)
    return np.concatenate(plain), np.concatenate(masked), np.concatenate(line)


def _kind(keys: np.ndarray, kind: int) -> np.ndarray:
    return (bytescan.mix(keys) & ~_U(3)) | _U(kind)


def line_keys(text: bytes, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Lines (from 0) and keys: words as they are, the template with digits masked, and one leaf per stretch."""
    plain, masked, line = _words(text)
    if not len(line):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    end = np.append(start[1:], len(line))
    n, number = end - start, line[start]
    c, cm = bytescan.prefix_hashes(plain), bytescan.prefix_hashes(masked)
    at, keys = [number], [_kind(bytescan.span_hashes(c, start, end), EXACT)]
    long = n >= least
    start, end, n, number = start[long], end[long], n[long], number[long]
    at.append(number)
    keys.append(_kind(bytescan.span_hashes(cm, start, end) + _STEP, WHOLE))
    blocks = np.minimum(n, BLOCKS)
    for k in range(BLOCKS):
        some = blocks > k
        s, m, b = start[some], n[some], blocks[some]
        stretch = bytescan.span_hashes(cm, s + m * k // b, s + m * (k + 1) // b)
        at.append(number[some])
        keys.append(_kind(stretch + (m.astype(np.uint64) * _U(BLOCKS) + _U(k + 2)) * _STEP, LEAF))
    return np.concatenate(at), np.concatenate(keys)


def _keys(least: int):
    """Rows (doc_id, hash, text) to (doc_id, hash, line numbers, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in bytescan.slices(b, 2, bytescan.CHUNK)):
            texts = [b"" if t is None else t for t in batch.column(2).cast(pa.binary()).to_pylist()]
            # one buffer for all texts of the slice: the lines of a text are a range of its lines
            lines, keys = line_keys(b"\n".join(texts), least)
            order = np.argsort(lines, kind="stable")
            lines, keys = lines[order], keys[order]
            first = np.concatenate(([0], np.cumsum([t.count(b"\n") + 1 for t in texts])))
            cut = np.searchsorted(lines, first)
            own = lines - np.repeat(first[:-1], np.diff(cut))
            offsets = pa.array(cut, pa.int32())
            at = pa.ListArray.from_arrays(offsets, pa.array(own, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))], names=["doc_id", "hash", "at", "keys"])

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, hash, text, spots) to a row per spot, with a code for each token at its place."""
    for batch in (x for b in batches for x in bytescan.slices(b, 2, bytescan.CHUNK)):
        rows, codes = [], []
        for i, (text, spots) in enumerate(zip(batch.column(2).cast(pa.binary()), batch.column(3), strict=True)):
            _, masked, line = _words(text.as_py())
            for spot in spots.as_py():
                low, high = np.searchsorted(line, [spot["line"], spot["line"] + 1])
                rows.append((i, spot["line"], spot["leaf"], spot["n"], spot["words"]))
                codes.append(bytescan.mix(masked[low:high] + np.arange(high - low, dtype=np.uint64) * _STEP).view(np.int64))
        own, line, leaf, n, words = zip(*rows, strict=True) if rows else [()] * 5
        pick = pa.array(own, pa.int64())
        columns = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(line, pa.int32()), pa.array(leaf, pa.int64()), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(codes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "line", "leaf", "n", "words", "codes"])


def most_fields(tokens: int) -> int:
    """How many tokens of a line of so many may vary."""
    return min(FIELDS, max(1, int(tokens * SHARE)))


def left_over(codes: np.ndarray) -> np.ndarray:
    """Per line of a leaf (a row of codes) and v = 1, 2, ..: the exclusive or of the codes but the v rarest (ties by place)."""
    _, number, counts = np.unique(codes, return_inverse=True, return_counts=True)
    often = counts[number.reshape(codes.shape)]
    rare = np.argsort(often, axis=1, kind="stable")[:, : most_fields(codes.shape[1])]
    gone = np.bitwise_xor.accumulate(np.take_along_axis(codes, rare, axis=1), axis=1)
    return np.bitwise_xor.reduce(codes, axis=1)[:, None] ^ gone


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _codes, leaf by leaf, to rows (doc_id, hash, line, n, words, tokens, rest)."""
    names = ["doc_id", "hash", "line", "n", "words", "tokens", "rest"]

    def leaf(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        codes = held.column(6).flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
        rest = left_over(codes)
        again = pa.array(np.repeat(np.arange(held.num_rows), rest.shape[1]))
        tokens = pa.array(np.full(rest.size, codes.shape[1], dtype=np.int32))
        return pa.RecordBatch.from_arrays([*(held.column(k).take(again) for k in (0, 1, 2, 4, 5)), tokens, pa.array(rest.ravel())], names=names)

    parts: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        leaves = batch.column(3).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], leaves[1:] != leaves[:-1], [True])))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if parts and leaves[s] != now:
                yield leaf(parts)
                parts = []
            now = leaves[s]
            parts.append(batch.slice(s, e - s))
    if parts:
        yield leaf(parts)


def _templates_of_large(spots: DataFrame) -> DataFrame:
    """The same rows for leaves that no task should hold."""
    own = ["doc_id", "hash", "line", "leaf", "n", "words"]
    each = spots.select(*own, F.posexplode("codes").alias("pos", "code"))
    counts = materialise(each.groupBy("leaf", "code").agg(F.count("*").alias("often")), "line-counts")
    ranked = each.join(broadcast_if_small(counts, SMALL_ROWS), ["leaf", "code"])
    ranked = ranked.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("often", "pos", "code"))).alias("t"))
    n = F.size("t")
    most = F.least(F.lit(FIELDS), F.greatest(F.lit(1), F.floor(n * SHARE))).cast("int")
    rest = lambda v: F.aggregate(F.slice("t", v + 1, n - v), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["code"]))
    return ranked.select("doc_id", "hash", "line", "n", "words", n.alias("tokens"), F.explode(F.transform(F.sequence(F.lit(1), most), rest)).alias("rest"))


def _fields(spots: DataFrame, words: DataFrame, id_type: str, min_docs: int) -> DataFrame:
    """doc_id, hash, line: the lines among spots that templates with variable fields drop; words has (words, doc_id)."""
    spark = spots.sparkSession
    sizes = spots.groupBy("leaf").agg(F.sum(F.size("codes").cast("long")).alias("cells")).filter(F.col("cells") > CELLS)
    large = materialise(sizes.select("leaf"), "line-large-leaves")
    small = spots.join(broadcast_if_small(large, SMALL_ROWS), "leaf", "left_anti").select(*spots.columns)
    met = small.repartition(shuffle_parts(spark), "leaf").sortWithinPartitions("leaf")
    rows = met.mapInArrow(_templates, f"doc_id {id_type}, hash bigint, line int, n bigint, words bigint, tokens int, rest bigint")
    if not large.isEmpty():
        rows = rows.unionByName(_templates_of_large(spots.join(broadcast_if_small(large, SMALL_ROWS), "leaf", "left_semi").select(*spots.columns)))
    keyed = materialise(rows.select("doc_id", "hash", "line", "n", "words", F.xxhash64("tokens", "rest").alias("key")).distinct(), "line-keyed")
    # a line of min_docs documents is enough by itself; those of fewer are told one by one
    few = keyed.filter(F.col("n") < min_docs)
    told = few.select("key", "doc_id").unionByName(few.filter("words IS NOT NULL").select("key", "words").join(words, "words").select("key", "doc_id"))
    docs = told.distinct().groupBy("key").agg(F.count("*").alias("docs"))
    held = keyed.groupBy("key").agg(F.max("n").alias("n"), F.min("doc_id").alias("first")).join(docs, "key", "left")
    shared = held.filter(F.greatest(F.col("n"), F.coalesce("docs", F.lit(0))) >= min_docs)
    shared = materialise(shared.select("key", "first"), "line-fields")
    return keyed.join(broadcast_if_small(shared, SMALL_ROWS), "key").filter(F.col("first") < F.col("doc_id")).select("doc_id", "hash", "line").distinct()


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (of the text), line (place from 0): the lines that later documents lose. Null ids and null texts lose none."""
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    keys = materialise(own.mapInArrow(_keys(least), f"doc_id {id_type}, hash bigint, at array<int>, keys array<bigint>"), "line-keys")
    # a template counts once per document: the rows of an id are put together, equal rows once
    again = keys.groupBy("doc_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1).select("doc_id")
    again = broadcast_if_small(materialise(again, "line-repeated"), SMALL_ROWS)
    several = keys.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "hash"])
    single = keys.join(again, "doc_id", "left_anti")
    own_keys = single.select("doc_id", F.array_distinct("keys").alias("keys"))
    own_keys = own_keys.unionByName(several.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")))
    kind = F.col("key").bitwiseAND(3)
    enough = F.when(kind == EXACT, min(EXACT_DOCS, min_docs)).otherwise(min_docs)
    shared = own_keys.select("doc_id", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("often"), F.min("doc_id").alias("first"))
    # all lines of a template meet in some leaf, so that leaf has as many documents at least
    shared = materialise(shared.filter(F.col("often") >= enough), "line-templates")
    zipped = F.explode(F.arrays_zip("at", "keys")).alias("x")
    at = single.unionByName(several).select("doc_id", "hash", zipped).select("doc_id", "hash", F.col("x.at").alias("line"), F.col("x.keys").alias("key"))
    found = materialise(keyed_join(at, shared, "key", "often", SMALL_ROWS), "line-found")
    lost = materialise(found.filter((kind != LEAF) & (F.col("first") < F.col("doc_id"))).select("doc_id", "hash", "line").distinct(), "line-lost")
    # the first copy of each line goes on to the leaves, with the number of documents that its words stand in
    spot = ["doc_id", "hash", "line"]
    words = found.filter(kind == EXACT).select(*spot, F.col("key").alias("words"), F.col("often").alias("n"))
    leaves = found.filter(kind == LEAF).select(*spot, F.col("key").alias("leaf"))
    open_ = leaves.join(broadcast_if_small(lost, SMALL_ROWS), spot, "left_anti").join(words, spot, "left")
    open_ = materialise(open_.select(*spot, "leaf", "words", F.coalesce("n", F.lit(1)).alias("n")), "line-leaves")
    # one line alone in its leaf has no template but its own words
    full = open_.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n").alias("docs")).filter((F.col("lines") > 1) & (F.col("docs") >= min_docs))
    open_ = open_.join(broadcast_if_small(materialise(full.select("leaf"), "line-full-leaves"), SMALL_ROWS), "leaf", "left_semi")
    spots = open_.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("line", "leaf", "n", "words")).alias("spots"))
    spots = materialise(spots, "line-spots")
    texts = own.join(broadcast_if_small(spots, SMALL_ROWS, F.size("spots")), ["doc_id", "hash"])
    # equal rows of an id hold the same lines
    texts = texts.join(again, "doc_id", "left_anti").unionByName(texts.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "hash"]))
    texts = texts.select("doc_id", "hash", "text", "spots").mapInArrow(_codes, f"doc_id {id_type}, hash bigint, line int, leaf bigint, n bigint, words bigint, codes array<bigint>")
    told = words.filter(F.col("n") < min_docs).select("words", "doc_id").distinct()
    return lost.unionByName(_fields(materialise(texts, "line-open"), told, id_type, min_docs)).distinct()


def _without(lines: Column, lost: Column) -> Column:
    """The lines whose places are not in lost (ascending): a flag for each place up to the last, so that the work is linear."""
    before = lambda i: F.coalesce(F.get(lost, i - 1), F.lit(-1))
    flags = F.flatten(F.transform(lost, lambda at, i: F.concat(F.array_repeat(F.lit(False), at - before(i) - 1), F.array(F.lit(True)))))
    return F.get(F.transform(F.array(flags), lambda gone: F.filter(lines, lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False)))), F.lit(0))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs with text less its recurring lines, and n_lines, n_dropped.

    Lines are split at ``\\n``. Templates are for lines of ``least`` tokens and more, in at least
    ``min_docs`` documents; shorter lines are dropped by their words as they are, from two documents on.
    A document that loses no line keeps its text as it was, null too. One that loses all lines with
    words has an empty text. Rows that repeat an id are one document for counting; each loses its own
    lines. A null id loses nothing and counts for nothing. An empty table gives an empty result.
    Columns named n_lines or n_dropped are replaced; other columns may have any names.
    """
    ship_code(docs.sparkSession)
    lost = recurring(docs, min_docs, least, id_col, text_col).groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list("line")).alias("lost"))
    lost = broadcast_if_small(materialise(lost, "lost-lines"), SMALL_ROWS, F.size("lost"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"))
    joined = rows.join(lost, ["doc_id", "hash"], "left")
    text = F.col("row")[text_col]
    some = lambda kept: F.when(F.exists(kept, lambda x: F.length(F.btrim(x, F.lit("".join(BLANKS)))) > 0), F.array_join(kept, "\n")).otherwise(F.lit(""))
    cut = F.get(F.transform(F.array(_without(F.split(text, "\n"), F.col("lost"))), some), F.lit(0))
    joined = joined.select("row", F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n"), F.when(F.col("lost").isNotNull(), cut).alias("cut"))
    n_lines: Column = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    out = [(F.when(F.col("n") > 0, F.col("cut")).otherwise(text) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*out, n_lines.alias("n_lines"), F.col("n").alias("n_dropped"))


#: Templates as strings. Documents with one id each, as in the table.
SQL = rf"""
WITH l AS (
  SELECT doc_id, k AS line, list_filter(regexp_split_to_array(ls[k + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))
), t AS (
  SELECT doc_id, line, len(w) AS n, array_to_string(w, ' ') AS w, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM l WHERE len(w) > 0
), e AS (SELECT w, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM t GROUP BY w),
h AS (SELECT n, array_to_string(m, ' ') AS m, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM t WHERE n >= {LEAST} GROUP BY ALL),
plain AS (
  SELECT DISTINCT doc_id, line FROM t JOIN e USING (w) WHERE docs >= 2 AND first < doc_id
  UNION SELECT doc_id, line FROM t JOIN h ON h.n = t.n AND h.m = array_to_string(t.m, ' ') WHERE docs >= {MIN_DOCS} AND first < doc_id
), leaf AS (
  SELECT doc_id, line, w, m, n, hash(n, b, m[n * b // blocks + 1 : n * (b + 1) // blocks]) AS leaf
  FROM (SELECT *, least(n, {BLOCKS}) AS blocks, unnest(range(least(n, {BLOCKS}))) AS b FROM t ANTI JOIN plain USING (doc_id, line) WHERE n >= {LEAST})
), full_ AS (SELECT leaf FROM leaf GROUP BY leaf HAVING count(*) > 1),
k AS (SELECT leaf, doc_id, line, n, w, unnest(range(n)) AS p, unnest(m) AS x FROM leaf SEMI JOIN full_ USING (leaf)),
c AS (SELECT leaf, p, x, count(*) AS often FROM k GROUP BY ALL),
r AS (SELECT k.*, row_number() OVER (PARTITION BY k.leaf, doc_id, line ORDER BY often, k.p) AS r FROM k JOIN c ON c.leaf = k.leaf AND c.p = k.p AND c.x = k.x),
v AS (SELECT doc_id, line, w, n, v, string_agg(p || ' ' || x, ' ' ORDER BY p) AS rest FROM r JOIN (SELECT unnest(range(1, {FIELDS} + 1)) AS v) ON r > v AND v <= greatest(1, floor(n * {SHARE})) GROUP BY leaf, doc_id, line, w, n, v),
s AS (SELECT n, rest, min(v.doc_id) AS first, count(DISTINCT o.doc_id) AS docs FROM (SELECT DISTINCT doc_id, w, n, rest FROM v) v JOIN (SELECT DISTINCT w, doc_id FROM t) o USING (w) GROUP BY n, rest),
lost AS (SELECT doc_id, line FROM plain UNION SELECT v.doc_id, v.line FROM v JOIN s USING (n, rest) WHERE docs >= {MIN_DOCS} AND first < v.doc_id),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY line) AS text, max(x SIMILAR TO '(.|\n)*[^\x20\x09-\x0D](.|\n)*') AS some FROM (
  SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents SEMI JOIN lost USING (doc_id))) ANTI JOIN lost USING (doc_id, line) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n_dropped FROM lost GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN d.text WHEN k.some THEN k.text ELSE '' END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
