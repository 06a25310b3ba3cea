"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document's expected copies are its source's target over its source's size; whole copies are
certain, and the fraction is rounded by the pivotal method: two fractional documents meet, and mass
(fraction times size) moves from one to the other, in a random direction that keeps both
expectations, until one of them is integral. The other goes on to meet the next. Buckets of a
bounded number of documents do this side by side, each leaving one fractional document at most, and
a reduction tree does the same with what buckets leave, until each source has one at most. That one
is cut to the words that are missing, or rounded to a whole copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breachline.llm.common import WORD_REGEX, broadcast_if_small, materialise, shuffle_parts

#: Documents in a bucket of the first level (expected), and buckets that meet in a node of the tree.
BUCKET = 256
FAN_IN = 64
#: Fractions this near to an integer count as integral.
EPS = 1e-9
#: Decisions on at most this many rows are broadcast to the documents, larger ones shuffled.
SMALL_ROWS = 500_000


def _turns(per: DataFrame) -> DataFrame:
    """per with ``turn``, the place (from 0) of each source in code-point order, null last; no task sorts all of them."""
    order = F.col("source").asc_nulls_last()
    spread = per.repartitionByRange(shuffle_parts(per.sparkSession), order).withColumn("part", F.spark_partition_id())
    spread = materialise(spread, "mix-sources")
    sizes = sorted((r.part, r.n) for r in spread.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, at = [], 0
    for part, n in sizes:
        before.append(f"{part}, {at}L")
        at += n
    offset = F.element_at(F.expr(f"map({', '.join(before) or '0, 0L'})"), F.col("part"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return spread.withColumn("turn", offset + within - 1).drop("part")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, n (documents), source_size, target: weights by turns over the sources in code-point order, null last.

    Targets share the total by weight; a source stops at cap times its size and its excess is shared
    anew: every target is min(cap * size, level * weight). The level starts at its share of all and
    rises, as long as it leaves more sources capped than before.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights)).cast("int"))
    per = materialise(_turns(per).withColumn("w", weight).withColumn("most", F.col("source_size") * float(cap)), "mix-weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, known = 0.0, -1
    while True:
        capped = F.col("most") <= F.col("w") * level
        row = per.agg(F.count(F.when(capped, 1)).alias("n"), F.sum(F.when(capped, F.col("most"))).alias("most"), F.sum(F.when(~capped, F.col("w"))).alias("w")).first()
        if row.n == known or not row.w:
            break
        level, known = (total - (row.most or 0.0)) / row.w, row.n
    return per.select("source", "n", "source_size", F.least(F.col("most"), F.col("w") * level).alias("target"))


def _draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the document and the seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _pivot(items: Column, seed: int) -> Column:
    """items: array of (id, size, p), 0 < p < 1. Returns the array with every p but one made 0 or 1.

    Keeps the sum of size * p. The running document meets the next one: mass m1 may move to it
    with probability m2 / (m1 + m2), or m2 from it else.
    """
    item = "struct<id:bigint,size:bigint,p:double>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("run"))

    def made(x: Column, p: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["size"].alias("size"), p.cast("double").alias("p"))

    def step(acc: Column, x: Column) -> Column:
        run = acc["run"]
        a, b = run["size"] * run["p"], x["size"] * x["p"]
        fill_a, fill_b = run["size"] - a, x["size"] - b
        m1, m2 = F.least(a, fill_b), F.least(fill_a, b)  # from run to x, from x to run
        forth = _draw(x["id"], seed) * (m1 + m2) < m2
        new_run = made(run, F.when(forth, (a - m1) / run["size"]).otherwise((a + m2) / run["size"]))
        new_x = made(x, F.when(forth, (b + m1) / x["size"]).otherwise((b - m2) / x["size"]))
        pair = F.struct(new_run.alias("r"), new_x.alias("x"))
        settled = lambda p: (p < EPS) | (p > 1 - EPS)  # noqa: E731

        def after(t: Column) -> Column:
            out, on = F.when(settled(t["r"]["p"]), t["r"]).otherwise(t["x"]), F.when(settled(t["r"]["p"]), t["x"]).otherwise(t["r"])
            both = settled(t["r"]["p"]) & settled(t["x"]["p"])
            return F.struct(
                F.concat(acc["done"], F.when(both, F.array(t["r"], t["x"])).otherwise(F.array(out))).alias("done"),
                F.when(both, F.lit(None).cast(item)).otherwise(on).alias("run"),
            )

        moved = F.get(F.transform(F.array(pair), after), F.lit(0))
        return F.when(run.isNull(), F.struct(acc["done"].alias("done"), x.alias("run"))).otherwise(moved)

    return F.aggregate(items, start, step, lambda acc: F.when(acc["run"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["run"]))))


def _settle(level: DataFrame, seed: int) -> DataFrame:
    """One level: the fractional documents of each (source, node) meet; returns source, node, id, size, p."""
    items = F.sort_array(F.collect_list(F.struct(_draw(F.col("id"), seed + 7).alias("o"), "id", "size", "p")))
    met = level.groupBy("source", "node").agg(items.alias("items"))
    bare = F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["p"].alias("p")))
    return met.select("source", "node", F.explode(_pivot(bare, seed)).alias("x")).select("source", "node", "x.id", "x.size", "x.p")


def decisions(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 11, cut: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, source, size, source_size, target, copies. See mix."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_REGEX)).cast("long")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    sizes = materialise(sizes, "mix-sizes")
    per = source_targets(sizes, weights, cap)
    # a key for each row, also among repeated ids; equal rows are told apart by rank alone
    twin = Window.partitionBy("doc_id", "text_hash", "source", "size").orderBy("size")
    keyed = sizes.withColumn("rank", F.row_number().over(twin)).withColumn("id", F.xxhash64("doc_id", "text_hash", "source", "rank"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("long")
    per = per.select("source", "source_size", "target", buckets.alias("buckets"))
    rate = F.coalesce(F.least(F.lit(float(cap)), F.try_divide("target", "source_size")), F.lit(0.0))
    rows = keyed.alias("k").join(per.alias("p"), F.col("k.source").eqNullSafe(F.col("p.source")), "inner")
    rows = rows.select("doc_id", "text_hash", "id", "size", F.col("k.source").alias("source"), "source_size", "target", "buckets", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))
    rows = materialise(rows.withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))), "mix-rows")
    open_ = F.col("p").between(EPS, 1 - EPS)
    level = rows.filter((F.col("size") > 0) & F.col("part").between(EPS, 1 - EPS)).select("source", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("buckets")).alias("node"), "id", "size", F.col("part").alias("p"))
    depth, most = 0, rows.agg(F.max("buckets")).first()[0] or 1
    settled = None
    while True:
        got = materialise(_settle(level, seed + 100 * depth), f"mix-level{depth}")
        done = got if most <= 1 else got.filter(~open_)
        settled = done if settled is None else settled.unionByName(done)
        if most <= 1:
            break
        level = got.filter(open_).withColumn("node", F.floor(F.col("node") / FAN_IN))
        depth, most = depth + 1, -(-most // FAN_IN)
    share = F.when(F.col("p") > 1 - EPS, 1.0).when(F.col("p") < EPS, 0.0).otherwise(F.col("p") if cut else (_draw(F.col("id"), seed + 3) < F.col("p")).cast("double"))
    # the hash alone might meet another row's among very many documents
    chosen = settled.select(F.col("id").alias("cid"), F.col("source").alias("csource"), F.col("size").alias("csize"), share.alias("share"))
    same = (rows.id == chosen.cid) & (rows["size"] == chosen.csize) & rows.source.eqNullSafe(chosen.csource)
    copies = F.col("whole") + F.coalesce("share", F.lit(0.0))
    return rows.join(chosen, same, "left").select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 11, cut: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken.

    Null or empty text has size 0 and is taken zero times. A null source is a source of its own,
    last in order. Repeated rows are documents of their own. copies is fractional for at most one
    document of each source if ``cut`` (taken is then that share of its words, rounded), else whole.
    Draws depend on row keys and the seed alone, so reruns agree. An empty table gives an empty
    result; other columns of docs are ignored.
    """
    taken = F.least(F.col("size") * cap, F.round(F.col("copies") * F.col("size")).cast("long"))
    return decisions(docs, weights, cap, seed, cut, id_col, text_col, source_col).select("doc_id", "size", "source_size", "target", "copies", taken.alias("taken"))


def taken_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it, whole.

    Rows that share id, text and source have decisions of their own, given out in order of a hash of all columns.
    """
    own = [F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(source_col).alias("s")]
    copies = F.sort_array(F.collect_list(F.col("copies").cast("int")), asc=False)
    made = decisions(docs, weights, cap, seed, False, id_col, text_col, source_col)
    made = made.groupBy(F.col("doc_id").alias("ti"), F.col("text_hash").alias("th"), F.col("source").alias("ts")).agg(copies.alias("copies")).filter("copies[0] > 0")
    made = broadcast_if_small(materialise(made, "mix-taken"), SMALL_ROWS, F.size("copies"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    met = docs.select(row.alias("row"), *own).join(made, F.col("i").eqNullSafe(F.col("ti")) & (F.col("h") == F.col("th")) & F.col("s").eqNullSafe(F.col("ts")))
    one = met.filter(F.size("copies") == 1).select("row", F.col("copies")[0].alias("n"))
    rank = F.row_number().over(Window.partitionBy("i", "h", "s").orderBy(F.xxhash64("row")))
    several = met.filter(F.size("copies") > 1).withColumn("k", rank).select("row", F.get("copies", F.col("k") - 1).alias("n"))
    each = one.unionByName(several).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^ 	-]+', 'w', 'g'), '[ 	-]', '', 'g'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [1.0::DOUBLE, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, sum(sum(size)) OVER () AS total FROM d GROUP BY source
), r(k, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, (SELECT (max(total) - coalesce(sum(CASE WHEN 3 * source_size <= w * level THEN 3 * source_size END), 0)) / sum(CASE WHEN 3 * source_size <= w * level THEN 0 ELSE w END) FROM s)::DOUBLE FROM r WHERE k < 40
), t AS (SELECT source, source_size, least(3.0 * source_size, w * (SELECT level FROM r WHERE k = 40))::DOUBLE AS target FROM s)
SELECT doc_id, size, source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
