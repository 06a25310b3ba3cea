"""Near-duplicate detection by MinHash with tensored banding and full verification.

Two small collections of minhash bands are computed for each distinct shingle set; a table key is a
pair of one band from each, so that 2 * BANDS bands (of ROWS minhashes) give BANDS ** 2 tables. A
pair of similarity s meets in some table with probability (1 - (1 - s ** ROWS) ** BANDS) ** 2: at
0.8 all but two in 10^5. A table key is formed only of bands that some other node shares, which
most nodes of a corpus don't have, so the tables hold little but relatives.

Sets that are equal are one node. In each bucket a hub (its smallest node) is compared with every
other node, on full shingle sets of whole texts, and linked nodes become components. Buckets that
still hold several components form families. In a family, every node outside the largest component
is compared with all others that share a bucket with it, block by block: so every pair of a bucket is
settled, by comparison or by lying in one component, while the bulk of a group of copies, which its
hub holds together, is never paired among itself.

A bucket of more than HEAVY nodes is cut into parts with a hub each, and the hubs meet under one of
them, so that no task holds it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breachline.llm import bytescan
from breachline.llm.common import broadcast_if_small, keyed_join, materialise, ship_code, shuffle_parts

BANDS, ROWS = 16, 3
#: Buckets whose bands both have more nodes are cut into PARTS.
HEAVY, PARTS = 10_000, 64
#: Nodes on either side that a task of the last comparison holds (expected).
STRAYS, KIN = 250, 1000
#: Tables of at most this many rows are broadcast to the texts, larger ones shuffled; the second kind carries bands.
SMALL_ROWS, SMALL_BANDS = 300_000, 100_000
#: Members that are compared with a hub in one group; larger groups are split, the hub's text going to each part.
PART = 256
_rng = np.random.default_rng(77)
_MUL = _rng.integers(0, 2**63, (2, BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, (2, BANDS, ROWS), dtype=np.uint64)
_FLOAT = np.uint64(32)

SKETCH = "doc_id bigint, n_shingles bigint, digest binary, left array<bigint>, right array<bigint>"


def _binary(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _bands(all_hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per collection a (texts, BANDS) array; every text has a shingle."""
    out = []
    for side in range(2):
        bands = np.empty((len(first) - 1, BANDS), dtype=np.uint64)
        for b in range(BANDS):
            band = np.zeros(len(first) - 1, dtype=np.uint64)
            for r in range(ROWS):
                low = np.minimum.reduceat((all_hashes * _MUL[side, b, r] + _ADD[side, b, r]) >> _FLOAT, first[:-1])
                band = bytescan.mix(band + low + np.uint64(b * ROWS + r + 1))
            bands[:, b] = band
        out.append(bands.view(np.int64))
    return out


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0), _binary(batch.column(1)), 0
            for part in bytescan.batches(texts):
                own = ids.slice(at, len(part))
                at += len(part)
                hashes, first = bytescan.shingles(*bytescan.batch_word_hashes(part), k)
                has = np.flatnonzero(np.diff(first) > 0)
                sets = [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(part))]
                left, right = [None] * len(part), [None] * len(part)
                if len(has):
                    sides = _bands(hashes, np.append(first[has], first[-1]))
                    for j, i in enumerate(has):
                        left[i], right[i] = sides[0][j], sides[1][j]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [own.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "left", "right"],
                )

    return run


def _verified(k: int, percent: int):
    """Rows (hub, part, other, text), a hub's own row first: yields hub, other of links."""

    def sets(texts: list[bytes]) -> list[np.ndarray]:
        hashes, first = bytescan.shingles(*bytescan.batch_word_hashes(texts), k)
        return [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(texts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, variants = None, []
        for batch in batches:
            hubs, parts, others = (batch.column(i).to_pylist() for i in range(3))
            texts, found, at = _binary(batch.column(3)), [], 0
            for held in bytescan.batches(texts):
                for own in sets(held):
                    hub, part, other = hubs[at], parts[at], others[at]
                    at += 1
                    if (hub, part) != now:
                        now, variants = (hub, part), []
                    if other == hub:
                        variants.append(own)
                        continue
                    for mine in variants:
                        small, big = sorted((len(mine), len(own)))
                        if 100 * small < percent * big:
                            continue
                        both = len(np.intersect1d(mine, own, assume_unique=True))
                        if both and 100 * both >= percent * (len(mine) + len(own) - both):
                            found.append((hub, other))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def _compare(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (hub, other) whose texts are similar, as links (a, b)."""
    spark = pairs.sparkSession
    parts = materialise(pairs.groupBy("hub").agg(F.count("*").alias("often"), F.ceil(F.count("*") / PART).cast("int").alias("parts")), "near-hubs")
    others = keyed_join(pairs, parts, "hub", "often", SMALL_ROWS).select("hub", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), "other")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("other"))
    roles = broadcast_if_small(materialise(others.unionByName(hubs), "near-roles"), SMALL_ROWS)
    rows = docs.join(roles, docs.doc_id == roles.other, "inner").select("hub", "part", "other", "text")
    rows = rows.repartition(shuffle_parts(spark), "hub", "part").sortWithinPartitions("hub", "part", F.col("other") != F.col("hub"))
    return materialise(rows.mapInArrow(_verified(k, percent), "a bigint, b bigint"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached), for every node of links (a, b).

    Every node goes to its smallest neighbour if that is smaller, and on to the root of the tree that
    these steps form; links between roots are the next round's. A round leaves half of the nodes at most.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = materialise(links.select(*ends).filter("a <> b").distinct(), "links")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("v")).union(edges.select("b", "a"))
        up = materialise(both.groupBy("node").agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("component")), "roots")
        while True:
            above = up.select(F.col("node").alias("component"), F.col("component").alias("top"))
            jumped = materialise(up.join(above, "component").select("node", F.col("top").alias("component"), (F.col("top") != F.col("component")).alias("moved")), "roots")
            up = jumped.select("node", "component")
            if jumped.filter("moved").isEmpty():
                break
        labels = up if labels is None else labels.join(up.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        labels = materialise(labels, "labels")
        at = lambda name: up.select(F.col("node").alias(name), F.col("component").alias(f"{name}_top"))
        left = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b"))
        edges = materialise(left.filter("a <> b").select(*ends).distinct(), "links")
        if edges.isEmpty():
            return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links: components that are linked become one."""
    own = lambda name: links.join(labels, links[name] == labels.node, "left").select("a", "b", F.coalesce("component", name).alias("c"))
    ends = own("a").withColumnRenamed("c", "ca").join(own("b").withColumnRenamed("c", "cb"), ["a", "b"])
    tops = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("was"), F.col("component").alias("top"))
    old = labels.join(tops, labels.component == tops.was, "left").select("node", F.coalesce("top", "component").alias("component"))
    new = tops.join(labels, tops.was == labels.node, "left_anti").select(F.col("was").alias("node"), F.col("top").alias("component"))
    return materialise(old.unionByName(new), "labels")


def _shared_bands(classes: DataFrame, heavy: int) -> DataFrame:
    """node, left, right, li, ri: the bands that some other node has too, (index, whether more than heavy nodes have it);
    nodes without any on either side drop out."""
    side = lambda name, k: F.transform(name, lambda a, i: F.struct((i + k * BANDS).alias("i"), a.alias("band")))
    rows = classes.select("node", F.explode(F.concat(side("left", 0), side("right", 1))).alias("x")).select("node", "x.i", F.xxhash64("x.i", "x.band").alias("key"))
    common = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-bands")
    own = keyed_join(rows, common, "key", "n", SMALL_ROWS).groupBy("node")
    pick = lambda k: F.collect_list(F.when(F.floor(F.col("i") / BANDS) == k, F.struct((F.col("i") - k * BANDS).alias("i"), (F.col("n") > heavy).alias("heavy"))))
    own = materialise(own.agg(pick(0).alias("li"), pick(1).alias("ri")).filter((F.size("li") > 0) & (F.size("ri") > 0)), "near-shared")
    return classes.select("node", "left", "right").join(own, "node")


def bucket_pairs(classes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(hub, other): the hub of each bucket, its smallest node, with every other node of it; each pair once.

    In a heavy bucket the smallest node of each part is a hub, and the hub of the others is the smallest of all.
    """
    spark = classes.sparkSession

    def key(x: Column, y: Column) -> Column:
        i, j = x["i"], y["i"]
        return F.struct(F.xxhash64(i, F.get("left", i), j, F.get("right", j)).alias("key"), (x["heavy"] & y["heavy"]).alias("heavy"))

    tensor = F.flatten(F.transform("li", lambda x: F.transform("ri", lambda y: key(x, y))))
    part = F.when(F.col("x.heavy"), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    rows = _shared_bands(classes, heavy).select("node", F.explode(tensor).alias("x")).select("node", "x.key", "x.heavy", part.alias("part")).repartition(shuffle_parts(spark), "key", "part")
    stars = rows.select("key", "heavy", F.min("node").over(Window.partitionBy("key", "part")).alias("hub"), F.col("node").alias("other"))
    # of heavy buckets the parts' hubs are kept with their key
    stars = materialise(stars.select("hub", "other", F.when(F.col("heavy") & (F.col("hub") == F.col("other")), F.col("key")).alias("key")).filter("hub <> other OR key IS NOT NULL").distinct(), "near-parts")
    hubs = stars.filter("key IS NOT NULL").select("key", F.col("hub").alias("other"))
    tops = hubs.select(F.min("other").over(Window.partitionBy("key")).alias("hub"), "other").filter("hub <> other")
    return materialise(stars.filter("hub <> other").select("hub", "other").unionByName(tops).distinct(), "near-stars")


def _families(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """family, node, component, stray: nodes of components that some bucket holds together; strays are outside their family's largest.

    Every bucket's components are tied to its hub's, so a bucket never reaches beyond its family.
    """
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"))
    at = stars.join(of("hub"), "hub", "left").join(of("other"), "other", "left")
    ends = at.select("hub", "other", F.coalesce("hub_c", "hub").alias("a"), F.coalesce("other_c", "other").alias("b")).filter("a <> b")
    ends = materialise(ends, "near-open")
    family = components(ends.select("a", "b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("family"))
    alone = ends.select(F.col("hub").alias("node"), F.col("a").alias("component")).unionByName(ends.select(F.col("other").alias("node"), F.col("b").alias("component"))).filter("node = component")
    nodes = labels.select("node", "component").unionByName(alone).distinct()
    own = materialise(nodes.join(family, "component").select("node", "component", "family"), "near-families")
    largest = own.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    return own.join(largest, "family").select("family", "node", "component", (F.col("component") != F.col("main")).alias("stray"))


def _settled(k: int, percent: int):
    """Rows (family, ub, fb, stray side, node, component, stray, bands, text), sorted: yields links between components."""

    def settle(group: list[tuple]) -> list[tuple[int, int]]:
        hubs = [r for r in group if r[0]]
        kin = [r for r in group if not r[0]]
        if not hubs or not kin:
            return []
        sets: list[np.ndarray] = []
        for held in bytescan.batches([r[5] for r in hubs + kin]):
            hashes, first = bytescan.shingles(*bytescan.batch_word_hashes(held), k)
            sets += [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(held))]
        size = np.array([len(x) for x in sets])
        tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        at = np.concatenate(([0], np.cumsum(size)))
        n = len(hubs)
        kin_size, nodes, parts, stray = size[n:], np.array([r[1] for r in kin]), np.array([r[2] for r in kin]), np.array([r[3] for r in kin])
        bands = np.array([r[4] for r in kin], dtype=np.int64).reshape(len(kin), 2, BANDS)
        mark = np.zeros(tokens.max() + 1, dtype=np.int32)
        out = []
        for i, (_, node, part, _, own, _) in enumerate(hubs):
            mine = size[i]
            likely = (parts != part) & ~(stray & (nodes < node)) & (100 * np.minimum(kin_size, mine) >= percent * np.maximum(kin_size, mine))
            met = (bands == np.array(own, dtype=np.int64).reshape(2, BANDS)).any(axis=2).all(axis=1)  # some bucket holds both
            likely = np.flatnonzero(likely & met)
            if not len(likely):
                continue
            mark[tokens[at[i] : at[i + 1]]] = 1
            both = np.array([mark[tokens[at[n + j] : at[n + j + 1]]].sum() for j in likely])
            mark[tokens[at[i] : at[i + 1]]] = 0
            linked = likely[100 * both >= percent * (mine + kin_size[likely] - both)]
            for j in linked[np.unique(parts[linked], return_index=True)[1]]:  # one link to each component will do
                out.append((node, int(nodes[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def links() -> pa.RecordBatch:
            found = settle(group)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(8)), _binary(batch.column(8)), strict=True)
            for family, ub, fb, *row in rows:
                if (family, ub, fb) != now:
                    if group:
                        yield links()
                    now, group = (family, ub, fb), []
                group.append(tuple(row))
        if group:
            yield links()

    return run


def _settle(families: DataFrame, bands: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between strays and nodes of other components of their families."""
    spark = docs.sparkSession
    families = materialise(families.join(bands, "node"), "near-kin")
    blocks = families.groupBy("family").agg(F.ceil(F.sum(F.col("stray").cast("int")) / STRAYS).cast("int").alias("ubs"), F.ceil(F.count("*") / KIN).cast("int").alias("fbs"))
    own = families.join(blocks, "family")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hubs = own.filter("stray").select("family", block("ubs").alias("ub"), all_("fbs").alias("fb"), F.lit(True).alias("side"), "node", "component", "stray", "bands")
    kin = own.select("family", all_("ubs").alias("ub"), block("fbs").alias("fb"), F.lit(False).alias("side"), "node", "component", "stray", "bands")
    roles = broadcast_if_small(materialise(hubs.unionByName(kin), "near-roles"), SMALL_BANDS)
    rows = docs.join(roles, docs.doc_id == F.col("node"), "inner").select("family", "ub", "fb", "side", "node", "component", "stray", "bands", "text")
    rows = rows.repartition(shuffle_parts(spark), "family", "ub", "fb").sortWithinPartitions("family", "ub", "fb")
    return materialise(rows.mapInArrow(_settled(k, percent), "a bigint, b bigint"), "near-more")


def near_dedup(docs: DataFrame, k: int = 4, percent: int = 80, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A-Z count as a-z; words are runs without blanks. A text of fewer than k words has one shingle;
    without words or text it has none and is linked with nothing. Rows that share a doc_id are
    variants of one document, linked if any of them is. A null id belongs to no component and is
    kept. An empty table gives an empty result; other columns of docs are ignored.

    A link between two documents that no chain of other links holds together is found if they meet
    in a bucket: at a similarity of 0.8 all but 2 in 10^5 do, at 0.9 all but 1 in 10^8. What is linked
    is always confirmed on full sets.
    """
    ship_code(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialise(docs.mapInArrow(_sketches(k), SKETCH), "sketches")
    named = sketch.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("left").alias("left"), F.first("right").alias("right"))
    classes = materialise(classes, "classes")
    stars = bucket_pairs(classes, heavy)
    own = materialise(sketch.join(classes.select("digest", "node"), "digest", "left").select("doc_id", "n_shingles", "node"), "near-own")
    # nodes that hold variants of one document are linked as they stand
    variants = own.filter("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.collect_set("node").alias("b")).filter("a <> z")
    equal = variants.select("a", F.explode("b").alias("b"))
    labels = components(_compare(stars, docs, k, percent).unionByName(equal))
    bands = classes.select("node", F.concat("left", "right").alias("bands"))
    more = _settle(_families(stars, labels), bands, docs, k, percent)
    if not more.isEmpty():
        labels = _joined(labels, more)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    found = own.join(labels.select("node", "component"), "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, array_to_string(ws, ' ') AS g FROM w WHERE len(ws) BETWEEN 1 AND 3
  UNION
  SELECT doc_id, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] || ' ' || ws[p + 3] FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS p FROM w WHERE len(ws) > 3)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r(u, v) AS (
  SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), c AS (SELECT u, least(u, min(v)) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id
"""
