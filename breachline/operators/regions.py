"""Reachability and executions region by region, for graphs too large to send around.

A region is a connected part of the exploit graph, whatever the direction of its edges. Attackers don't
leave the regions they start in, so a region's edges, flaws and attackers meet in one task, which searches
for many attackers at once and sends pairs on without keeping them. Nothing grows with the number of
pairs but the output. Regions are known by hashes of host names; where two hashes collide, two regions
are searched together, which changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachline.plans.lineage import sent, stored

#: Edges of a region that a task can hold; graphs with a larger region are searched by rounds.
REGION_EDGES = 3_000_000
#: Edges times attackers of a region for one task; beyond that its attackers are dealt out, each share beside a copy of the edges.
SHARE = 50_000_000
#: Cells (hosts or edges times attackers) searched at once.
CELLS = 4_000_000
#: Rows of small regions that are searched together, pairs of longs contracted at once, rows of a batch sent on.
TOGETHER, HELD, BATCH = 500, 2_000_000, 100_000
#: Hosts whose regions (two longs each) are sent to all executors.
SENT_LABELS = 300_000

WAY, FLAW, START, GOAL = 0, 1, 2, 3
EXEC = ["attacker_id", "compromised_host", "obtained_privilege"]
STEP = [*EXEC, "kind", "cve", "service", "source", "priv"]
#: The rank of what is not held.
NEVER = np.iinfo(np.int32).max


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and for each the smallest node connected with it."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[label]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(label, up := label[label]):
            label = up


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for all nodes that aren't roots, by the edges of a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def forest() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
        return nodes[nodes != root], root[nodes != root]

    n, kept = 0, 0
    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        n += batch.num_rows
        if n >= HELD + 2 * kept:
            held = [forest()]
            n = kept = len(held[0][0])
    if held:
        a, b = forest()
        for low in range(0, len(a), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(a[low : low + BATCH]), pa.array(b[low : low + BATCH])], names=["a", "b"])


def labels(edges: DataFrame) -> DataFrame:
    """(node, region) of the hosts of edges (src, dst), by hash; a host that is not there is its own region's name.

    Each task contracts its edges to trees, and trees of eight tasks are contracted together until one
    task has them all: at the end two longs a host.
    """
    pairs = edges.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b")).filter("a <> b")
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    trees = pairs.mapInArrow(_contracted, "a bigint, b bigint")
    while parts > 1:
        parts = -(-parts // 8)
        trees = trees.repartition(parts).mapInArrow(_contracted, "a bigint, b bigint")
    return trees.coalesce(1).mapInArrow(_contracted, "a bigint, b bigint").select(F.col("a").alias("node"), F.col("b").alias("region"))


class Regions:
    """The regions of a graph, and what is dealt out by them."""

    def __init__(self, edges: DataFrame, region_edges: int | None = None):
        self.labels = sent(stored(labels(edges)), SENT_LABELS)
        self.sizes = stored(self.located(edges.select("src"), "src").groupBy("region").agg(F.count("*").alias("edges")))
        largest = self.sizes.agg(F.max("edges")).first()[0] or 0
        self.fit = largest <= (REGION_EDGES if region_edges is None else region_edges)

    def located(self, df: DataFrame, host: str) -> DataFrame:
        """df with the region of a host."""
        node = F.xxhash64(host)
        return df.withColumn("node", node).join(self.labels, "node", "left").withColumn("region", F.coalesce("region", "node")).drop("node")

    def dealt(self, ways: DataFrame, flaws: DataFrame | None, starts: DataFrame, goals: DataFrame | None = None, share: int | None = None) -> DataFrame:
        """Rows (region, slice, kind, world, a, b, c), those of a region and slice in one task, one after the other.

        ways (src, dst, privilege), flaws (host, privilege), starts (attacker_id, host, privilege); with a
        column world (bits) where there are two states; of ways with columns service and cve, and flaws with
        cve, also d (service) and e (cve). Of goals (attacker_id, host), those in a region that the attacker starts in.
        """
        share = SHARE if share is None else share
        tag = lambda df: F.col("world") if "world" in df.columns else F.lit(1)
        names = "abcde" if "cve" in ways.columns else "abc"
        more = lambda df: [F.col(c) if c in df.columns else F.lit(None) for c in ("service", "cve")][: len(names) - 3]
        own = self.located(starts, "host")
        load = own.groupBy("region").agg(F.count("*").alias("attackers")).join(self.sizes, "region")
        big = load.withColumn("slices", F.ceil(F.col("edges") * F.col("attackers") / share).cast("int")).filter("slices > 1").select("region", "slices")
        big = stored(big)
        split = not big.isEmpty()
        big = sent(big) if split else big

        def part(df: DataFrame, kind: int, columns: list) -> DataFrame:
            one = F.lit(0)
            if split:
                df = df.join(big, "region", "left")
                each = F.coalesce("slices", F.lit(1))
                one = F.pmod(F.xxhash64("attacker_id"), each).cast("int") if kind in (START, GOAL) else F.explode(F.sequence(F.lit(0), each - 1))
            return df.select("region", one.alias("slice"), F.lit(kind).alias("kind"), tag(df).cast("int").alias("world"), *[c.cast("string").alias(n) for c, n in zip([*columns, *more(df)], names, strict=True)])

        rows = part(self.located(ways.filter("src IS NOT NULL AND dst IS NOT NULL"), "src"), WAY, [F.col("src"), F.col("dst"), F.col("privilege")])
        if flaws is not None:
            rows = rows.unionByName(part(self.located(flaws.filter("host IS NOT NULL"), "host"), FLAW, [F.col("host"), F.lit(None), F.col("privilege")]))
        rows = rows.unionByName(part(own, START, [F.col("attacker_id"), F.col("host"), F.col("privilege")]))
        if goals is not None:
            near = self.located(goals.filter("attacker_id IS NOT NULL AND host IS NOT NULL"), "host").join(own.select("attacker_id", "region").distinct(), ["attacker_id", "region"], "left_semi")
            rows = rows.unionByName(part(near, GOAL, [F.col("attacker_id"), F.col("host"), F.lit(None)]))
        tasks = max(1, int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartition(tasks, "region", "slice").sortWithinPartitions("region", "slice")

    def reached(self, starts: DataFrame, edges: DataFrame, **options) -> DataFrame:
        """(attacker_id, host, round) from starts (attacker_id, host) over edges (src, dst)."""
        none = F.lit(None).cast("string").alias("privilege")
        rows = self.dealt(edges.select("src", "dst", none), None, starts.select("attacker_id", "host", none), **options)
        return rows.mapInArrow(_by_region(_rounds_of, ["attacker_id", "host", "round"]), "attacker_id string, host string, round bigint")

    def executions(self, ways: DataFrame, flaws: DataFrame | None, starts: DataFrame, **options) -> DataFrame:
        """(attacker_id, compromised_host, obtained_privilege), each once."""
        return self.dealt(ways, flaws, starts, **options).mapInArrow(_by_region(_executions_of, EXEC), "attacker_id string, compromised_host string, obtained_privilege string")

    def steps(self, ways: DataFrame, flaws: DataFrame, starts: DataFrame, **options) -> DataFrame:
        """The step that each execution rests on: kind (0 start, 1 local, 2 remote), cve, service, source, priv (of the premise).

        ways also with service and cve, the smallest of each way; flaws with the smallest cve.
        """
        return self.dealt(ways, flaws, starts, **options).mapInArrow(_by_region(_steps_of, STEP), ", ".join(f"{c} {'int' if c == 'kind' else 'string'}" for c in STEP))

    def goals(self, ways: DataFrame, flaws: DataFrame | None, starts: DataFrame, goals: DataFrame, **options) -> DataFrame:
        """Goals (attacker_id, reached_target) where the attacker has root, as often as they are stated."""
        return self.dealt(ways, flaws, starts, goals, **options).mapInArrow(_by_region(_goals_of, ["attacker_id", "reached_target"]), "attacker_id string, reached_target string")

    def left(self, ways: DataFrame, flaws: DataFrame | None, starts: DataFrame, **options) -> DataFrame:
        """Executions that are left when the first state's are stated and then what changes to the second."""
        return self.dealt(ways, flaws, starts, **options).mapInArrow(_by_region(_left_of, EXEC), "attacker_id string, compromised_host string, obtained_privilege string")

    def changes(self, ways: DataFrame, flaws: DataFrame | None, starts: DataFrame, **options) -> DataFrame:
        """Executions that only one of two states (world 1 before, 2 after, 3 both) has, with diff -1 or 1."""
        return self.dealt(ways, flaws, starts, **options).mapInArrow(_by_region(_changes_of, [*EXEC, "diff"]), "attacker_id string, compromised_host string, obtained_privilege string, diff int")


class _Region:
    """The rows of one or more regions, hosts and attackers numbered."""

    def __init__(self, rows: pa.Table):
        kind = rows["kind"].to_numpy()
        take = lambda k: rows.filter(pa.array(kind == k)).combine_chunks()
        self.ways, self.flaws, self.starts, self.goals = take(WAY), take(FLAW), take(START), take(GOAL)
        text = lambda t, c: t[c].combine_chunks() if t.num_rows else pa.array([], pa.string())
        self.hosts = pa.concat_arrays([text(self.ways, "a"), text(self.ways, "b"), text(self.starts, "b")]).unique()
        self.attackers = text(self.starts, "a").unique()
        self.privileges = pa.concat_arrays([text(t, "c") for t in (self.ways, self.flaws, self.starts)]).unique()
        at = lambda t, c, of: pc.index_in(text(t, c), value_set=of).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.src, self.dst, self.gives = at(self.ways, "a", self.hosts), at(self.ways, "b", self.hosts), at(self.ways, "c", self.privileges)
        self.flawed, self.adds = at(self.flaws, "a", self.hosts), at(self.flaws, "c", self.privileges)
        self.who, self.begin, self.held = at(self.starts, "a", self.attackers), at(self.starts, "b", self.hosts), at(self.starts, "c", self.privileges)
        self.aim, self.target = at(self.goals, "a", self.attackers), at(self.goals, "b", self.hosts)
        self.worlds = [t["world"].to_numpy() if t.num_rows else np.empty(0, np.int64) for t in (self.ways, self.flaws, self.starts)]

    def blocks(self, cells: int | None = None) -> Iterator[tuple[int, int]]:
        """Attackers from and to, so many that cells stay few."""
        size = max(1, (CELLS if cells is None else cells) // max(1, len(self.hosts), len(self.src)))
        for low in range(0, len(self.attackers), size):
            yield low, min(len(self.attackers), low + size)

    def levels(self, low: int, high: int, world: int = 1) -> np.ndarray:
        """Fewest hops by (host, attacker) for attackers low to high, -1 where there is no way."""
        n, s = len(self.hosts), high - low
        use = (self.worlds[WAY] & world) > 0
        edges = np.unique(self.src[use] * n + self.dst[use])
        src, follow = edges // max(1, n), edges % max(1, n)
        first = np.searchsorted(src, np.arange(n + 1))
        mine = ((self.worlds[START] & world) > 0) & (self.who >= low) & (self.who < high)
        level = np.full(n * s, -1, dtype=np.int32)
        frontier, k = np.unique(self.begin[mine] * s + self.who[mine] - low), 0
        while len(frontier):
            level[frontier] = k
            host, row = frontier // s, frontier % s
            begin, count = first[host], first[host + 1] - first[host]
            ends = np.cumsum(count)
            new = follow[np.arange(ends[-1]) + np.repeat(begin - ends + count, count)] * s + np.repeat(row, count)
            frontier, k = np.unique(new[level[new] < 0]), k + 1
        return level.reshape(n, s)

    def privileged(self, low: int, high: int, world: int = 1) -> list[np.ndarray]:
        """For each privilege, whether (host, attacker) gets it."""
        n, s = len(self.hosts), high - low
        there = self.levels(low, high, world) >= 0
        use = (self.worlds[WAY] & world) > 0
        mine = ((self.worlds[START] & world) > 0) & (self.who >= low) & (self.who < high)
        out, below = [], np.zeros((n, s), dtype=bool)
        for p, name in enumerate(self.privileges.to_pylist()):
            got = np.zeros((n, s), dtype=bool)
            own = np.flatnonzero(use & (self.gives == p))
            own = own[np.argsort(self.dst[own], kind="stable")]
            if len(own):
                into, first = np.unique(self.dst[own], return_index=True)
                got[into] = np.logical_or.reduceat(there[self.src[own]], first, axis=0)
            begun = mine & (self.held == p)
            got[self.begin[begun], self.who[begun] - low] = True
            if name is not None and name != "root":
                below |= got
            out.append(got)
        known = ((self.worlds[FLAW] & world) > 0) & (self.flawed >= 0)
        for p, got in enumerate(out):
            hosts = np.unique(self.flawed[known & (self.adds == p)])
            got[hosts] |= below[hosts]
        return out

    def ranks(self, low: int, high: int) -> list[np.ndarray]:
        """For each privilege, the rank of (host, attacker): 0 at the start, 2 (r + 1) from a host reached in round r, one more by a local flaw."""
        level = self.levels(low, high)
        onward = np.where(level >= 0, 2 * (level + 1), NEVER).astype(np.int32)
        mine = (self.who >= low) & (self.who < high)
        held = []
        for p in range(len(self.privileges)):
            rank = np.full(level.shape, NEVER, dtype=np.int32)
            own = np.flatnonzero(self.gives == p)
            own = own[np.argsort(self.dst[own], kind="stable")]
            if len(own):
                into, first = np.unique(self.dst[own], return_index=True)
                rank[into] = np.minimum.reduceat(onward[self.src[own]], first, axis=0)
            begun = mine & (self.held == p)
            rank[self.begin[begun], self.who[begun] - low] = 0
            held.append(rank)
        out = [rank.copy() for rank in held]
        for p, rank in enumerate(out):
            hosts = np.unique(self.flawed[(self.flawed >= 0) & (self.adds == p)])
            for g in self.gates():
                if g != p and len(hosts):
                    below = held[g][hosts]
                    rank[hosts] = np.minimum(rank[hosts], below + (below < NEVER))
        return out

    def gates(self) -> list[int]:
        """Privileges that a local flaw can raise, the least first."""
        names = self.privileges.to_pylist()
        return [g for g in self.by_order() if names[g] is not None and names[g] != "root"]

    def by_order(self) -> list[int]:
        """Privileges in the order in which proofs prefer them: none, user, root and others by name, nulls first."""
        names = self.privileges.to_pylist()
        return sorted(range(len(names)), key=lambda p: ({"none": 0, "user": 1}.get(names[p], 2), names[p] is not None, (names[p] or "").encode()))

    def named(self, cells: np.ndarray, low: int) -> list[pa.Array]:
        host, row = np.nonzero(cells)
        return [self.attackers.take(pa.array(row + low)), self.hosts.take(pa.array(host))]


def _rounds_of(r: _Region) -> Iterator[list[pa.Array]]:
    for low, high in r.blocks():
        level = r.levels(low, high)
        there = level >= 0
        yield [*r.named(there, low), pa.array(level[there].astype(np.int64))]


def _executions_of(r: _Region) -> Iterator[list[pa.Array]]:
    for low, high in r.blocks():
        for p, got in enumerate(r.privileged(low, high)):
            names = r.named(got, low)
            yield [*names, r.privileges.take(pa.array(np.full(len(names[0]), p)))]


def _steps_of(r: _Region) -> Iterator[list[pa.Array]]:
    """Of the steps whose premise has a smaller rank, for each execution the least by kind, cve, service, source and privilege."""
    text = lambda t, c: t[c].combine_chunks() if t.num_rows else pa.array([], pa.string())
    table = pa.table({"dst": r.dst, "cve": text(r.ways, "e"), "service": text(r.ways, "d"), "source": text(r.ways, "a")})
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names], null_placement="at_start").to_numpy().astype(np.int64)
    cves, services, flaw_cves = text(r.ways, "e"), text(r.ways, "d"), text(r.flaws, "e")
    privileges, gates = r.privileges.to_pylist(), r.by_order()
    none = pa.scalar("", pa.string())

    for low, high in r.blocks(CELLS // 4):
        rank = r.ranks(low, high)
        least = np.full((len(r.hosts), high - low), NEVER, dtype=np.int32)
        for x in rank:
            np.minimum(least, x, out=least)

        def rows(p: int, host: np.ndarray, row: np.ndarray, kind: int, cve, service, source, gate: np.ndarray | None, low: int = low) -> Iterator[list[pa.Array]]:
            """Columns of STEP, a batch at a time; cve and service: names and places in them."""
            for at in range(0, len(host), BATCH):
                n = len(host[at : at + BATCH])
                take = lambda x: pa.repeat(none, n) if x is None else x[0].take(pa.array(x[1][at : at + n]))  # noqa: B023, E731
                yield [take((r.attackers, row + low)), take((r.hosts, host)), take((r.privileges, np.full(len(host), p))), pa.repeat(pa.scalar(kind, pa.int32()), n),
                       take(cve), take(service), take(source), take(None if gate is None else (r.privileges, gate))]

        def gate_of(p: int, premise: np.ndarray, host: np.ndarray, row: np.ndarray, allowed: list[int], rank: list[np.ndarray] = rank) -> np.ndarray:
            """The first privilege on a premise's host whose rank is smaller, -1 where there is none."""
            out = np.full(len(host), -1)
            for g in reversed(allowed):
                out[rank[g][premise, row] < rank[p][host, row]] = g
            return out

        for p, name in enumerate(privileges):
            open_ = rank[p] < NEVER
            begun = np.zeros_like(open_)
            mine = (r.who >= low) & (r.who < high) & (r.held == p)
            begun[r.begin[mine], r.who[mine] - low] = True
            yield from rows(p, *np.nonzero(begun), 0, None, None, None, None)
            if name is None:
                continue
            open_ &= ~begun
            known = pc.is_valid(r.attackers.slice(low, high - low)).to_numpy(zero_copy_only=False)
            open_[:, ~known] = False
            flaws = np.full(len(r.hosts), -1)
            own = np.flatnonzero((r.flawed >= 0) & (r.adds == p))
            flaws[r.flawed[own]] = own
            host, row = np.nonzero(open_ & (flaws >= 0)[:, None])
            gate = gate_of(p, host, host, row, [g for g in r.gates() if g != p])
            held = gate >= 0
            host, row, gate = host[held], row[held], gate[held]
            yield from rows(p, host, row, 1, (flaw_cves, flaws[host]), None, (r.hosts, host), gate)
            open_[host, row] = False
            own = order[r.gives[order] == p]
            if not len(own):
                continue
            into, first = np.unique(r.dst[own], return_index=True)
            fit = least[r.src[own]] < rank[p][r.dst[own]]
            best = np.minimum.reduceat(np.where(fit, np.arange(len(own), dtype=np.int32)[:, None], np.int32(NEVER)), first, axis=0)
            to, row = np.nonzero((best < NEVER) & open_[into])
            way, host = own[best[to, row]], into[to]
            yield from rows(p, host, row, 2, (cves, way), (services, way), (r.hosts, r.src[way]), gate_of(p, r.src[way], host, row, gates))


def _goals_of(r: _Region) -> Iterator[list[pa.Array]]:
    known = (r.aim >= 0) & (r.target >= 0)
    root = pc.index_in(pa.scalar("root"), value_set=r.privileges).as_py()
    if root is None or not known.any():
        return
    for low, high in r.blocks():
        mine = np.flatnonzero(known & (r.aim >= low) & (r.aim < high))
        if len(mine):
            mine = mine[r.privileged(low, high)[root][r.target[mine], r.aim[mine] - low]]
            yield [r.goals[c].combine_chunks().take(pa.array(mine)) for c in "ab"]


def _left_of(r: _Region) -> Iterator[list[pa.Array]]:
    for low, high in r.blocks():
        for p, (old, new) in enumerate(zip(r.privileged(low, high, 1), r.privileged(low, high, 2), strict=True)):
            came, went = new & ~old, old & ~new
            names = r.named(old.astype(np.int8) + came - went > 0, low)
            yield [*names, r.privileges.take(pa.array(np.full(len(names[0]), p)))]


def _changes_of(r: _Region) -> Iterator[list[pa.Array]]:
    if all((w == 3).all() for w in r.worlds):
        return
    for low, high in r.blocks():
        for p, (old, new) in enumerate(zip(r.privileged(low, high, 1), r.privileged(low, high, 2), strict=True)):
            for diff, cells in ((-1, old & ~new), (1, new & ~old)):
                names = r.named(cells, low)
                yield [*names, r.privileges.take(pa.array(np.full(len(names[0]), p))), pa.array(np.full(len(names[0]), diff, dtype=np.int32))]


def _by_region(found: Callable[[_Region], Iterator[list[pa.Array]]], names: list[str]) -> Callable:
    """A mapInArrow function over sorted rows of Regions.dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in found(_Region(pa.Table.from_batches(rows))):
                if len(columns[0]):
                    yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=BATCH)

        held, n, last = [], 0, None
        for batch in batches:
            region, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(region):
                continue
            cuts = [0] if last is not None and last != (region[0], part[0]) else []
            cuts += [*(np.flatnonzero((region[1:] != region[:-1]) | (part[1:] != part[:-1])) + 1)]
            low = 0
            for at in map(int, cuts):
                if at > low:
                    held.append(batch.slice(low, at - low))
                    n, low = n + at - low, at
                if n >= TOGETHER:
                    yield from solved(held)
                    held, n = [], 0
            held.append(batch.slice(low))
            n, last = n + batch.num_rows - low, (region[-1], part[-1])
        if held:
            yield from solved(held)

    return run
