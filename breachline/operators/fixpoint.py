"""Reachability to a fixpoint, by set-at-a-time rounds or by a kernel for small graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachline.operators.regions import Regions
from breachline.plans.lineage import cut, stored

#: Graphs of at most this many edges (two host names each) are sent to every worker.
SMALL_EDGES = 300_000
#: Pairs that a task of the kernel holds before it sends them on.
HELD = 100_000


def reach(starts: DataFrame, edges: DataFrame, small_edges: int = SMALL_EDGES, max_rounds: int = 100_000) -> DataFrame:
    """(attacker_id, host, round) over starts (attacker_id, host) and edges (src, dst); round is the fewest hops.

    Attackers are independent of each other. If the edges, counted up to the limit, are few, each
    attacker's hosts are found by one breadth-first search beside a copy of the graph; otherwise region
    by region. If a region is too large for a task, or with small_edges 0, by semi-naive rounds, in
    which only new pairs meet the edges.
    """
    if small_edges:
        edges = stored(edges.select("src", "dst"))
        if edges.limit(small_edges + 1).count() <= small_edges:
            return _searched(starts, edges.toArrow())
        regions = Regions(edges)
        if regions.fit:
            return regions.reached(starts, edges)
    return _rounds(starts, edges, max_rounds)


class Graph:
    """Hosts in order and, for host i, its successors follow[at[i]:at[i + 1]]."""

    def __init__(self, edges: pa.Table):
        ends = pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks], pa.string())
        self.hosts = ends.unique()
        src, dst = (pc.index_in(edges[c], value_set=self.hosts).to_numpy() for c in ("src", "dst"))
        order = np.argsort(src, kind="stable")
        self.follow = dst[order].astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=len(self.hosts))))).astype(np.int64)

    def next(self, frontier: np.ndarray) -> np.ndarray:
        """Successors of the hosts of the frontier, repeats included."""
        low, count = self.at[frontier], self.at[frontier + 1] - self.at[frontier]
        ends = np.cumsum(count)
        return self.follow[np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + count, count)]

    def search(self, start: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hosts that can be reached from the start hosts, with their fewest hops; seen is scratch, all false."""
        frontier = np.unique(start)
        seen[frontier] = True
        found, level = [frontier], 0
        while len(frontier):
            new = self.next(frontier)
            frontier = np.unique(new[~seen[new]])
            seen[frontier] = True
            found.append(frontier)
        hosts = np.concatenate(found)
        seen[hosts] = False
        return hosts, np.repeat(np.arange(len(found)), [len(x) for x in found])


def _searched(starts: DataFrame, edges: pa.Table) -> DataFrame:
    graph = starts.sparkSession.sparkContext.broadcast(Graph(edges))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Graph = graph.value
        seen = np.zeros(len(g.hosts), dtype=bool)
        held: list[pa.RecordBatch] = []

        def found(attacker: str, own: list[pa.Array]) -> pa.RecordBatch:
            names = pa.concat_arrays(own)
            at = pc.index_in(names, value_set=g.hosts)
            hosts, rounds = g.search(at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), seen)
            # a start without edges is reached all the same
            alone = names.filter(pc.is_null(at))
            out = pa.concat_arrays([g.hosts.take(pa.array(hosts)), alone])
            columns = [pa.array([attacker] * len(out), pa.string()), out, pa.array(np.concatenate((rounds, np.zeros(len(alone), dtype=np.int64))))]
            return pa.RecordBatch.from_arrays(columns, names=["attacker_id", "host", "round"])

        def sent() -> pa.RecordBatch:
            out = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return out

        now, own = None, []
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate((names[1:] != names[:-1], [True]))) + 1 if len(names) else []
            low = 0
            for high in map(int, edge):
                if own and names[low] != now:
                    held.append(found(now, own))
                    own = []
                    if sum(b.num_rows for b in held) >= HELD:
                        yield sent()
                now = names[low]
                own.append(batch.column(1).slice(low, high - low))
                low = high
        if own:
            held.append(found(now, own))
        if held:
            yield sent()

    # a number of its own: the few rows that go in would be put together in one task, whatever comes out
    tasks = max(1, int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = starts.distinct().repartition(tasks, "attacker_id").sortWithinPartitions("attacker_id").select("attacker_id", "host")
    return keyed.mapInArrow(search, "attacker_id string, host string, round bigint")


def _rounds(starts: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    edges = cut(edges.distinct())
    seen = cut(starts.select("attacker_id", "host").distinct().withColumn("round", F.lit(0).cast("long")))
    frontier = seen
    for n in range(1, max_rounds + 1):
        step = frontier.join(edges, frontier.host == edges.src).select("attacker_id", F.col("dst").alias("host")).distinct()
        frontier = cut(step.join(seen, ["attacker_id", "host"], "left_anti").withColumn("round", F.lit(n).cast("long")))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier).coalesce(max(1, int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
