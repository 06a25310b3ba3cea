"""Timing a snapshot, an incremental update and a recomputation on generated networks, and tables of the results."""

from __future__ import annotations

import csv
import io
import random
import time
from collections.abc import Callable
from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from breachline.functions import topologies as topo
from breachline.operators.metrics import derived_count, host_census, update_metrics
from breachline.operators.updates import change_log
from breachline.plans.engines import IncrementalEngine, RecomputeEngine
from breachline.plans.facts import FactStore


@dataclass
class Row:
    """One line of results; counts that were not taken are None."""

    benchmark_name: str
    topology: str
    number_of_nodes: int
    number_of_edges: int
    number_of_vulnerabilities: int
    update_type: str
    initial_time_ms: float
    incremental_update_us: float
    full_recomputation_ms: float
    speedup: float
    derived_facts_before: int
    derived_facts_after: int
    changed_facts: int | None = None
    changed_base_facts: int | None = None
    changed_exec_code_facts: int | None = None
    changed_ownership_facts: int | None = None
    changed_goal_facts: int | None = None
    changed_derived_facts: int | None = None
    affected_hosts: int | None = None


def _timed(f: Callable[[], object]) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def _row(name: str, topology: str, store: FactStore, log: DataFrame, update: str, detail: bool = True) -> Row:
    engine = IncrementalEngine()
    initial = _timed(lambda: (engine.load_snapshot(store), derived_count(engine.current_derived_facts())))
    before = engine.current_derived_facts()
    n0 = derived_count(before)
    step = _timed(lambda: (engine.apply_updates(log), derived_count(engine.current_derived_facts())))
    after = engine.current_derived_facts()
    other = RecomputeEngine()
    other.load_snapshot(store)
    other.apply_updates(log)
    anew = _timed(lambda: derived_count(other.current_derived_facts()))
    row = Row(name, topology, host_census(store).count(), store.network_access.count(), store.vulnerabilities.count(), update, initial * 1e3, step * 1e6, anew * 1e3, anew / step, n0, derived_count(after))
    if detail:
        m = update_metrics(before, after).first()
        row.changed_base_facts, row.changed_facts = log.count(), abs(row.derived_facts_before - row.derived_facts_after)
        row.changed_exec_code_facts, row.changed_ownership_facts, row.changed_goal_facts = m.changed_exec_code_facts, m.changed_ownership_facts, m.changed_goal_facts
        row.changed_derived_facts, row.affected_hosts = m.changed_derived_facts, m.affected_hosts
    return row


def _patch(spark: SparkSession, host: str, cve: str) -> DataFrame:
    return change_log(spark, [("remove", "vulExists", (host, cve, "ssh", "root"))])


def chain_benchmark(spark: SparkSession, n: int) -> Row:
    return _row("chain_benchmark", "chain", topo.chain(spark, n), _patch(spark, "node_1", "CVE-CHAIN-1"), "patch_node_1_vulnerability")


def star_benchmark(spark: SparkSession, leaves: int) -> Row:
    return _row("star_benchmark", "star", topo.star(spark, leaves), _patch(spark, "leaf_0", "CVE-LEAF-0"), "patch_one_leaf_vulnerability")


def enterprise_benchmark(spark: SparkSession, config: topo.Enterprise = topo.Enterprise()) -> list[Row]:
    return [_row("enterprise_benchmark", "layered_enterprise", topo.enterprise(spark, config), topo.enterprise_update(spark, config, p), p) for p in topo.PATTERNS]


def random_cut_benchmark(spark: SparkSession, n: int, times: int, seed: int = 1) -> tuple[Row, list[float]]:
    """Patch and restore random hosts of a chain; the row has means, the list each incremental time in seconds."""
    r, steps, anew, counts = random.Random(seed), [], [], []
    engine = IncrementalEngine()
    initial = _timed(lambda: engine.load_snapshot(topo.chain(spark, n)))
    before = derived_count(engine.current_derived_facts())
    for _ in range(times):
        k = r.randrange(n)
        fact = (f"node_{k}", f"CVE-CHAIN-{k}", "ssh", "root")

        def patched(fact=fact) -> None:
            engine.apply_updates(change_log(spark, [("remove", "vulExists", fact)]))
            counts.append(derived_count(engine.current_derived_facts()))

        steps.append(_timed(patched))
        other = RecomputeEngine()
        other.load_snapshot(engine.facts())
        anew.append(_timed(lambda other=other: derived_count(other.current_derived_facts())))
        engine.apply_updates(change_log(spark, [("insert", "vulExists", fact)]))
    mean, again = sum(steps) / times, sum(anew) / times
    row = Row("chain_random_cut_benchmark", "chain_random_cut", n, n - 1, n, "random_vulnerability_cut_average", initial * 1e3, mean * 1e6, again * 1e3, again / mean, before, round(sum(counts) / times))
    return row, steps


def scalability(spark: SparkSession, sizes: list[int]) -> list[Row]:
    return [chain_benchmark(spark, n) for n in sizes]


def to_csv(rows: list[Row]) -> str:
    """Comma-separated rows under their field names; times with six places, counts that were not taken empty."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(f.name for f in fields(Row))
    for row in rows:
        writer.writerow("" if x is None else f"{x:.6f}" if isinstance(x, float) else x for x in astuple(row))
    return out.getvalue()


def to_markdown(rows: list[Row]) -> str:
    head = "| Update | Nodes | Edges | Vulns | Initial (ms) | Incremental (us) | Recompute (ms) | Speedup | Facts Before | Facts After |\n|---|---:|---:|---:|---:|---:|---:|---:|---:|---:|\n"
    return head + "".join(
        f"| {r.update_type} | {r.number_of_nodes} | {r.number_of_edges} | {r.number_of_vulnerabilities} | {r.initial_time_ms:.2f} | {r.incremental_update_us:.2f} | {r.full_recomputation_ms:.2f} | {r.speedup:.1f}x | {r.derived_facts_before} | {r.derived_facts_after} |\n" for r in rows
    )


def _table(heads: str, lines: list[list[str]]) -> str:
    """A Markdown table of lines under comma-separated heads."""
    names = heads.split(", ")
    rows = [f"| {' | '.join(names)} |", f"|{'|'.join('---:' for _ in names)}|", *(f"| {' | '.join(line)} |" for line in lines)]
    return "\n".join(rows) + "\n"


def _times(row: Row) -> list[str]:
    return [f"{row.initial_time_ms:.2f}", f"{row.incremental_update_us:.2f}", f"{row.full_recomputation_ms:.2f}"]


def size_table(rows: list[Row]) -> str:
    """One update on networks of several sizes."""
    gain = lambda r: f"{r.initial_time_ms * 1e3 / r.incremental_update_us:.1f}x"
    return _table("Nodes, Initial (ms), Incremental (us), Recompute After Update (ms), Initial Speedup, Recompute Speedup, Facts Before, Facts After", [[str(r.number_of_nodes), *_times(r), gain(r), f"{r.speedup:.1f}x", str(r.derived_facts_before), str(r.derived_facts_after)] for r in rows])


def random_cut_table(results: list[tuple[Row, list[float]]]) -> str:
    """Random patches: means, and the fastest and slowest of all."""
    lines = []
    for row, steps in results:
        spread = [f"{min(steps) * 1e6:.2f}", f"{max(steps) * 1e6:.2f}"]
        lines.append([str(row.number_of_nodes), str(len(steps)), *_times(row), *spread, f"{row.initial_time_ms * 1e3 / row.incremental_update_us:.1f}x", f"{row.speedup:.1f}x"])
    return _table("Nodes, Iterations, Initial (ms), Avg Incr (us), Avg Recompute (ms), Min (us), Max (us), Avg Speedup, Recompute Speedup", lines)


def enterprise_table(rows: list[Row]) -> str:
    """Updates of the layered network, with what they change."""
    lines = [[r.update_type, str(r.number_of_nodes), str(r.number_of_edges), str(r.number_of_vulnerabilities), str(r.changed_base_facts), *_times(r), f"{r.speedup:.1f}x", str(r.derived_facts_before), str(r.derived_facts_after), str(r.changed_derived_facts)] for r in rows]
    return _table("Update, Nodes, Edges, Vulns, Changed Base, Initial (ms), Incremental (us), Recompute (ms), Recompute Speedup, Facts Before, Facts After, Changed Facts", lines)


def to_latex(rows: list[Row]) -> str:
    body = "".join(f"{r.number_of_nodes} & {r.initial_time_ms:.2f} & {r.incremental_update_us:.2f} & {r.speedup:.1f}x \\\\\n" for r in rows)
    return "\\begin{tabular}{|r|r|r|r|}\n\\hline\nNodes & Initial (ms) & Incremental ($\\mu$s) & Speedup \\\\\n\\hline\n" + body + "\\hline\n\\end{tabular}\n"


def summary(row: Row) -> str:
    return f"{row.topology}, {row.number_of_nodes} nodes, {row.update_type}: initial {row.initial_time_ms:.1f} ms, update {row.incremental_update_us / 1e3:.1f} ms, recomputation {row.full_recomputation_ms:.1f} ms ({row.speedup:.2f}x); facts {row.derived_facts_before} -> {row.derived_facts_after}"
