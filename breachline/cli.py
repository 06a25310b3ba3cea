"""Command line: evaluate a scenario file, apply an update file, explain a goal, run benchmarks; without arguments, a demonstration."""

from __future__ import annotations

import argparse
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from breachline.functions import benchmarks as bench
from breachline.functions import demo
from breachline.functions.dot import write_proof
from breachline.operators.provenance import Explainer
from breachline.operators.updates import change_feed
from breachline.plans.engines import IncrementalEngine
from breachline.plans.facts import FIELD
from breachline.sources.facts_text import read_facts, read_updates
from breachline.streaming.feed import shown

_NAMES = ("remote vulnerabilities", "local vulnerabilities", "network edges", "firewall rules", "attacker positions", "goals")


def _print(feed: DataFrame) -> None:
    for r in shown(feed).orderBy("line").collect():  # a report for the reader
        print(r.line)


def run_scenario(spark: SparkSession, scenario: str, update: str | None = None, explain: str | None = None, dot: str | None = None) -> None:
    """Print the derived facts of a scenario, the changes of an update, and a fact's proof, which may be written as DOT."""
    store = read_facts(spark, scenario)
    log = read_updates(spark, update) if update else None
    print(f"Scenario: {scenario}")
    print("Loaded " + ", ".join(f"{getattr(store, f).count()} {n}" for f, n in zip(FIELD.values(), _NAMES, strict=True)))
    if log is not None:
        print(f"Update: {update} ({log.count()} changes)")
    engine = IncrementalEngine()
    engine.load_snapshot(store)
    before = engine.current_derived_facts()
    print("DERIVED FACTS")
    _print(change_feed(None, before, 0))
    if log is not None:
        engine.apply_updates(log)
        print("CHANGES")
        _print(change_feed(before, engine.current_derived_facts(), 1))
    if explain or dot:
        goals = [(r.attacker_id, r.reached_target) for r in engine.current_derived_facts().goals_reached.orderBy("attacker_id", "reached_target").limit(1).collect()]
        found = re.fullmatch(r"\s*(\w+)\((.*)\)\.?\s*", explain or "")
        wanted = (found[1], tuple(a.strip() for a in found[2].split(","))) if found else ("goalReached", goals[0]) if goals else None
        tree = Explainer(engine.facts()).explain(*wanted) if wanted else None
        print(tree.pretty() if tree else "The fact does not hold.", end="")
        if tree and dot:
            write_proof(tree, dot)


def run_demo(spark: SparkSession) -> None:
    """Print what each phase of the demonstration changes."""
    for time, title, _, feed in demo.run(spark):
        print(f"PHASE {time + 1} (time={time}): {title}")
        _print(feed)


def run_benchmarks(spark: SparkSession, csv_path: str | None = None, cuts: int = 5, sizes: tuple[int, ...] = (50, 100, 200, 500)) -> list[bench.Row]:
    """Time generated networks; ``cuts`` random patches of a chain of each size."""
    plain = [bench.star_benchmark(spark, n) for n in (50, 100, 200, 500, 1000)] + bench.scalability(spark, [10, 50, 100, 200])
    random_cuts = [bench.random_cut_benchmark(spark, n, cuts) for n in sizes]
    enterprise = bench.enterprise_benchmark(spark)
    print(bench.size_table(plain))
    print(bench.random_cut_table(random_cuts))
    print(bench.enterprise_table(enterprise))
    rows = plain + [row for row, _ in random_cuts] + enterprise
    if csv_path:
        Path(csv_path).write_text(bench.to_csv(rows), encoding="utf-8")
    return rows


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="breachline", description=__doc__)
    parser.add_argument("--scenario", help="file of facts")
    parser.add_argument("--update", help="file of updates")
    parser.add_argument("--explain", nargs="?", const="goal", help="fact to explain; the first goal by default")
    parser.add_argument("--export-dot", help="file for the proof")
    parser.add_argument("--benchmarks", action="store_true", help="time generated networks")
    parser.add_argument("--csv", help="file for benchmark results")
    parser.add_argument("--cuts", type=int, default=5, help="random patches of each chain (published figures: 100)")
    own = parser.parse_args(args)
    spark = SparkSession.builder.appName("breachline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if own.benchmarks:
        run_benchmarks(spark, own.csv, own.cuts)
    elif own.scenario:
        run_scenario(spark, own.scenario, own.update, own.explain, own.export_dot)
    else:
        run_demo(spark)


if __name__ == "__main__":
    main()
