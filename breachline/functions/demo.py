"""A small network through four states: loaded, one way closed, its entry patched, and open again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from breachline.operators.updates import change_feed, change_log
from breachline.plans.engines import Engine, IncrementalEngine
from breachline.plans.facts import DerivedFacts, FactStore

# The demonstration's facts and updates.
FACTS = {
    "hacl": [("internet", "web01", "http"), ("internet", "web01", "https"), ("web01", "db01", "mysql"), ("web01", "db01", "ssh"), ("db01", "admin01", "ssh"), ("db01", "admin01", "smb")],
    "vulExists": [
        ("web01", "CVE-2024-1234", "http", "user"),
        ("web01", "CVE-2024-1234", "https", "user"),
        ("db01", "CVE-2024-5678", "mysql", "root"),
        ("db01", "CVE-2024-9999", "ssh", "user"),
        ("admin01", "CVE-2024-8888", "smb", "root"),
    ],
    "attackerLocated": [("eve", "internet", "user")],
    "attackGoal": [("eve", "admin01")],
}
PHASES = (
    ("A firewall rule denies internet -> web01 on http; the way over https is still open", [("insert", "firewallDeny", ("internet", "web01", "http", "deny"))]),
    ("CVE-2024-1234 is patched on web01: no way in is left", [("remove", "vulExists", ("web01", "CVE-2024-1234", s, "user")) for s in ("http", "https")]),
    ("CVE-2024-0DAY is found on web01: https is a way in again", [("insert", "vulExists", ("web01", "CVE-2024-0DAY", "https", "user"))]),
)


def run(spark: SparkSession, engine: Engine | None = None) -> Iterator[tuple[int, str, DerivedFacts, DataFrame]]:
    """Time, title, state and changes of each phase; effective access is not among the changes."""
    engine = engine or IncrementalEngine()
    engine.load_snapshot(FactStore.of(spark, FACTS))
    before = engine.current_derived_facts()
    yield 0, "The network is loaded: [internet] -> [web01] -> [db01] -> [admin01]", before, change_feed(None, before, 0)
    for time, (title, log) in enumerate(PHASES, 1):
        engine.apply_updates(change_log(spark, log))
        after = engine.current_derived_facts()
        yield time, title, after, change_feed(before, after, time)
        before = after
