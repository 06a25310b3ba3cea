"""Search region by region: for graphs too large to send around."""

import random

import numpy as np
import pytest
from oracle import derive, state
from pyspark.sql import functions as F
from test_engine import HARD, TWO_HOPS, apply

from breachline.functions import topologies as topo
from breachline.operators import metrics, provenance, regions, rules, updates
from breachline.operators.fixpoint import reach
from breachline.plans.engines import IncrementalEngine
from breachline.plans.facts import FactStore


def test_roots():
    r = random.Random(3)
    a, b = (np.array([r.randrange(300) for _ in range(200)]) for _ in range(2))
    want = {int(x): {int(x)} for x in (*a, *b)}
    for x, y in zip(map(int, a), map(int, b), strict=True):
        if want[x] is not want[y]:
            want[x] |= want[y]
            for z in want[x]:
                want[z] = want[x]
    nodes, root = regions.roots(a, b)
    assert dict(zip(map(int, nodes), map(int, root), strict=True)) == {k: min(v) for k, v in want.items()}


def test_many_edges_without_rounds(spark, monkeypatch):
    """Rings beside each other, an attacker in two of them, one where no edge is; no pair is ever kept."""
    from breachline.operators import fixpoint

    monkeypatch.setattr(fixpoint, "_rounds", lambda *_: pytest.fail("rounds keep every pair"))
    monkeypatch.setattr(fixpoint, "_searched", lambda *_: pytest.fail("the graph is sent around"))
    edges = [(f"r{k}_{i}", f"r{k}_{(i + 1) % 7}") for k in range(40) for i in range(7)] + [("r0_0", "r0_2")]
    begun = [(f"a{i}", f"r{i % 40}_{i % 7}") for i in range(300)] + [("a0", "r1_3"), ("b", "alone"), (None, "r2_0")]
    got = reach(spark.createDataFrame(begun, "attacker_id string, host string"), spark.createDataFrame(edges, "src string, dst string"), small_edges=1)
    want = {}
    for a, h in begun:
        level, k = {h}, 0
        while level:
            for x in level:
                want[a, x] = min(want.get((a, x), 99), k)
            level, k = {d for s, d in edges if s in level and (a, d) not in want}, k + 1
    rows = got.collect()
    assert len(rows) == len(want) and {(x.attacker_id, x.host): x.round for x in rows} == want


def test_large_region_goes_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(regions, "REGION_EDGES", 3)
    got = rules.reach_hosts(topo.chain(spark, 6), small_edges=1).collect()
    assert {(r.host, r.round) for r in got} == {(f"node_{i}", i) for i in range(6)}


def test_attackers_of_a_region_dealt_out(spark, monkeypatch):
    """One region, its attackers in several shares and blocks."""
    monkeypatch.setattr(regions, "SHARE", 20)
    monkeypatch.setattr(regions, "CELLS", 10)
    rows = topo.random_rows(4)
    rows["attackerLocated"] = [(f"a{k}", h, p) for k, (_, h, p) in enumerate(rows["attackerLocated"] * 5)]
    assert state(rules.evaluate(FactStore.of(spark, rows))) == derive(rows)


@pytest.mark.parametrize("rows", [TWO_HOPS, HARD, {}, topo.random_rows(3), topo.random_rows(7)])
def test_snapshot(spark, rows):
    facts = rules.evaluate(FactStore.of(spark, rows))
    assert facts.state is not None and state(facts) == derive(rows)
    assert sorted(map(tuple, rules.goals_bag(FactStore.of(spark, rows)).collect())) == sorted(g for g in rows.get("attackGoal", ()) if g in derive(rows)["goalReached"])


UPDATES = [
    [("remove", "vulExists", ("b", "C1", "s", "none")), ("remove", "vulExists", ("b", "C2", "s", "none")), ("insert", "localVulExists", ("e", "L4", "root"))],
    [("insert", "firewallDeny", ("c", "d", "t", "deny")), ("remove", "attackerLocated", ("eve", "a", "none")), ("insert", "attackerLocated", ("mal", "b", "user"))],
    [("remove", "firewallDeny", ("c", "d", "t", "deny")), ("insert", "hacl", ("a", "e", "s")), ("remove", "attackGoal", ("mal", "d")), ("insert", "attackGoal", ("mal", "f"))],
]


def test_updates_by_regions(spark):
    """States, feeds and affected hosts after updates of every relation, without pairs or executions being kept."""
    engine, rows, hosts = IncrementalEngine(small_edges=1), HARD, metrics.HOSTS
    engine.load_snapshot(FactStore.of(spark, rows))
    before = engine.current_derived_facts()
    for log in UPDATES:
        old, rows = derive(rows), apply(rows, log)
        engine.apply_updates(updates.change_log(spark, log))
        after, new = engine.current_derived_facts(), derive(rows)
        assert state(after) == new
        want = {(p, f, d) for p in new for d, facts in ((1, new[p] - old[p]), (-1, old[p] - new[p])) for f in facts}
        assert {(r.predicate, tuple(r.args), r.diff) for r in metrics.changed_facts(before, after).collect()} == want
        assert {r.host for r in metrics.affected_hosts(before, after).collect()} == {f[k] for p, f, _ in want for k in hosts[p]}
        assert {(r.predicate, tuple(r.args)) for r in updates.left(before, after).collect()} == {(p, f) for p in new if p != "effectiveAccess" for f in new[p]}
        before = after
    assert engine.repairs == ["regions"] * 3


@pytest.mark.parametrize("rows", [TWO_HOPS, HARD, {}, topo.random_rows(3), topo.random_rows(7)])
def test_proofs_keep_no_pairs(spark, monkeypatch, rows):
    """Proof edges of executions region by region, attackers dealt out and in blocks, are those found by joins."""
    rows = dict(rows) | {"attackerLocated": [(f"{a}{k}", h, p) for k in range(3) for a, h, p in rows.get("attackerLocated", ())]}
    rows["localVulExists"] = [*rows.get("localVulExists", ()), *((h, f"L{k}", p) for k, (_, h, _) in enumerate(rows["attackerLocated"]) for p in ("user", "root"))]
    store = FactStore.of(spark, rows)
    only = ("execCode", "ownsMachine", "goalReached")
    show = lambda df: sorted((r.predicate, tuple(r.args), r.rule, r.place, r.premise, tuple(r.premise_args)) for r in df.collect())
    want = show(provenance.proof_edges(store, only, small_edges=0))
    monkeypatch.setattr(provenance, "cut", lambda *_: pytest.fail("pairs or steps are kept"))
    monkeypatch.setattr(regions, "SHARE", 20)
    monkeypatch.setattr(regions, "CELLS", 40)
    assert show(provenance.proof_edges(store, only)) == want


def test_proofs_with_nulls(spark):
    """Nulls in privileges, hosts, services and ids, as by joins."""
    store = FactStore.of(spark, HARD)
    for p, c in (("vulExists", "vulnerability_id"), ("vulExists", "privilege"), ("localVulExists", "vulnerability_id"), ("localVulExists", "privilege"), ("hacl", "service_name")):
        df = store.relation(p)
        store = store.with_relation(p, df.unionByName(df.withColumn(c, F.lit(None).cast("string"))))
    odd = spark.createDataFrame([("nul", "a", None), ("nil", None, "user")], "attacker_id string, starting_host string, initial_privilege string")
    store = store.with_relation("attackerLocated", store.attacker_positions.unionByName(odd))
    show = lambda df: sorted(map(str, df.collect()))
    assert show(provenance.proof_edges(store, ("execCode",))) == show(provenance.proof_edges(store, ("execCode",), small_edges=0))
