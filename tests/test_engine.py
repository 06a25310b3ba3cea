import random

import pytest
from oracle import derive, state

from breachline.functions import topologies as topo
from breachline.operators import metrics, rules, updates
from breachline.plans.engines import IncrementalEngine, NaiveEngine, RecomputeEngine
from breachline.plans.facts import FactStore
from breachline.sources.facts_text import store_of

TWO_HOPS = {
    "vulExists": [("web", "CVE-WEB", "https", "user"), ("db", "CVE-DB", "postgres", "root")],
    "hacl": [("internet", "web", "https"), ("web", "db", "postgres")],
    "attackerLocated": [("eve", "internet", "user")],
    "attackGoal": [("eve", "db")],
}
HARD = {  # two attackers, none, allow rules, repeats, a cycle, redundant flaws
    "vulExists": [("b", "C1", "s", "none"), ("b", "C2", "s", "none"), ("c", "C3", "s", "root"), ("d", "C4", "t", "user"), ("e", "C5", "s", "user"), ("f", "C6", "s", "root")],
    "localVulExists": [("b", "L1", "user"), ("c", "L2", "user"), ("d", "L3", "root")],
    "hacl": [("a", "b", "s"), ("a", "b", "s"), ("b", "c", "s"), ("c", "d", "t"), ("d", "e", "s"), ("e", "f", "s"), ("f", "e", "s")],
    "firewallDeny": [("a", "b", "x", "deny"), ("b", "c", "s", "allow")],
    "attackerLocated": [("eve", "a", "none"), ("mal", "d", "root")],
    "attackGoal": [("eve", "c"), ("eve", "c"), ("eve", "f"), ("mal", "d"), ("mal", "a")],
}


def apply(rows: dict, log: list) -> dict:
    """Bag semantics, one update at a time."""
    rows = {p: list(r) for p, r in rows.items()}
    for op, p, fact in log:
        bag = rows.setdefault(p, [])
        if op == "insert":
            bag.append(fact)
        elif fact in bag:
            bag.remove(fact)
    return rows


@pytest.mark.parametrize("rows", [TWO_HOPS, HARD, {}, topo.random_rows(3)])
@pytest.mark.parametrize("small", [0, 1000])
def test_snapshot(spark, rows, small):
    assert state(rules.evaluate(FactStore.of(spark, rows), small_edges=small)) == derive(rows)


def test_reach_rounds(spark):
    got = {(r.host, r.round) for r in rules.reach_hosts(topo.chain(spark, 6), small_edges=0).collect()}
    assert got == {(f"node_{i}", i) for i in range(6)} == {(r.host, r.round) for r in rules.reach_hosts(topo.chain(spark, 6)).collect()}


def test_kernel_many_attackers(spark):
    """Ten thousand attackers, some at two places, one at a host without edges; results come in bounded batches."""
    from breachline.operators.fixpoint import reach

    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}") for i in range(40)] + [("h40", "h38")], "src string, dst string")
    begun = [(f"a{i}", f"h{i % 41}") for i in range(10_000)] + [("a0", "h20"), ("b", "alone")]
    got = reach(spark.createDataFrame(begun, "attacker_id string, host string").repartition(3), edges).collect()
    want = {("b", "alone"): 0}
    for a, h in begun[:-1]:
        at = int(h[1:])
        for d in range(min(at, 38), 41):
            hops = d - at if d >= at else 41 - at + d - 38
            want[a, f"h{d}"] = min(want.get((a, f"h{d}"), 99), hops)
    assert len(got) == len(want) and {(x.attacker_id, x.host): x.round for x in got} == want


def test_max_rounds_raises(spark):
    with pytest.raises(RuntimeError):
        rules.reach_hosts(topo.chain(spark, 6), small_edges=0, max_rounds=2)


def test_hops(spark):
    store = topo.chain(spark, 5)
    assert [rules.evaluate_hops(store, n).code_executions.count() for n in range(4)] == [1, 2, 3, 4]
    twice = FactStore.of(spark, TWO_HOPS | {"attackerLocated": TWO_HOPS["attackerLocated"] * 2, "firewallDeny": [("internet", "web", "https")]})
    assert rules.evaluate_hops(twice, 0).code_executions.count() == 2
    assert rules.evaluate_hops(twice, 2).goals_reached.count() == 1  # denies don't count here


def test_bags(spark):
    store = FactStore.of(spark, HARD)
    assert rules.effective_access_bag(store).count() == 7
    owned = rules.owns_machine(rules.exec_code(store))
    assert sorted(map(tuple, rules.goal_reached_bag(store, owned).collect())) == [("eve", "c"), ("eve", "c"), ("eve", "f"), ("mal", "d")]


UPDATES = [
    [("remove", "vulExists", ("web", "CVE-WEB", "https", "user"))],
    [("insert", "firewallDeny", ("internet", "web", "https", "deny")), ("remove", "firewallDeny", ("internet", "web", "https", "deny"))],
    [("remove", "hacl", ("x", "y", "z")), ("insert", "hacl", ("internet", "db", "postgres"))],
    [("remove", "attackerLocated", ("eve", "internet", "user"))],
]


@pytest.mark.parametrize("log", UPDATES)
def test_updates(spark, log):
    check_updates(spark, TWO_HOPS, [log])


def test_cycle_falls_with_its_source(spark):
    engine = check_updates(spark, HARD, [[("remove", "hacl", ("d", "e", "s"))], [("remove", "vulExists", ("b", "C1", "s", "none"))], [("insert", "firewallDeny", ("a", "b", "s", "deny"))], [("remove", "firewallDeny", ("a", "b", "s", "deny"))]])
    assert "repair" in engine.repairs and "attackers" not in engine.repairs


@pytest.mark.parametrize("seed", [1, 2])
def test_random_updates(spark, seed):
    rows, r = topo.random_rows(seed), random.Random(seed)
    check_updates(spark, rows, [[topo.random_update(rows, r) for _ in range(3)] for _ in range(2)])


def check_updates(spark, rows, logs):
    engines = [IncrementalEngine(give_up=2.0, small_edges=0), IncrementalEngine(), RecomputeEngine(), NaiveEngine()]
    for e in engines:
        e.load_snapshot(FactStore.of(spark, rows))
    for log in logs:
        rows = apply(rows, log)
        for e in engines:
            e.apply_updates(updates.change_log(spark, log))
            assert state(e.current_derived_facts()) == derive(rows), (e.name, log)
    return engines[0]


def test_replay_is_clamped(spark):
    r = random.Random(5)
    log = [(r.choice(("insert", "remove")), "localVulExists", (r.choice("ab"), "c", "root")) for _ in range(60)]
    want = apply({}, log)["localVulExists"]
    got = updates.replayed(updates.counted(FactStore.of(spark, {})), updates.change_log(spark, log))
    assert {tuple(x.args): x.copies for x in got.collect()} == {f: want.count(f) for f in set(want)}


def test_feed_and_time_travel(spark):
    engine = IncrementalEngine()
    engine.load_snapshot(FactStore.of(spark, TWO_HOPS))
    before = engine.current_derived_facts()
    engine.apply_updates(updates.change_log(spark, [("remove", "vulExists", ("db", "CVE-DB", "postgres", "root"))]))
    feed = updates.change_feed(None, before, 0).unionByName(updates.change_feed(before, engine.current_derived_facts(), 1))
    late = {(r.predicate, tuple(r.args), r.diff) for r in feed.filter("time = 1").collect()}
    assert late == {("execCode", ("eve", "db", "root"), -1), ("ownsMachine", ("eve", "db"), -1), ("goalReached", ("eve", "db"), -1)}
    assert updates.state_as_of(feed, 1).count() == 5 and updates.positive(feed).count() == 2


def test_comparison_and_metrics(spark):
    a, b = rules.evaluate(FactStore.of(spark, TWO_HOPS)), rules.evaluate(FactStore.of(spark, TWO_HOPS | {"vulExists": TWO_HOPS["vulExists"][:1]}))
    assert metrics.compare(a, a) == ""
    assert metrics.compare(a, b).splitlines()[0] == "code_executions differs: left_count=3, right_count=2, only_left=[execCode(eve, db, root)], only_right=[]"
    m = metrics.update_metrics(a, b).first()
    assert (m.changed_exec_code_facts, m.changed_ownership_facts, m.changed_goal_facts, m.changed_derived_facts, m.affected_hosts, m.changed_base_facts, m.recursive_depth_estimate) == (1, 1, 1, 3, 1, 0, None)


@pytest.mark.parametrize("make, edges, vulns, facts", [(lambda s: topo.chain(s, 10), 9, 10, 21), (lambda s: topo.star(s, 50), 50, 51, 103), (lambda s: topo.mesh(s, 3, 3), 12, 9, 19), (topo.enterprise, 77, 13, 16)])
def test_topologies(spark, make, edges, vulns, facts):
    store = make(spark)
    assert (store.network_access.count(), store.vulnerabilities.count(), metrics.derived_count(rules.evaluate(store))) == (edges, vulns, facts)


@pytest.mark.parametrize("pattern, facts", list(zip(topo.PATTERNS, (15, 15, 16, 15), strict=True)))
def test_patterns(spark, pattern, facts):
    engine = RecomputeEngine()
    engine.load_snapshot(topo.enterprise(spark))
    engine.apply_updates(topo.enterprise_update(spark, topo.Enterprise(), pattern))
    assert metrics.derived_count(engine.current_derived_facts()) == facts


def test_store_round_trip(spark, tmp_path):
    store = FactStore.of(spark, HARD)
    store.write(str(tmp_path / "s"))
    again = FactStore.read(spark, str(tmp_path / "s"))
    rows = lambda s: sorted((r.predicate, tuple(r.args)) for r in s.tagged().collect())
    assert rows(again) == rows(store) == rows(store_of(store.tagged()))


def test_whole_tables(spark, tmp_path):
    """The business tables count with every row: all customers attack, all line items are routes."""
    from breachline import queries
    from breachline.plans.facts import BASE
    from breachline.sources.tables import table_store

    r = random.Random(8)
    tables = {
        "part": ("p_partkey long, p_size int", [(k, r.randint(1, 50)) for k in range(12)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string", [(r.randrange(400), r.randrange(12), r.randrange(30), float(r.randint(1, 50)), r.choice("ANR")) for _ in range(60)]),
        "customer": ("c_custkey long", [(k,) for k in range(0, 450, 41)]),
        "nation": ("n_nationkey long", [(k,) for k in range(4)]),
        "events": ("event_id long, user_id long", [(k, r.randrange(5)) for k in range(40)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    store = table_store(spark, str(tmp_path))
    rows = {p: [tuple(x) for x in store.relation(p).select(*c).collect()] for p, c in BASE.items()}
    assert {a for a, *_ in rows["attackerLocated"]} == {a for a, _ in rows["attackGoal"]} == {f"attacker_{k}" for (k,) in tables["customer"][1]}
    assert len(rows["hacl"]) == len(rows["firewallDeny"]) == 60 and len(rows["attackGoal"]) == 4 * len(rows["attackerLocated"])
    assert state(rules.evaluate(store)) == derive(rows)
    patched = {h for h, _, s, p in rows["vulExists"] if (s, p) == ("ssh", "user")}
    assert {x.args[0] for x in queries._patch(store).collect()} == patched
    sums = {}
    for k, user in tables["events"][1]:
        if k < 39 / 2:
            key = (f"host_{user % 97}", f"CVE-{k % 3}")
            sums[key] = sums.get(key, 0) + (1 if k % 5 < 3 else -1)
    assert {(h, c): n for h, c, n in queries.state_as_of(spark, str(tmp_path)).collect()} == {k: n for k, n in sums.items() if n}
