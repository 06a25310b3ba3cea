import json

import pytest
from oracle import state

from breachline import cli
from breachline.functions import benchmarks, dot, topologies
from breachline.operators import rules
from breachline.operators.provenance import Explainer
from breachline.operators.updates import LOG, change_log
from breachline.plans.engines import IncrementalEngine
from breachline.plans.facts import FactStore
from breachline.sources.facts_text import LineError, ReadError, parsed, read_facts, read_updates, write_facts
from breachline.streaming.feed import ChangeFeed, read_log

SCENARIO = """% a chain of two
# and a local flaw
vulExists(web, CVE-1, https, user).
 localVulExists( web , CVE-L , root ) .
hacl(internet, web, https).
firewallDeny(web, db, ssh).
attackerLocated(eve, internet, user).

attackGoal(eve, web).
"""


def lines(spark, *texts):
    return spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "line_number bigint, line string")


@pytest.mark.parametrize(
    "line, error",
    [
        ("hacl(a, b, c)", "fact must end with a period"),
        ("hacl a, b, c.", "malformed fact: hacl a, b, c."),
        ("hacl(a, b, c) x.", "malformed fact: hacl(a, b, c) x."),
        ("foo(a,).", "malformed fact: a,"),
        ("foo(a).", "unknown predicate: foo"),
        ("remove(hacl(a, b, c)).", "unknown predicate: remove"),
        ("hacl(a, b).", "predicate hacl expects 3 arguments, found 2"),
        ("hacl(a, b, c). hacl(d, e, f).", "predicate hacl expects 3 arguments, found 5"),
        ("vulExists(a, b, c, Root).", "invalid privilege value: Root"),
    ],
)
def test_bad_lines(spark, line, error):
    assert parsed(lines(spark, line)).first().error == error


def test_good_lines(spark):
    got = parsed(lines(spark, "  hacl( a , b(c) , d ).  ", "% no", "", "attackGoal(e, f)."), updates=True).collect()
    assert [(r.line_number, r.op, r.predicate, r.args, r.error) for r in got] == [(1, "insert", "hacl", ["a", "b(c)", "d"], None), (4, "insert", "attackGoal", ["e", "f"], None)]


def test_updates_file(spark, tmp_path):
    path = tmp_path / "u"
    path.write_text("remove(hacl(a, b, c)).\r\n remove( attackGoal(a, b) ).\nremove(% x).\nhacl(a, b, c).\n")
    assert [(r.seq, r.op, r.predicate) for r in read_updates(spark, str(path)).orderBy("seq").collect()] == [(1, "remove", "hacl"), (2, "remove", "attackGoal"), (4, "insert", "hacl")]


def test_file_errors(spark, tmp_path):
    path = tmp_path / "f"
    path.write_text("hacl(a, b, c).\n\nhacl(a).\nnope\n")
    with pytest.raises(LineError, match="line 3: predicate hacl expects 3 arguments, found 1"):
        read_facts(spark, str(path))
    with pytest.raises(ReadError, match="failed to read"):
        read_facts(spark, str(tmp_path / "none"))


def test_file_round_trip(spark, tmp_path):
    path = tmp_path / "f"
    path.write_text(SCENARIO)
    store = read_facts(spark, str(path))
    write_facts(store, str(tmp_path / "g"))
    assert sorted(map(tuple, read_facts(spark, str(tmp_path / "g" / "part-*")).tagged().collect())) == sorted(map(tuple, store.tagged().collect()))


REMOTE = {
    "vulExists": [("db01", "CVE-2024-DB", "postgres", "root"), ("admin01", "CVE-2024-8888", "smb", "root")],
    "hacl": [("internet", "db01", "postgres"), ("db01", "admin01", "smb")],
    "attackerLocated": [("eve", "internet", "user")],
    "attackGoal": [("eve", "admin01")],
}
TREE = """goalReached(eve, admin01)
├── attackGoal(eve, admin01)
└── ownsMachine(eve, admin01)
    └── execCode(eve, admin01, root)
        ├── execCode(eve, db01, root)
        │   ├── execCode(eve, internet, user)
        │   │   └── attackerLocated(eve, internet, user)
        │   ├── effectiveAccess(internet, db01, postgres)
        │   │   └── hacl(internet, db01, postgres)
        │   └── vulExists(db01, CVE-2024-DB, postgres, root)
        ├── effectiveAccess(db01, admin01, smb)
        │   └── hacl(db01, admin01, smb)
        └── vulExists(admin01, CVE-2024-8888, smb, root)
"""


def test_proofs(spark):
    explainer = Explainer(FactStore.of(spark, REMOTE))
    tree = explainer.explain("goalReached", ("eve", "admin01"))
    assert tree.pretty() == TREE and tree.rule == "goal_reached_from_goal_and_ownership"
    assert explainer.explain("execCode", ("eve", "db01", "user")) is None
    assert explainer.explain("hacl", ("db01", "admin01", "smb")).children == ()
    text = dot.proof_dot(tree)
    assert text.startswith("digraph ExplanationTree {\n    graph [rankdir=BT") and "    rule_1 -> fact_0 [penwidth=1.7];\n" in text and text.endswith("\n    { rank=max; fact_0; }\n}\n")


def test_local_proof_and_cycles(spark):
    rows = {"vulExists": [("web", "CVE-W", "https", "user"), ("a", "C", "s", "user"), ("web", "CVE-A", "s", "user")], "localVulExists": [("web", "CVE-L", "root")], "hacl": [("internet", "web", "https"), ("web", "a", "s"), ("a", "web", "s")], "attackerLocated": [("eve", "internet", "user")], "attackGoal": [("eve", "web")]}
    tree = Explainer(FactStore.of(spark, rows)).explain("goalReached", ("eve", "web"))
    assert "execCode(eve, web, root)\n        ├── execCode(eve, web, user)\n        │   ├── execCode(eve, internet, user)" in tree.pretty()
    assert Explainer(FactStore.of(spark, rows | {"firewallDeny": [("internet", "web", "https")]})).explain("effectiveAccess", ("internet", "web", "https")) is None


def test_state_picture(spark):
    store = topologies.chain(spark, 3)
    text = dot.state_dot(store.network_access, rules.reach_hosts(store), "node_0", "node_2", "t")
    assert '"node_2" [fillcolor=red, label="node_2 [TARGET - COMPROMISED!]"]' in text and '"node_0" -> "node_1" [label="ssh", color=red, penwidth=2.0];' in text


def test_stream(spark, tmp_path):
    for d in ("in", "out"):
        (tmp_path / d).mkdir()
    engine = IncrementalEngine()
    engine.load_snapshot(FactStore.of(spark, REMOTE))
    feed = ChangeFeed(engine, str(tmp_path / "out"))
    change_log(spark, [("insert", "firewallDeny", ("db01", "admin01", "smb", "deny"))]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = feed.start(read_log(spark, str(tmp_path / "in")), str(tmp_path / "check"))
    q.processAllAvailable()
    change_log(spark, [("remove", "firewallDeny", ("db01", "admin01", "smb", "deny"))]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = {(r.batch, r.predicate, r.diff) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(b, p, d) for b, d in ((0, -1), (1, 1)) for p in ("execCode", "ownsMachine", "goalReached")}
    feed.batch(spark.createDataFrame([], LOG), 1)  # a batch that comes again changes nothing
    assert state(engine.current_derived_facts())["goalReached"] == {("eve", "admin01")}


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "s").write_text(SCENARIO)
    (tmp_path / "u").write_text("remove(localVulExists(web, CVE-L, root)).\n")
    cli.run_scenario(spark, str(tmp_path / "s"), explain="goal", dot=str(tmp_path / "p.dot"))
    said = capsys.readouterr().out
    assert "Loaded 1 remote vulnerabilities, 1 local vulnerabilities, 1 network edges, 1 firewall rules, 1 attacker positions, 1 goals" in said
    assert "  [t=0] + goalReached(eve, web) (TARGET COMPROMISED)" in said and "└── ownsMachine(eve, web)" in said and (tmp_path / "p.dot").exists()
    cli.run_scenario(spark, str(tmp_path / "s"), str(tmp_path / "u"))
    assert "  [t=1] - execCode(eve, web, root)" in capsys.readouterr().out


def test_demo(spark, capsys):
    """The four states of the demonstration, as derived from the rules by hand."""
    from breachline.functions import demo

    got = [state(s) for _, _, s, _ in demo.run(spark)]
    loaded = {("eve", "internet", "user"), ("eve", "web01", "user"), ("eve", "db01", "user"), ("eve", "db01", "root"), ("eve", "admin01", "root")}
    assert [s["execCode"] for s in got] == [loaded, loaded, {("eve", "internet", "user")}, loaded]
    assert [len(s["ownsMachine"]) for s in got] == [2, 2, 0, 2] and [len(s["goalReached"]) for s in got] == [1, 1, 0, 1]
    cli.run_demo(spark)
    said = capsys.readouterr().out
    assert "  [t=2] - goalReached(eve, admin01) (TARGET COMPROMISED)" in said and "[t=1]" not in said and said.count("PHASE") == 4


def test_random_cut(spark):
    row, steps = benchmarks.random_cut_benchmark(spark, 6, 2)
    assert len(steps) == 2 and row.derived_facts_before == 13 and 0 < row.derived_facts_after < 13
    lines = benchmarks.random_cut_table([(row, steps)]).splitlines()
    assert len({x.count("|") for x in lines}) == 1 and lines[2].startswith("| 6 | 2 |")


def test_benchmark_tables(spark):
    row = benchmarks.star_benchmark(spark, 5)
    assert (row.derived_facts_before, row.derived_facts_after, row.affected_hosts, row.changed_derived_facts) == (13, 11, 1, 2)
    text = benchmarks.to_csv([row, benchmarks.Row("a,b", 'c"d', 1, 2, 3, "u", 1.0, 2.0, 3.0, 4.0, 5, 6)])
    assert text.splitlines()[2] == '"a,b","c""d",1,2,3,u,1.000000,2.000000,3.000000,4.000000,5,6,,,,,,,'
    assert len({x.count("|") for x in benchmarks.size_table([row]).splitlines()}) == len({x.count("|") for x in benchmarks.enterprise_table([row]).splitlines()}) == 1
    assert "patch_one_leaf_vulnerability" in benchmarks.to_markdown([row]) and "\\hline" in benchmarks.to_latex([row]) and json.dumps(benchmarks.summary(row))
