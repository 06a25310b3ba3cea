"""Registered queries of the rule engine over the business tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breachline.functions import topologies as topo
from breachline.operators import metrics, rules, updates
from breachline.operators.provenance import proof_edges
from breachline.plans.engines import Engine, IncrementalEngine, RecomputeEngine
from breachline.plans.facts import FactStore, fact_text
from breachline.sources.facts_text import parsed
from breachline.sources.tables import VIEWS, table_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NAMES = {"hacl": "hacl", "firewallDeny": "fw", "vulExists": "vul", "localVulExists": "lvul", "attackerLocated": "pos", "attackGoal": "goal"}
BASE_SQL = ", ".join(f"{NAMES[p]} AS ({text})" for p, text in VIEWS.items())


def _program(*, vul="vul", fw="fw", lvul="lvul", hacl="hacl", pos="pos", goal="goal", tag="") -> str:
    """Common table expressions of the derived relations over named base relations."""
    return f"""eff{tag} AS (SELECT DISTINCT source_host, destination_host, service_name FROM {hacl} h WHERE NOT EXISTS (
      SELECT 1 FROM {fw} f WHERE f.rule_action = 'deny' AND f.source_zone = h.source_host AND f.destination_host = h.destination_host AND f.service_name = h.service_name)),
    ex{tag}(attacker_id, compromised_host, obtained_privilege) AS (
      SELECT attacker_id, starting_host, initial_privilege FROM {pos}
      UNION SELECT * FROM (
        SELECT e.attacker_id, v.host_name, v.privilege FROM ex{tag} e JOIN eff{tag} f ON f.source_host = e.compromised_host JOIN {vul} v ON v.host_name = f.destination_host AND v.affected_service = f.service_name
        UNION ALL SELECT e.attacker_id, e.compromised_host, l.privilege FROM ex{tag} e JOIN {lvul} l ON l.host_name = e.compromised_host WHERE e.obtained_privilege <> 'root')),
    own{tag} AS (SELECT DISTINCT attacker_id, compromised_host AS owned_host FROM ex{tag} WHERE obtained_privilege = 'root'),
    got{tag} AS (SELECT DISTINCT g.attacker_id, g.target_host_name AS reached_target FROM {goal} g JOIN own{tag} o ON o.attacker_id = g.attacker_id AND o.owned_host = g.target_host_name)"""


def _facts_sql(tag: str = "") -> str:
    """All derived facts as (predicate, fact)."""
    return f"""SELECT 'effectiveAccess' AS predicate, 'effectiveAccess(' || source_host || ', ' || destination_host || ', ' || service_name || ')' AS fact FROM eff{tag}
      UNION ALL SELECT 'execCode', 'execCode(' || attacker_id || ', ' || compromised_host || ', ' || obtained_privilege || ')' FROM ex{tag}
      UNION ALL SELECT 'ownsMachine', 'ownsMachine(' || attacker_id || ', ' || owned_host || ')' FROM own{tag}
      UNION ALL SELECT 'goalReached', 'goalReached(' || attacker_id || ', ' || reached_target || ')' FROM got{tag}"""


def _with(body: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([BASE_SQL, *more])} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


for _p, _n in NAMES.items():
    QUERIES[f"scan_{_n}"] = lambda spark, d, p=_p: table_store(spark, d).relation(p)
    SQL[f"scan_{_n}"] = _with(f"SELECT * FROM {_n}")

PROGRAM = _program()
_EXEC_ALL = "SELECT attacker_id, compromised_host, obtained_privilege FROM ex"


@query("blocked_routes", _with("SELECT DISTINCT source_zone AS source_host, destination_host, service_name FROM fw WHERE rule_action = 'deny'"))
def blocked_routes(spark: SparkSession, d: str) -> DataFrame:
    return rules.blocked_routes(table_store(spark, d))


@query("effective_access", _with("SELECT * FROM eff", PROGRAM))
def effective_access(spark: SparkSession, d: str) -> DataFrame:
    return rules.effective_access(table_store(spark, d))


@query("effective_access_bag", _with("SELECT h.source_host, h.destination_host, h.service_name, count(*) AS copies FROM hacl h JOIN eff USING (source_host, destination_host, service_name) GROUP BY ALL", PROGRAM))
def effective_access_bag(spark: SparkSession, d: str) -> DataFrame:
    return rules.effective_access_bag(table_store(spark, d)).groupBy(*rules.ROUTE).agg(F.count("*").alias("copies"))


@query("initial_exec", _with("SELECT DISTINCT attacker_id, starting_host AS compromised_host, initial_privilege AS obtained_privilege FROM pos"))
def initial_exec(spark: SparkSession, d: str) -> DataFrame:
    return rules.initial_exec(table_store(spark, d))


_EDGES = "edge AS (SELECT DISTINCT e.source_host AS src, e.destination_host AS dst FROM eff e JOIN vul v ON v.host_name = e.destination_host AND v.affected_service = e.service_name)"


@query("exploit_edges", _with("SELECT * FROM edge", PROGRAM, _EDGES))
def exploit_edges(spark: SparkSession, d: str) -> DataFrame:
    return rules.exploit_edges(table_store(spark, d))


# keyed by pair: a pair that is there already doesn't come again, so the walk ends whatever the depth
_WALK = """walk(attacker_id, host, round) USING KEY (attacker_id, host) AS (SELECT DISTINCT attacker_id, starting_host, 0::BIGINT FROM pos UNION
  SELECT DISTINCT w.attacker_id, e.dst, w.round + 1 FROM walk w JOIN edge e ON e.src = w.host WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.attacker_id = w.attacker_id AND r.host = e.dst))"""
_REACH = _with("SELECT attacker_id, host, round FROM walk", PROGRAM, _EDGES, _WALK)


@query("reach_hosts", _REACH)
def reach_hosts(spark: SparkSession, d: str) -> DataFrame:
    return rules.reach_hosts(table_store(spark, d))


@query("reach_hosts_rounds", _REACH)
def reach_hosts_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same by set-at-a-time rounds, as for graphs too large to send around."""
    return rules.reach_hosts(table_store(spark, d), small_edges=0)


_NO_LOCAL = _program(lvul="(SELECT * FROM lvul WHERE false)")


@query("exec_code_remote", _with(_EXEC_ALL, _NO_LOCAL))
def exec_code_remote(spark: SparkSession, d: str) -> DataFrame:
    return rules.exec_code(table_store(spark, d), local=False)


@query("exec_code", _with(_EXEC_ALL, PROGRAM))
def exec_code(spark: SparkSession, d: str) -> DataFrame:
    return rules.exec_code(table_store(spark, d))


def _hops_sql(n: int) -> str:
    steps = ["x0 AS (SELECT attacker_id, starting_host AS compromised_host, initial_privilege AS obtained_privilege FROM pos)"]
    for k in range(1, n + 1):
        steps.append(f"x{k} AS (SELECT * FROM x{k - 1} UNION SELECT x.attacker_id, v.host_name, v.privilege FROM x{k - 1} x JOIN hacl h ON h.source_host = x.compromised_host JOIN vul v ON v.host_name = h.destination_host AND v.affected_service = h.service_name)")
    return _with(f"SELECT attacker_id, compromised_host, obtained_privilege FROM x{n}", *steps)


for _k in (0, 1, 3):
    QUERIES[f"exec_code_hops_{_k}"] = lambda spark, d, k=_k: rules.evaluate_hops(table_store(spark, d), k).code_executions
    SQL[f"exec_code_hops_{_k}"] = _hops_sql(_k)


@query("goals_hops_3", _hops_sql(3).replace("SELECT attacker_id, compromised_host, obtained_privilege FROM x3", "SELECT g.attacker_id, g.target_host_name AS reached_target, count(*) AS copies FROM goal g JOIN (SELECT DISTINCT attacker_id, compromised_host FROM x3 WHERE obtained_privilege = 'root') o ON o.attacker_id = g.attacker_id AND o.compromised_host = g.target_host_name GROUP BY ALL"))
def goals_hops_3(spark: SparkSession, d: str) -> DataFrame:
    """Goals within three hops, as often as they are stated."""
    return rules.evaluate_hops(table_store(spark, d), 3).goals_reached.groupBy("attacker_id", "reached_target").agg(F.count("*").alias("copies"))


@query("owns_machine", _with("SELECT * FROM own", PROGRAM))
def owns_machine(spark: SparkSession, d: str) -> DataFrame:
    return rules.evaluate(table_store(spark, d)).machines_owned


@query("goal_reached", _with("SELECT * FROM got", PROGRAM))
def goal_reached(spark: SparkSession, d: str) -> DataFrame:
    return rules.evaluate(table_store(spark, d)).goals_reached


@query("goal_reached_bag", _with("SELECT g.attacker_id, g.target_host_name AS reached_target, count(*) AS copies FROM (SELECT * FROM goal UNION ALL SELECT * FROM goal) g JOIN own o ON o.attacker_id = g.attacker_id AND o.owned_host = g.target_host_name GROUP BY ALL", PROGRAM))
def goal_reached_bag(spark: SparkSession, d: str) -> DataFrame:
    """Every goal stated twice is reached twice."""
    s = table_store(spark, d)
    s = s.with_relation("attackGoal", s.attacker_goals.unionAll(s.attacker_goals))
    return rules.goals_bag(s).groupBy("attacker_id", "reached_target").agg(F.count("*").alias("copies"))


@query("demo_owns_any_root", _with("SELECT x.attacker_id, x.compromised_host AS owned_host, count(*) AS copies FROM (SELECT DISTINCT attacker_id, compromised_host FROM ex) x JOIN vul v ON v.host_name = x.compromised_host AND v.privilege = 'root' GROUP BY ALL", PROGRAM))
def demo_owns_any_root(spark: SparkSession, d: str) -> DataFrame:
    return rules.demo_owned(table_store(spark, d)).groupBy("attacker_id", "owned_host").agg(F.count("*").alias("copies"))


@query("goal_relevant_edges", _with("SELECT DISTINCT e.src, e.dst FROM edge e JOIN back b ON b.host = e.dst", PROGRAM, _EDGES, "back(host) AS (SELECT target_host_name FROM goal UNION SELECT e.src FROM back b JOIN edge e ON e.dst = b.host)"))
def goal_relevant_edges(spark: SparkSession, d: str) -> DataFrame:
    return rules.goal_relevant_edges(table_store(spark, d))


@query("derived_counts", _with("SELECT (SELECT count(*) FROM ex) AS exec_code, (SELECT count(*) FROM own) AS owns_machine, (SELECT count(*) FROM got) AS goal_reached, (SELECT count(*) FROM ex) + (SELECT count(*) FROM own) + (SELECT count(*) FROM got) AS facts", PROGRAM))
def derived_counts(spark: SparkSession, d: str) -> DataFrame:
    s = rules.evaluate(table_store(spark, d))
    held = s.code_executions.agg(F.count("*").alias("exec_code"), F.count_if(F.col("obtained_privilege") == "root").alias("owns_machine"))
    got = s.goals_reached.agg(F.count("*").alias("goal_reached"))
    return held.crossJoin(got).withColumn("facts", F.col("exec_code") + F.col("owns_machine") + F.col("goal_reached"))


@query("host_census", _with("SELECT source_host AS host FROM hacl UNION SELECT destination_host FROM hacl UNION SELECT host_name FROM vul UNION SELECT starting_host FROM pos UNION SELECT target_host_name FROM goal"))
def host_census(spark: SparkSession, d: str) -> DataFrame:
    return metrics.host_census(table_store(spark, d))


# Updates: each as a change log over the tables, and as SQL over the updated relations.
def _log(df: DataFrame, op: str, predicate: str, *columns: str) -> DataFrame:
    """A change log of the rows of df; the order of rows of one kind doesn't matter, so their numbers are hashes."""
    args = F.array(*[F.col(c).cast("string") for c in columns])
    seq = F.pmod(F.xxhash64(*columns), F.lit(1_000_000))
    return df.select(seq.alias("seq"), F.lit(op).alias("op"), F.lit(predicate).alias("predicate"), args.alias("args"))


# They pick facts by what they say, so that they grow with the tables.
_PATCHED = "affected_service = 'ssh' AND privilege = 'user'"
_DENIED = "service_name = 'smb'"


def _patch(s: FactStore) -> DataFrame:
    return _log(s.vulnerabilities.filter(_PATCHED), "remove", "vulExists", *s.vulnerabilities.columns)


def _deny(s: FactStore) -> DataFrame:
    return _log(s.network_access.filter(F.expr(_DENIED)).distinct(), "insert", "firewallDeny", *rules.ROUTE)


def _new_vuln(s: FactStore) -> DataFrame:
    hosts = s.attacker_goals.select(F.col("target_host_name").alias("h"), F.lit("CVE-NEW").alias("c"), F.lit("http").alias("v"), F.lit("root").alias("p")).distinct()
    return _log(hosts, "insert", "vulExists", "h", "c", "v", "p")


def _undeny(s: FactStore) -> DataFrame:
    """Every copy of every deny rule."""
    deny = s.firewall_rules.filter("rule_action = 'deny'")
    return _log(deny, "remove", "firewallDeny", *deny.columns)


_UPDATED = {
    "patch": (_patch, {"vul": f"(SELECT * FROM vul WHERE NOT ({_PATCHED}))"}),
    "deny": (_deny, {"fw": f"(SELECT * FROM fw UNION ALL SELECT source_host, destination_host, service_name, 'deny' FROM hacl WHERE {_DENIED})"}),
    "new_vuln": (_new_vuln, {"vul": "(SELECT * FROM vul UNION ALL SELECT DISTINCT target_host_name, 'CVE-NEW', 'http', 'root' FROM goal)"}),
    "deny_removed": (_undeny, {"fw": "(SELECT * FROM fw WHERE rule_action <> 'deny')"}),
    "batch": (lambda s: _patch(s).unionByName(_new_vuln(s).withColumn("seq", F.col("seq") + 1_000_000)), {"vul": f"(SELECT * FROM vul WHERE NOT ({_PATCHED}) UNION ALL SELECT DISTINCT target_host_name, 'CVE-NEW', 'http', 'root' FROM goal)"}),
}


def _updated(spark: SparkSession, d: str, name: str, engine: Engine | None = None):
    engine = engine or IncrementalEngine()
    engine.load_snapshot(table_store(spark, d))
    before = engine.current_derived_facts()
    engine.apply_updates(_UPDATED[name][0](table_store(spark, d)))
    return before, engine.current_derived_facts()


_DIFF_SQL = f"""old AS ({_facts_sql()}), new AS ({_facts_sql("2")}),
  diff AS (SELECT predicate, fact, 1::BIGINT AS diff FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT predicate, fact, -1 FROM (SELECT * FROM old EXCEPT SELECT * FROM new))"""


def _diff_sql(name: str, body: str) -> str:
    return _with(body, PROGRAM, _program(**_UPDATED[name][1], tag="2"), _DIFF_SQL)


for _u in _UPDATED:
    QUERIES[f"exec_after_{_u}"] = lambda spark, d, u=_u: _updated(spark, d, u)[1].code_executions
    SQL[f"exec_after_{_u}"] = _with(f"{_EXEC_ALL}2", _program(**_UPDATED[_u][1], tag="2"))


def _feed(spark: SparkSession, d: str, name: str) -> DataFrame:
    before, after = _updated(spark, d, name)
    feed = updates.change_feed(before, after, 1)
    return feed.select("time", fact_text(F.col("predicate"), F.col("args")).alias("fact"), "diff")


@query("exec_after_patch_recomputed", SQL["exec_after_patch"])
def exec_after_patch_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """The same update by the engine that evaluates everything anew."""
    return _updated(spark, d, "patch", RecomputeEngine())[1].code_executions


@query("positive_records", _with(f"SELECT predicate, fact FROM ({_facts_sql('2')}) WHERE predicate <> 'effectiveAccess'", PROGRAM, _program(**_UPDATED["patch"][1], tag="2")))
def positive_records(spark: SparkSession, d: str) -> DataFrame:
    """What the feed of a load and of a patch leaves, as a set: the state after both."""
    before, after = _updated(spark, d, "patch")
    return updates.left(before, after).select("predicate", fact_text(F.col("predicate"), F.col("args")).alias("fact"))


for _u in ("patch", "deny"):
    QUERIES[f"change_feed_{_u}"] = lambda spark, d, u=_u: _feed(spark, d, u)
    SQL[f"change_feed_{_u}"] = _diff_sql(_u, "SELECT 1::BIGINT AS time, fact, diff FROM diff WHERE predicate <> 'effectiveAccess'")


@query("update_metrics", _diff_sql("patch", """SELECT 0::BIGINT AS changed_base_facts, count(*) FILTER (predicate = 'execCode') AS changed_exec_code_facts, count(*) FILTER (predicate = 'ownsMachine') AS changed_ownership_facts,
  count(*) FILTER (predicate = 'goalReached') AS changed_goal_facts, count(*) AS changed_derived_facts, 
  (SELECT count(DISTINCT regexp_extract(fact, ', (host_[0-9]+)', 1)) FROM diff) AS affected_hosts FROM diff"""))
def update_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a patch, which leaves effective access alone."""
    return metrics.update_metrics(*_updated(spark, d, "patch")).drop("recursive_depth_estimate")


@query("affected_hosts", _diff_sql("deny", """SELECT regexp_extract(fact, ', (host_[0-9]+)', 1) AS host FROM diff UNION SELECT regexp_extract(fact, '\\((host_[0-9]+), host', 1) FROM diff WHERE predicate = 'effectiveAccess'"""))
def affected_hosts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.affected_hosts(*_updated(spark, d, "deny"))


@query("diff_sample")
def diff_sample(spark: SparkSession, d: str) -> DataFrame:
    return metrics.difference_sample(*_updated(spark, d, "patch"))


SQL["diff_sample"] = _with(
    """SELECT relation, side, place, fact FROM (SELECT CASE predicate WHEN 'execCode' THEN 'code_executions' WHEN 'ownsMachine' THEN 'machines_owned' WHEN 'goalReached' THEN 'goals_reached' ELSE 'effective_network_access' END AS relation,
  CASE WHEN diff < 0 THEN 'only_left' ELSE 'only_right' END AS side, row_number() OVER (PARTITION BY predicate, diff ORDER BY string_split(regexp_extract(fact, '\\((.*)\\)', 1), ', ')) AS place, fact FROM diff) WHERE place <= 5""",
    PROGRAM, _program(**_UPDATED["patch"][1], tag="2"), _DIFF_SQL,
)

# A change log from the event stream: three kinds of event in five insert, the others remove.
_EVENT_LOG = "SELECT event_id AS seq, CASE WHEN event_id % 5 < 3 THEN 'insert' ELSE 'remove' END AS op, 'host_' || (user_id % 97) AS host, 'CVE-' || (event_id % 3) AS cve FROM events"


def _event_log(spark: SparkSession, d: str) -> DataFrame:
    events = spark.sql(_EVENT_LOG.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    return events.select("seq", "op", F.lit("localVulExists").alias("predicate"), F.array("host", "cve", F.lit("root")).alias("args"))


@query("update_replay_clamped", f"""WITH log AS ({_EVENT_LOG}), s AS (SELECT host, cve, sum(CASE op WHEN 'insert' THEN 1 ELSE -1 END) OVER w AS s, row_number() OVER (PARTITION BY host, cve ORDER BY seq DESC) AS back FROM log WINDOW w AS (PARTITION BY host, cve ORDER BY seq))
  SELECT 'localVulExists' AS predicate, host, cve AS vulnerability_id, (max(s) FILTER (back = 1) - least(0, min(s)))::BIGINT AS copies FROM s GROUP BY host, cve HAVING max(s) FILTER (back = 1) - least(0, min(s)) > 0""")
def update_replay_clamped(spark: SparkSession, d: str) -> DataFrame:
    none = updates.counted(FactStore.of(spark, {}))
    got = updates.replayed(none, _event_log(spark, d))
    return got.select("predicate", F.get("args", F.lit(0)).alias("host"), F.get("args", F.lit(1)).alias("vulnerability_id"), "copies")


@query("state_as_of", f"SELECT host, cve AS vulnerability_id, sum(CASE op WHEN 'insert' THEN 1 ELSE -1 END)::BIGINT AS diff FROM ({_EVENT_LOG}) WHERE seq < (SELECT max(event_id) / 2 FROM events) GROUP BY host, cve HAVING sum(CASE op WHEN 'insert' THEN 1 ELSE -1 END) <> 0")
def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    """As of the middle of the stream."""
    feed = _event_log(spark, d).select(F.col("seq").alias("time"), "predicate", "args", F.when(F.col("op") == "insert", 1).otherwise(-1).alias("diff"))
    half = spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id") / 2).first()[0]
    got = updates.state_as_of(feed, F.lit(half))
    return got.select(F.get("args", F.lit(0)).alias("host"), F.get("args", F.lit(1)).alias("vulnerability_id"), "diff")


@query("proof_edges_goal", _with("""SELECT 'goalReached(' || attacker_id || ', ' || reached_target || ')' AS fact, 'goal_reached_from_goal_and_ownership' AS rule, 0::BIGINT AS place, 'attackGoal(' || attacker_id || ', ' || reached_target || ')' AS premise FROM got
  UNION ALL SELECT 'goalReached(' || attacker_id || ', ' || reached_target || ')', 'goal_reached_from_goal_and_ownership', 1, 'ownsMachine(' || attacker_id || ', ' || reached_target || ')' FROM got
  UNION ALL SELECT 'ownsMachine(' || attacker_id || ', ' || owned_host || ')', 'ownership_from_root_exec_code', 0, 'execCode(' || attacker_id || ', ' || owned_host || ', root)' FROM own""", PROGRAM))
def proof_edges_goal(spark: SparkSession, d: str) -> DataFrame:
    return _shown_edges(proof_edges(table_store(spark, d), ("goalReached", "ownsMachine")))


def _shown_edges(edges: DataFrame) -> DataFrame:
    return edges.select(fact_text(F.col("predicate"), F.col("args")).alias("fact"), "rule", "place", fact_text(F.col("premise"), F.col("premise_args")).alias("premise"))


_RANKED = """way AS (SELECT DISTINCT e.source_host, v.host_name, v.privilege FROM eff e JOIN vul v ON v.host_name = e.destination_host AND v.affected_service = e.service_name),
  held AS (SELECT attacker_id, host, priv, min(rank) AS rank FROM (SELECT attacker_id, starting_host AS host, initial_privilege AS priv, 0 AS rank FROM pos
    UNION ALL SELECT w.attacker_id, y.host_name, y.privilege, 2 * (w.round + 1) FROM walk w JOIN way y ON y.source_host = w.host) GROUP BY ALL),
  ranked AS (SELECT attacker_id, host, priv, min(rank) AS rank FROM (SELECT * FROM held UNION ALL SELECT h.attacker_id, h.host, l.privilege, h.rank + 1 FROM held h JOIN lvul l ON l.host_name = h.host AND l.privilege <> h.priv WHERE h.priv <> 'root') GROUP BY ALL),
  step AS (
    SELECT attacker_id, starting_host AS host, initial_privilege AS priv, 0 AS kind, '' AS cve, '' AS service, '' AS source, '' AS gate FROM pos
    UNION ALL SELECT f.attacker_id, f.host, f.priv, 1, l.vulnerability_id, '', f.host, g.priv FROM ranked f JOIN lvul l ON l.host_name = f.host AND l.privilege = f.priv JOIN ranked g ON g.attacker_id = f.attacker_id AND g.host = f.host AND g.priv <> 'root' AND g.priv <> f.priv AND g.rank < f.rank
    UNION ALL SELECT f.attacker_id, f.host, f.priv, 2, v.vulnerability_id, v.affected_service, e.source_host, g.priv FROM ranked f JOIN vul v ON v.host_name = f.host AND v.privilege = f.priv
      JOIN eff e ON e.destination_host = v.host_name AND e.service_name = v.affected_service JOIN ranked g ON g.attacker_id = f.attacker_id AND g.host = e.source_host AND g.rank < f.rank
  ), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attacker_id, host, priv ORDER BY kind, cve, service, source, CASE gate WHEN 'none' THEN 0 WHEN 'user' THEN 1 ELSE 2 END) AS k FROM step) WHERE k = 1),
  shown AS (SELECT *, 'execCode(' || attacker_id || ', ' || host || ', ' || priv || ')' AS fact FROM best)"""


@query("proof_edges_exec", _with("""SELECT fact, 'initial_exec_code_from_attacker_location' AS rule, 0::BIGINT AS place, 'attackerLocated(' || attacker_id || ', ' || host || ', ' || priv || ')' AS premise FROM shown WHERE kind = 0
  UNION ALL SELECT fact, 'exec_code_from_local_privilege_escalation', 0, 'execCode(' || attacker_id || ', ' || host || ', ' || gate || ')' FROM shown WHERE kind = 1
  UNION ALL SELECT fact, 'exec_code_from_local_privilege_escalation', 1, 'localVulExists(' || host || ', ' || cve || ', ' || priv || ')' FROM shown WHERE kind = 1
  UNION ALL SELECT fact, 'exec_code_from_network_reachability_and_vulnerability', 0, 'execCode(' || attacker_id || ', ' || source || ', ' || gate || ')' FROM shown WHERE kind = 2
  UNION ALL SELECT fact, 'exec_code_from_network_reachability_and_vulnerability', 1, 'effectiveAccess(' || source || ', ' || host || ', ' || service || ')' FROM shown WHERE kind = 2
  UNION ALL SELECT fact, 'exec_code_from_network_reachability_and_vulnerability', 2, 'vulExists(' || host || ', ' || cve || ', ' || service || ', ' || priv || ')' FROM shown WHERE kind = 2""", PROGRAM, _EDGES, _WALK, _RANKED))
def proof_edges_exec(spark: SparkSession, d: str) -> DataFrame:
    """The chosen step of every execution."""
    return _shown_edges(proof_edges(table_store(spark, d), ("execCode",)))


@query("proof_edges_access", _with("""SELECT 'effectiveAccess(' || source_host || ', ' || destination_host || ', ' || service_name || ')' AS fact, 'effective_access_from_hacl_without_firewall_deny' AS rule, 0::BIGINT AS place,
  'hacl(' || source_host || ', ' || destination_host || ', ' || service_name || ')' AS premise FROM eff""", PROGRAM))
def proof_edges_access(spark: SparkSession, d: str) -> DataFrame:
    """Why each effective access holds."""
    return _shown_edges(proof_edges(table_store(spark, d), ("effectiveAccess",)))


# Generated networks.
_CHAIN = "SELECT 'node_' || i AS host_name, 'CVE-CHAIN-' || i AS vulnerability_id, 'ssh' AS affected_service, 'root' AS privilege FROM range(200) t(i)"
_STAR = "SELECT 'hub' AS host_name, 'CVE-HUB-0' AS vulnerability_id, 'ssh' AS affected_service, 'root' AS privilege UNION ALL SELECT 'leaf_' || i, 'CVE-LEAF-' || i, 'ssh', 'root' FROM range(1000) t(i)"
_MESH = "SELECT 'node_' || x || '_' || y AS host_name, 'CVE-MESH-' || x || '-' || y AS vulnerability_id, 'ssh' AS affected_service, 'root' AS privilege FROM range(12) a(x), range(9) b(y)"
_GENERATED = {
    "chain": (lambda s: topo.chain(s, 200), _CHAIN, "SELECT 'node_' || i AS source_host, 'node_' || (i + 1) AS destination_host, 'ssh' AS service_name FROM range(199) t(i)", "SELECT 'attacker' AS attacker_id, 'node_' || i AS compromised_host, 'root' AS obtained_privilege FROM range(200) t(i)"),
    "star": (lambda s: topo.star(s, 1000), _STAR, "SELECT 'hub' AS source_host, 'leaf_' || i AS destination_host, 'ssh' AS service_name FROM range(1000) t(i)", "SELECT 'attacker' AS attacker_id, 'leaf_' || i AS compromised_host, 'root' AS obtained_privilege FROM range(1000) t(i) UNION ALL SELECT 'attacker', 'hub', 'root'"),
    "mesh": (
        lambda s: topo.mesh(s, 12, 9), _MESH,
        "SELECT 'node_' || x || '_' || y AS source_host, 'node_' || (x + 1) || '_' || y AS destination_host, 'ssh' AS service_name FROM range(11) a(x), range(9) b(y) UNION ALL SELECT 'node_' || x || '_' || y, 'node_' || x || '_' || (y + 1), 'ssh' FROM range(12) a(x), range(8) b(y)",
        "SELECT 'attacker' AS attacker_id, 'node_' || x || '_' || y AS compromised_host, 'root' AS obtained_privilege FROM range(12) a(x), range(9) b(y)",
    ),
}
_LAYERS = "(VALUES ('web', 8, 'https', 'user'), ('app', 6, 'http', 'user'), ('db', 3, 'postgres', 'user'), ('admin', 1, 'smb', 'root'))"
_ENT_VUL = f"""SELECT l || '_' || h AS host_name, 'CVE-ENTERPRISE-' || upper(l) || '-' || h || '-0' AS vulnerability_id, s AS affected_service, p AS privilege FROM {_LAYERS} t(l, n, s, p), range(8) r(h)
  WHERE h < n AND (h = 0 OR (h * 37 + 11) % 100 < 75)"""
_ENT_ACCESS = """SELECT 'internet' AS source_host, 'web_' || i AS destination_host, 'https' AS service_name FROM range(8) t(i) UNION ALL SELECT 'web_' || i, 'app_' || j, 'http' FROM range(8) t(i), range(6) u(j)
  UNION ALL SELECT 'app_' || i, 'db_' || j, 'postgres' FROM range(6) t(i), range(3) u(j) UNION ALL SELECT 'db_' || i, 'admin_0', 'smb' FROM range(3) t(i)"""


def _enterprise_sql(body: str, vul: str = "v0", fw: str = "SELECT NULL AS source_zone, NULL AS destination_host, NULL AS service_name, 'deny' AS rule_action WHERE false") -> str:
    return f"""WITH RECURSIVE v0 AS ({_ENT_VUL}), hacl AS ({_ENT_ACCESS}), vul AS (SELECT * FROM {vul}), fw AS ({fw}), lvul AS (SELECT NULL AS host_name, NULL AS vulnerability_id, NULL AS privilege WHERE false),
  pos AS (SELECT 'attacker' AS attacker_id, 'internet' AS starting_host, 'user' AS initial_privilege), goal AS (SELECT 'attacker' AS attacker_id, 'admin_0' AS target_host_name), {PROGRAM} {body}"""


for _g, (_make, _vul, _acc, _ex) in _GENERATED.items():
    QUERIES[f"gen_{_g}_vulnerabilities"] = lambda spark, d, m=_make: m(spark).vulnerabilities
    QUERIES[f"gen_{_g}_access"] = lambda spark, d, m=_make: m(spark).network_access
    QUERIES[f"gen_{_g}_exec"] = lambda spark, d, m=_make: rules.evaluate(m(spark)).code_executions
    SQL |= {f"gen_{_g}_vulnerabilities": _vul, f"gen_{_g}_access": _acc, f"gen_{_g}_exec": _ex}

QUERIES["gen_enterprise_vulnerabilities"] = lambda spark, d: topo.enterprise(spark).vulnerabilities
QUERIES["gen_enterprise_access"] = lambda spark, d: topo.enterprise(spark).network_access
QUERIES["gen_enterprise_exec"] = lambda spark, d: rules.evaluate(topo.enterprise(spark)).code_executions
SQL |= {"gen_enterprise_vulnerabilities": _ENT_VUL, "gen_enterprise_access": _ENT_ACCESS, "gen_enterprise_exec": _enterprise_sql(_EXEC_ALL)}

_ORDERED = "SELECT host_name, vulnerability_id, affected_service, privilege FROM (SELECT *, row_number() OVER (ORDER BY CASE split_part(host_name, '_', 1) WHEN 'web' THEN 0 WHEN 'app' THEN 1 WHEN 'db' THEN 2 ELSE 3 END, split_part(host_name, '_', 2)::INT) AS r FROM v0)"
_PATTERN_SQL = {
    topo.PATTERNS[0]: _enterprise_sql(_EXEC_ALL, "(SELECT * FROM v0 WHERE host_name <> 'web_0')"),
    topo.PATTERNS[1]: _enterprise_sql(_EXEC_ALL, "(SELECT * FROM v0 WHERE host_name <> 'app_0')"),
    topo.PATTERNS[2]: _enterprise_sql(_EXEC_ALL, fw="SELECT 'web_0' AS source_zone, 'app_0' AS destination_host, 'http' AS service_name, 'deny' AS rule_action"),
    topo.PATTERNS[3]: _enterprise_sql(_EXEC_ALL, f"({_ORDERED} WHERE r > 1)"),
}


def _pattern(spark: SparkSession, d: str, pattern: str) -> DataFrame:
    engine = IncrementalEngine()
    engine.load_snapshot(topo.enterprise(spark))
    engine.apply_updates(topo.enterprise_update(spark, topo.Enterprise(), pattern))
    return engine.current_derived_facts().code_executions


for _p in topo.PATTERNS:
    QUERIES[f"enterprise_{_p}"] = lambda spark, d, p=_p: _pattern(spark, d, p)
    SQL[f"enterprise_{_p}"] = _PATTERN_SQL[_p]

# Text lines of facts, good and bad, one of each kind per nation.
_LINES = "SELECT n_nationkey * 8 + k + 1 AS line_number, CASE k WHEN 0 THEN '  hacl( h' || n_nationkey || ' , web, https ).' WHEN 1 THEN '% note' WHEN 2 THEN 'vulExists(h' || n_nationkey || ', CVE, ssh, root).' WHEN 3 THEN 'hacl(a, b, c)' WHEN 4 THEN 'attackGoal(eve).' WHEN 5 THEN 'attackerLocated(eve, h' || n_nationkey || ', admin).' WHEN 6 THEN 'odd(a).' ELSE 'hacl(a,,c).' END AS line FROM nation CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) t(k)"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.sql(_LINES.replace("FROM nation", "FROM {nation}"), nation=spark.read.parquet(f"{d}/nation.parquet"))
    return parsed(lines.select(F.col("line_number").cast("long").alias("line_number"), "line"))


@query("parsed_facts", "SELECT (n_nationkey * 8 + 1)::BIGINT AS line_number, 'insert' AS op, 'hacl' AS predicate, 'h' || n_nationkey || '|web|https' AS args FROM nation UNION ALL SELECT n_nationkey * 8 + 3, 'insert', 'vulExists', 'h' || n_nationkey || '|CVE|ssh|root' FROM nation")
def parsed_facts(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).filter("error IS NULL").select("line_number", "op", "predicate", F.array_join("args", "|").alias("args"))


@query("parsed_updates", "SELECT n_nationkey::BIGINT AS line_number, CASE WHEN n_nationkey % 2 = 0 THEN 'remove' ELSE 'insert' END AS op, 'hacl' AS predicate, 'h' || n_nationkey || '|web|https' AS args FROM nation")
def parsed_updates(spark: SparkSession, d: str) -> DataFrame:
    """Updates in text form: removals are wrapped, all others insert."""
    fact = "concat('hacl(h', n_nationkey, ', web, https)')"
    lines = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("line_number"), F.expr(f"CASE WHEN n_nationkey % 2 = 0 THEN concat(' remove( ', {fact}, ' ).') ELSE concat({fact}, '.') END").alias("line"))
    return parsed(lines, True).filter("error IS NULL").select("line_number", "op", "predicate", F.array_join("args", "|").alias("args"))


@query("parse_errors", """SELECT (n_nationkey * 8 + k + 1)::BIGINT AS line_number, e AS error FROM nation CROSS JOIN (VALUES (3, 'fact must end with a period'), (4, 'predicate attackGoal expects 2 arguments, found 1'), (5, 'invalid privilege value: admin'), (6, 'unknown predicate: odd'), (7, 'malformed fact: a,,c')) t(k, e)""")
def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).filter("error IS NOT NULL").select("line_number", "error")
