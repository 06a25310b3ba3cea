"""Base relations as views over business tables: hosts are parts, routes are line items, attackers are customers.

Every row of a table takes part. Each line item is a route and a firewall rule, and its supplier says
whether the rule denies; each customer is an attacker with a goal per nation. The network is made of
segments of 200 hosts, in each of which routes lead one to eight hosts on around a ring. So ways are
long, and the pairs of attackers and hosts grow with the tables, not with the square of them.

The statements run unchanged on Spark and on DuckDB, so the same text serves queries and oracles.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from breachline.plans.facts import FIELD, FactStore

_HOST = "'host_' || (l_partkey - l_partkey % 200 + (l_partkey % 200 + 1 + l_orderkey % 8) % 200)"
_SERVICE = "CASE l_returnflag WHEN 'A' THEN 'ssh' WHEN 'N' THEN 'http' ELSE 'smb' END"
_NEEDS = "CASE p_size % 3 WHEN 0 THEN 'ssh' WHEN 1 THEN 'http' ELSE 'smb' END"
_GIVES = "CASE WHEN p_size % 5 = 0 THEN 'none' WHEN p_size % 5 <= 2 THEN 'user' ELSE 'root' END"
_GOAL = "'host_' || ((c_custkey + n_nationkey * 7) % (SELECT count(*) FROM part))"

VIEWS = {
    "hacl": f"SELECT 'host_' || l_partkey AS source_host, {_HOST} AS destination_host, {_SERVICE} AS service_name FROM lineitem",
    "firewallDeny": f"SELECT 'host_' || l_partkey AS source_zone, {_HOST} AS destination_host, {_SERVICE} AS service_name, CASE WHEN l_suppkey % 7 = 0 THEN 'deny' ELSE 'allow' END AS rule_action FROM lineitem",
    "vulExists": f"SELECT 'host_' || p_partkey AS host_name, 'CVE-A-' || p_partkey AS vulnerability_id, {_NEEDS} AS affected_service, {_GIVES} AS privilege FROM part UNION ALL SELECT 'host_' || p_partkey, 'CVE-B-' || p_partkey, {_NEEDS}, {_GIVES} FROM part WHERE p_partkey % 10 = 0",
    "localVulExists": "SELECT 'host_' || p_partkey AS host_name, 'CVE-L-' || p_partkey AS vulnerability_id, CASE WHEN p_size % 7 = 0 THEN 'root' ELSE 'user' END AS privilege FROM part WHERE p_size % 7 = 0 OR p_size % 11 = 0",
    "attackerLocated": "SELECT 'attacker_' || c_custkey AS attacker_id, 'host_' || c_custkey AS starting_host, CASE WHEN c_custkey % 100 = 0 THEN 'user' ELSE 'root' END AS initial_privilege FROM customer",
    "attackGoal": f"SELECT 'attacker_' || c_custkey AS attacker_id, {_GOAL} AS target_host_name FROM customer CROSS JOIN nation",
}
_TABLES = ("lineitem", "part", "customer", "nation")


def table_store(spark: SparkSession, sf_dir: str) -> FactStore:
    """The base relations over the tables in sf_dir."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    views = {}
    for predicate, text in VIEWS.items():
        used = {t: f for t, f in frames.items() if t in text}
        shown = text
        for t in used:
            shown = shown.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        views[FIELD[predicate]] = spark.sql(shown, **used)
    return FactStore(**views)
