"""Synthetic networks and updates to them, as table functions over ranges."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breachline.plans.facts import FactStore

_TEXT = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _store(spark: SparkSession, vulnerabilities: DataFrame, access: DataFrame, position: tuple[str, str, str], goal: tuple[str, str]) -> FactStore:
    empty = FactStore.of(spark, {"attackerLocated": [position], "attackGoal": [goal]})
    return FactStore(vulnerabilities, empty.local_vulnerabilities, access, empty.firewall_rules, empty.attacker_positions, empty.attacker_goals)


def _root_ssh(hosts: DataFrame, host: Column, cve: Column) -> DataFrame:
    return hosts.select(host.alias("host_name"), cve.alias("vulnerability_id"), F.lit("ssh").alias("affected_service"), F.lit("root").alias("privilege"))


def _ssh(df: DataFrame, src: Column, dst: Column) -> DataFrame:
    return df.select(src.alias("source_host"), dst.alias("destination_host"), F.lit("ssh").alias("service_name"))


def chain(spark: SparkSession, n: int) -> FactStore:
    """n hosts in a row, each with a root flaw; the attacker is at the first and wants the last."""
    i = F.col("id")
    vul = _root_ssh(spark.range(n), _TEXT("node_", i), _TEXT("CVE-CHAIN-", i))
    return _store(spark, vul, _ssh(spark.range(n - 1), _TEXT("node_", i), _TEXT("node_", i + 1)), ("attacker", "node_0", "root"), ("attacker", f"node_{n - 1}"))


def star(spark: SparkSession, leaves: int) -> FactStore:
    """A hub and its leaves; the goal is the last leaf."""
    i = F.col("id")
    hub = _root_ssh(spark.range(1), F.lit("hub"), F.lit("CVE-HUB-0"))
    vul = hub.unionByName(_root_ssh(spark.range(leaves), _TEXT("leaf_", i), _TEXT("CVE-LEAF-", i)))
    return _store(spark, vul, _ssh(spark.range(leaves), F.lit("hub"), _TEXT("leaf_", i)), ("attacker", "hub", "root"), ("attacker", f"leaf_{leaves - 1}"))


def mesh(spark: SparkSession, width: int, height: int) -> FactStore:
    """A grid with edges right and down, from one corner to the other."""
    cells = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))
    x, y = F.col("x"), F.col("y")
    at = lambda a, b: _TEXT("node_", a, "_", b)
    vul = _root_ssh(cells, at(x, y), _TEXT("CVE-MESH-", x, "-", y))
    access = _ssh(cells.filter(x < width - 1), at(x, y), at(x + 1, y)).unionByName(_ssh(cells.filter(y < height - 1), at(x, y), at(x, y + 1)))
    return _store(spark, vul, access, ("attacker", "node_0_0", "root"), ("attacker", f"node_{width - 1}_{height - 1}"))


@dataclass(frozen=True)
class Enterprise:
    web: int = 8
    app: int = 6
    db: int = 3
    admin: int = 1
    density: float = 0.75
    web_services: tuple[str, ...] = ("https",)
    app_services: tuple[str, ...] = ("http",)
    db_services: tuple[str, ...] = ("postgres",)
    admin_services: tuple[str, ...] = ("smb",)

    @property
    def nodes(self) -> int:
        return 1 + self.web + self.app + self.db + self.admin

    def layers(self) -> list[tuple[str, int, tuple[str, ...], str]]:
        return [("web", self.web, self.web_services, "user"), ("app", self.app, self.app_services, "user"), ("db", self.db, self.db_services, "user"), ("admin", self.admin, self.admin_services, "root")]


def enterprise_vulnerabilities(spark: SparkSession, config: Enterprise) -> DataFrame:
    """The flaws of all layers and ``ord``, their place in the list."""
    density = min(1.0, max(0.0, config.density))
    out = None
    for k, (label, hosts, services, privilege) in enumerate(config.layers()):
        names = F.array(*map(F.lit, services))
        df = spark.range(hosts).select(F.col("id").alias("h"), F.posexplode(names).alias("s", "affected_service"))
        score = (F.col("h") * 37 + F.col("s") * 17 + 11) % 100 / 100.0
        first = (F.col("h") == 0) & (F.col("s") == 0)
        df = df.filter(F.lit(True) if density >= 1 else first | (score < density) if density > 0 else first)
        df = df.select(_TEXT(f"{label}_", F.col("h")).alias("host_name"), _TEXT(f"CVE-ENTERPRISE-{label.upper()}-", F.col("h"), "-", F.col("s")).alias("vulnerability_id"), "affected_service", F.lit(privilege).alias("privilege"), F.struct(F.lit(k).alias("layer"), "h", "s").alias("ord"))
        out = df if out is None else out.unionByName(df)
    return out


def enterprise_access(spark: SparkSession, config: Enterprise) -> DataFrame:
    """Every host of a layer reaches every host of the next, by each of its services; ``ord`` is the place in the list."""
    out, before = None, spark.range(1).select(F.lit("internet").alias("source_host"), F.col("id").alias("i"))
    for k, (label, hosts, services, _) in enumerate(config.layers()):
        here = spark.range(hosts).select(_TEXT(f"{label}_", F.col("id")).alias("destination_host"), F.col("id").alias("j"))
        df = before.crossJoin(here).select("*", F.posexplode(F.array(*map(F.lit, services))).alias("s", "service_name"))
        df = df.select("source_host", "destination_host", "service_name", F.struct(F.lit(k).alias("layer"), "i", "j", "s").alias("ord"))
        out = df if out is None else out.unionByName(df)
        before = here.select(F.col("destination_host").alias("source_host"), F.col("j").alias("i"))
    return out


def enterprise(spark: SparkSession, config: Enterprise = Enterprise()) -> FactStore:
    return _store(spark, enterprise_vulnerabilities(spark, config).drop("ord"), enterprise_access(spark, config).drop("ord"), ("attacker", "internet", "user"), ("attacker", "admin_0"))


#: Update patterns and how they are labelled.
PATTERNS = ("patch_one_web_vulnerability", "patch_one_app_vulnerability", "add_dmz_to_app_firewall_deny", "batch_patch_10_percent")


def enterprise_update(spark: SparkSession, config: Enterprise, pattern: str) -> DataFrame:
    """The change log (seq, op, predicate, args) of an update pattern."""
    vul = enterprise_vulnerabilities(spark, config)
    if pattern == "add_dmz_to_app_firewall_deny":
        ways = enterprise_access(spark, config).filter(F.col("source_host").startswith("web_") & F.col("destination_host").startswith("app_"))
        first = ways.orderBy("ord").limit(1)
        return first.select(F.lit(1).cast("long").alias("seq"), F.lit("insert").alias("op"), F.lit("firewallDeny").alias("predicate"), F.array("source_host", "destination_host", "service_name", F.lit("deny")).alias("args"))
    if pattern == "batch_patch_10_percent":
        chosen = vul.orderBy("ord").limit(max(1, vul.count() // 10))
    else:
        chosen = vul.filter(F.col("host_name").startswith({PATTERNS[0]: "web_", PATTERNS[1]: "app_"}[pattern])).orderBy("ord").limit(1)
    return chosen.select((F.monotonically_increasing_id() + 1).alias("seq"), F.lit("remove").alias("op"), F.lit("vulExists").alias("predicate"), F.array("host_name", "vulnerability_id", "affected_service", "privilege").alias("args"))


_SERVICES = ("ssh", "http", "https", "postgres", "smb")


def random_rows(seed: int) -> dict[str, list[tuple[str, ...]]]:
    """A random scenario: 3 to 12 hosts, a path through all, more edges, flaws and denies by chance."""
    r = random.Random(seed)
    hosts = [f"host_{i}" for i in range(r.randint(3, 12))]
    privilege = lambda: "user" if r.random() < 0.55 else "root"
    hacl = [(a, b, "https") for a, b in zip(hosts, hosts[1:], strict=False)]
    hacl += [(a, b, r.choice(_SERVICES)) for a in hosts for b in hosts if a != b and r.random() < 0.25]
    vul = [(h, f"CVE-BASE-{h}", "https", privilege()) for h in hosts[1:]]
    vul += [(h, f"CVE-{h}-{s}", s, privilege()) for h in hosts[1:] for s in _SERVICES if r.random() < 0.28]
    local = [(h, f"CVE-LOCAL-{h}", "root") for h in hosts if r.random() < 0.2]
    deny = [(*e, "deny") for e in hacl if r.random() < 0.08]
    return {"vulExists": vul, "localVulExists": local, "hacl": hacl, "firewallDeny": deny, "attackerLocated": [("eve", hosts[0], "user")], "attackGoal": [("eve", hosts[-1])]}


def random_update(rows: dict[str, list[tuple[str, ...]]], r: random.Random) -> tuple[str, str, tuple[str, ...]]:
    """One update to a scenario: a patch, a deny, a new flaw or a new local flaw."""
    kind = r.randrange(4)
    if kind == 0 and rows["vulExists"]:
        return "remove", "vulExists", r.choice(rows["vulExists"])
    if kind == 1 and rows["hacl"]:
        return "insert", "firewallDeny", (*r.choice(rows["hacl"]), "deny")
    host = r.choice(sorted({h for e in rows["hacl"] for h in e[:2]}))
    if kind == 2:
        return "insert", "vulExists", (host, f"CVE-NEW-{r.randrange(10**6)}", r.choice(_SERVICES), r.choice(("user", "root")))
    return "insert", "localVulExists", (host, f"CVE-NEW-LOCAL-{r.randrange(10**6)}", "root")
