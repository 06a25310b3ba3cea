"""Why a fact holds: one proof step per derived fact for all facts at once, and trees of them.

Every execution has a rank, from the round in which its host was reached. A proof only rests on
executions of smaller rank, so steps never go in circles and every derived fact has a tree.
Preference is as for a reader: the attacker's start, then a local flaw, then a way over the network;
within these the smallest vulnerability id, service, source and privilege.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachline.operators import rules
from breachline.operators.regions import Regions
from breachline.plans.facts import DERIVED, FactStore, priv_rank
from breachline.plans.lineage import cut, stored

# Rule names as shown in proofs.
START = "initial_exec_code_from_attacker_location"
LOCAL = "exec_code_from_local_privilege_escalation"
REMOTE = "exec_code_from_network_reachability_and_vulnerability"
OWNS = "ownership_from_root_exec_code"
GOAL = "goal_reached_from_goal_and_ownership"
ACCESS = "effective_access_from_hacl_without_firewall_deny"

EXEC = list(DERIVED["execCode"])


def ranked_exec(store: FactStore, access: DataFrame, reached: DataFrame) -> DataFrame:
    """Executions with their rank: 0 at the start, 2 (r + 1) from a host reached in round r, one more by a local flaw."""
    starts = rules.initial_exec(store).withColumn("rank", F.lit(0).cast("long"))
    steps = access.join(rules._holes(store), ["destination_host", "service_name"]).select("source_host", F.col("destination_host").alias("compromised_host"), F.col("privilege").alias("obtained_privilege")).distinct()
    at = reached.select("attacker_id", F.col("host").alias("source_host"), "round")
    remote = at.join(steps, "source_host").select(*EXEC, (2 * (F.col("round") + 1)).alias("rank"))
    held = starts.unionByName(remote).groupBy(*EXEC).agg(F.min("rank").alias("rank"))
    flaws = store.local_vulnerabilities.select(F.col("host_name").alias("compromised_host"), F.col("privilege").alias("gives")).distinct()
    gates = held.filter("obtained_privilege <> 'root'").join(flaws, "compromised_host").filter("gives <> obtained_privilege")
    local = gates.select("attacker_id", "compromised_host", F.col("gives").alias("obtained_privilege"), (F.col("rank") + 1).alias("rank"))
    return held.unionByName(local).groupBy(*EXEC).agg(F.min("rank").alias("rank"))


def exec_steps(store: FactStore, access: DataFrame, reached: DataFrame) -> DataFrame:
    """attacker_id, compromised_host, obtained_privilege, kind (0 start, 1 local, 2 remote), cve, service, source, priv (of the premise).

    By joins of all executions, for regions too large for a task.
    """
    facts = cut(ranked_exec(store, access, reached))
    no = F.lit("")
    starts = rules.initial_exec(store).select(*EXEC, F.lit(0).alias("kind"), no.alias("cve"), no.alias("service"), no.alias("source"), F.lit(0).alias("order"), no.alias("priv"))
    gate = facts.filter("obtained_privilege <> 'root'").select("attacker_id", "compromised_host", F.col("obtained_privilege").alias("priv"), F.col("rank").alias("r"))
    flaws = store.local_vulnerabilities.select(F.col("host_name").alias("compromised_host"), F.col("privilege").alias("obtained_privilege"), F.col("vulnerability_id").alias("cve")).distinct()
    local = facts.join(flaws, ["compromised_host", "obtained_privilege"]).join(gate, ["attacker_id", "compromised_host"]).filter("priv <> obtained_privilege AND r < rank")
    local = local.select(*EXEC, F.lit(1).alias("kind"), "cve", no.alias("service"), F.col("compromised_host").alias("source"), priv_rank(F.col("priv")).alias("order"), "priv")
    holes = store.vulnerabilities.select(F.col("host_name").alias("compromised_host"), F.col("privilege").alias("obtained_privilege"), F.col("vulnerability_id").alias("cve"), F.col("affected_service").alias("service")).distinct()
    ways = holes.join(access.select(F.col("source_host").alias("source"), F.col("destination_host").alias("compromised_host"), F.col("service_name").alias("service")), ["compromised_host", "service"])
    at = facts.select("attacker_id", F.col("compromised_host").alias("source"), F.col("obtained_privilege").alias("priv"), F.col("rank").alias("r"))
    remote = ways.join(at, "source").join(facts, EXEC).filter("r < rank")
    remote = remote.select(*EXEC, F.lit(2).alias("kind"), "cve", "service", "source", priv_rank(F.col("priv")).alias("order"), "priv")
    every = starts.unionByName(local).unionByName(remote)
    best = every.groupBy(*EXEC).agg(F.min(F.struct("kind", "cve", "service", "source", "order", "priv")).alias("x"))
    return best.select(*EXEC, "x.kind", "x.cve", "x.service", "x.source", "x.priv")


def _state(store: FactStore) -> rules.State | None:
    """The snapshot by regions, each way with the vulnerability and service that proofs prefer: of one source, no other is ever chosen."""
    ways = rules.exploit_ways(store, named=True).groupBy("src", "dst", "privilege").agg(F.min(F.struct("cve", "service")).alias("x"))
    ways = stored(ways.select("src", "dst", "privilege", "x.cve", "x.service"))
    regions = Regions(ways)
    return rules.State(store, None, ways, regions) if regions.fit else None


def _region_steps(state: rules.State) -> DataFrame:
    """The columns of exec_steps, region by region: neither pairs nor steps are kept."""
    cve = F.min(F.struct(F.col("vulnerability_id").alias("cve"))).alias("x")
    flaws = state.store.local_vulnerabilities.groupBy(F.col("host_name").alias("host"), "privilege").agg(cve).select("host", "privilege", "x.cve")
    return state.regions.steps(state.ways, flaws, state.parts()[2])


def proof_edges(store: FactStore, only: Collection[str] | None = None, **options) -> DataFrame:
    """(predicate, args, rule, place, premise, premise_args): the premises of every derived fact, in order.

    ``only`` names the predicates that are wanted; what others need is not worked out. With small_edges 0,
    or where a region is too large for a task, executions are found by rounds and joined with all ways.
    """
    only = set(DERIVED if only is None else only)
    access = rules.effective_access(store)
    steps = owned = goals = None
    state = _state(store) if "execCode" in only and options.get("small_edges", 1) else None
    if state is not None:
        steps = _region_steps(state)
        facts = state.facts()
        owned, goals = facts.machines_owned, facts.goals_reached
    elif "execCode" in only:
        access = cut(access)
        steps = cut(exec_steps(store, access, cut(rules.reach_hosts(store, **options))))
        owned = rules.owns_machine(steps.select(*EXEC))
        goals = rules.goal_reached(store, owned)
    elif only & {"ownsMachine", "goalReached"}:
        facts = rules.evaluate(store, **options)
        owned, goals = facts.machines_owned, facts.goals_reached
    fact = lambda p, *cols: F.struct(F.lit(p).alias("premise"), F.array(*[F.col(c) if isinstance(c, str) else c for c in cols]).alias("premise_args"))

    def edges(df: DataFrame, predicate: str, columns: tuple[str, ...], rule, premises) -> DataFrame:
        rows = df.select(F.lit(predicate).alias("predicate"), F.array(*columns).alias("args"), rule.alias("rule"), F.posexplode(premises).alias("place", "x"))
        return rows.select("predicate", "args", "rule", F.col("place").cast("long").alias("place"), "x.premise", "x.premise_args")

    a, h, p = EXEC
    found = []
    if "execCode" in only:
        kind = lambda *x: F.when(F.col("kind") == 0, x[0]).when(F.col("kind") == 1, x[1]).otherwise(x[2])
        by_start = F.array(fact("attackerLocated", a, h, p))
        by_flaw = F.array(fact("execCode", a, h, "priv"), fact("localVulExists", h, "cve", p))
        by_way = F.array(fact("execCode", a, "source", "priv"), fact("effectiveAccess", "source", h, "service"), fact("vulExists", h, "cve", "service", p))
        # in one pass: steps by regions are not kept
        found.append(edges(steps, "execCode", tuple(EXEC), kind(F.lit(START), F.lit(LOCAL), F.lit(REMOTE)), kind(by_start, by_flaw, by_way)))
    if "ownsMachine" in only:
        found.append(edges(owned, "ownsMachine", DERIVED["ownsMachine"], F.lit(OWNS), F.array(fact("execCode", "attacker_id", "owned_host", F.lit("root")))))
    if "goalReached" in only:
        found.append(edges(goals, "goalReached", DERIVED["goalReached"], F.lit(GOAL), F.array(fact("attackGoal", *DERIVED["goalReached"]), fact("ownsMachine", *DERIVED["goalReached"]))))
    if "effectiveAccess" in only:
        found.append(edges(access, "effectiveAccess", DERIVED["effectiveAccess"], F.lit(ACCESS), F.array(fact("hacl", *DERIVED["effectiveAccess"]))))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@dataclass(frozen=True)
class Tree:
    """A fact, the rule that gives it (none for base facts) and the trees of its premises."""

    predicate: str
    args: tuple[str, ...]
    rule: str | None = None
    children: tuple[Tree, ...] = ()

    def __str__(self) -> str:
        return f"{self.predicate}({', '.join(self.args[:3] if self.predicate == 'firewallDeny' else self.args)})"

    def lines(self) -> Iterator[str]:
        yield str(self)
        for k, child in enumerate(self.children):
            last = k == len(self.children) - 1
            for n, line in enumerate(child.lines()):
                lead = ("└── " if last else "├── ") if n == 0 else ("    " if last else "│   ")
                yield lead + line

    def pretty(self) -> str:
        return "".join(f"{line}\n" for line in self.lines())


class Explainer:
    """Trees for facts of one state. Only the rows of a proof come to the driver, level by level."""

    def __init__(self, store: FactStore, **options):
        self.store = store
        self.edges = cut(proof_edges(store, **options))

    def explain(self, predicate: str, args: tuple[str, ...]) -> Tree | None:
        """The proof of a derived fact, the leaf of a base fact, or nothing if the fact doesn't hold."""
        args = tuple(args)
        if predicate not in DERIVED:
            shown = F.slice("args", 1, len(args))
            found = self.store.tagged().filter((F.col("predicate") == predicate) & (shown == F.array(*map(F.lit, args))))
            return None if found.isEmpty() else Tree(predicate, args)
        steps: dict[tuple, list] = {}
        level = {(predicate, args)}
        while level:
            wanted = self.edges.sparkSession.createDataFrame([(p, list(a)) for p, a in sorted(level)], "predicate string, args array<string>")
            for r in self.edges.join(F.broadcast(wanted), ["predicate", "args"]).collect():
                steps.setdefault((r.predicate, tuple(r.args)), []).append((r.place, r.rule, r.premise, tuple(r.premise_args)))
            premises = {(p, a) for key in level for _, _, p, a in steps.get(key, ()) if p in DERIVED}
            level = premises - steps.keys()

        def tree(p: str, a: tuple[str, ...]) -> Tree:
            own = sorted(steps.get((p, a), ()))
            return Tree(p, a, own[0][1] if own else None, tuple(tree(q, b) for _, _, q, b in own))

        return tree(predicate, args) if (predicate, args) in steps else None
