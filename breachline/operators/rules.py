"""The rule program over the base relations: denies, recursion, ownership and goals.

The recursion runs over (attacker, host) pairs only: reaching a host doesn't depend on the privilege
held at the source, and local escalation stays on its host. Privileges follow without recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachline.operators.fixpoint import reach
from breachline.operators.regions import Regions
from breachline.plans.facts import DERIVED, DerivedFacts, FactStore
from breachline.plans.lineage import cut, sent, stored

ROUTE = ["source_host", "destination_host", "service_name"]


def blocked_routes(store: FactStore) -> DataFrame:
    """Distinct routes of deny rules; allow rules block nothing."""
    deny = store.firewall_rules.filter(F.col("rule_action") == "deny")
    return deny.select(F.col("source_zone").alias("source_host"), "destination_host", "service_name").distinct()


def effective_access_bag(store: FactStore) -> DataFrame:
    """Access edges that no deny matches exactly, as often as they were stated."""
    return store.network_access.select(*ROUTE).join(blocked_routes(store), ROUTE, "left_anti")


def effective_access(store: FactStore) -> DataFrame:
    return effective_access_bag(store).distinct()


def initial_exec(store: FactStore) -> DataFrame:
    p = store.attacker_positions
    return p.select("attacker_id", F.col("starting_host").alias("compromised_host"), F.col("initial_privilege").alias("obtained_privilege")).distinct()


def _holes(store: FactStore) -> DataFrame:
    """(destination_host, service_name, privilege) of remote vulnerabilities, whatever their ids."""
    return store.vulnerabilities.select(F.col("host_name").alias("destination_host"), F.col("affected_service").alias("service_name"), "privilege").distinct()


def exploit_edges(store: FactStore, access: DataFrame | None = None) -> DataFrame:
    """(src, dst): hosts between which some open route meets some vulnerability."""
    access = effective_access(store) if access is None else access
    open_ = _holes(store).select("destination_host", "service_name").distinct()
    return access.join(open_, ["destination_host", "service_name"], "left_semi").select(F.col("source_host").alias("src"), F.col("destination_host").alias("dst")).distinct()


def exploit_ways(store: FactStore, access: DataFrame | None = None, named: bool = False) -> DataFrame:
    """(src, dst, privilege): what open routes to vulnerable services give; a way may come once per service.

    With ``named``, also the service and the smallest vulnerability id (cve) there.

    Without access given, only routes to vulnerable services meet the denies, all dealt out by the service.
    """
    hole = ["destination_host", "service_name"]
    holes = _holes(store)
    if named:
        cve = F.min(F.struct(F.col("vulnerability_id").alias("cve"))).alias("x")  # in a struct nulls count, and come first
        holes = store.vulnerabilities.groupBy(F.col("host_name").alias("destination_host"), F.col("affected_service").alias("service_name"), "privilege").agg(cve).select(*hole, "privilege", "x.cve")
    if access is None:
        stated = store.network_access.select(*ROUTE, F.lit(0).alias("denied"))
        denies = store.firewall_rules.filter(F.col("rule_action") == "deny").select(F.col("source_zone").alias("source_host"), "destination_host", "service_name", F.lit(1).alias("denied"))
        # grouping puts nulls together, the rule does not: the join drops nulls at one end, the filter those at the other
        every = stated.unionByName(denies).filter("source_host IS NOT NULL").join(holes.select(*hole).distinct().hint("shuffle_hash"), hole, "left_semi")
        access = every.groupBy(*ROUTE).agg(F.max("denied").alias("denied")).filter("denied = 0")
    return access.join(holes.hint("shuffle_hash"), hole).select(F.col("source_host").alias("src"), F.col("destination_host").alias("dst"), "privilege", *([F.col("service_name").alias("service"), "cve"] if named else []))


def starts(store: FactStore) -> DataFrame:
    return store.attacker_positions.select("attacker_id", F.col("starting_host").alias("host")).distinct()


def reach_hosts(store: FactStore, access: DataFrame | None = None, **options) -> DataFrame:
    """(attacker_id, host, round): hosts each attacker runs code on, with the fewest hops to get there."""
    edges = exploit_ways(store, access).select("src", "dst").distinct()
    return reach(starts(store), edges, **options)


def _positions(store: FactStore) -> DataFrame:
    return store.attacker_positions.select("attacker_id", F.col("starting_host").alias("host"), F.col("initial_privilege").alias("privilege")).distinct()


def _flaws(store: FactStore) -> DataFrame:
    return store.local_vulnerabilities.select(F.col("host_name").alias("host"), "privilege").distinct()


def local_exec(store: FactStore, held: DataFrame) -> DataFrame:
    """What local vulnerabilities give on hosts where some code runs without root."""
    low = held.filter(F.col("obtained_privilege") != "root").select("attacker_id", "compromised_host").distinct()
    local = store.local_vulnerabilities.select(F.col("host_name").alias("compromised_host"), F.col("privilege").alias("obtained_privilege")).distinct()
    return low.join(local, "compromised_host").select(*DERIVED["execCode"])


def exec_code(store: FactStore, local: bool = True, reached: DataFrame | None = None, access: DataFrame | None = None) -> DataFrame:
    """Positions, what vulnerabilities give across open routes from reached hosts, and what local ones add; each once.

    Most hosts give the same privileges whichever way in is taken; for these it is enough that the
    attacker got there, and what local flaws add is known per host. Sources are looked up only for the
    others, and for hosts where attackers start.

    Without hosts reached, all is found region by region, unless a region is too large for a task.
    """
    if reached is None and (state := State.of(store, local=local)) is not None:
        return state.executions()
    access = effective_access(store) if access is None else access
    reached = cut(reach_hosts(store, access)) if reached is None else reached
    steps = access.join(_holes(store), ["destination_host", "service_name"]).select("source_host", F.col("destination_host").alias("compromised_host"), F.col("privilege").alias("obtained_privilege")).distinct()
    steps = cut(steps)
    ways = steps.groupBy("source_host", "compromised_host").agg(F.sort_array(F.collect_set("obtained_privilege")).alias("gives"))  # of three at most
    hosts = ways.groupBy("compromised_host").agg(F.min("gives").alias("gives"), (F.min("gives") == F.max("gives")).alias("even"))
    if local:
        flaws = store.local_vulnerabilities.groupBy(F.col("host_name").alias("compromised_host")).agg(F.collect_set("privilege").alias("adds"))
        low = F.exists("gives", lambda p: p != "root")
        more = F.when(low & F.col("adds").isNotNull(), F.array_union("gives", "adds")).otherwise(F.col("gives"))
        hosts = hosts.join(flaws, "compromised_host", "left").select("compromised_host", more.alias("gives"), "even")
    hosts = cut(hosts)
    pair = ["attacker_id", "compromised_host"]
    begun = starts(store).withColumnRenamed("host", "compromised_host")
    at = reached.select("attacker_id", F.col("host").alias("compromised_host"))
    plain = at.join(sent(hosts.filter("even").drop("even")), "compromised_host").join(sent(begun), pair, "left_anti").select(*pair, F.explode("gives").alias("obtained_privilege"))
    held = reached.select("attacker_id", F.col("host").alias("source_host"))
    back = sent(begun.join(steps, "compromised_host"))
    rest = initial_exec(store).unionByName(held.join(back, ["attacker_id", "source_host"]).select(*DERIVED["execCode"]))
    odd = hosts.filter("NOT even")
    if not odd.isEmpty():
        rest = rest.unionByName(held.join(steps.join(sent(odd), "compromised_host", "left_semi"), "source_host").select(*DERIVED["execCode"]))
    rest = cut(rest.distinct())
    return plain.unionByName(rest.unionByName(local_exec(store, rest)).distinct() if local else rest)


def owns_machine(executions: DataFrame, once: bool = False) -> DataFrame:
    """Hosts with root; ``once`` says that no execution is there twice."""
    root = executions.filter(F.col("obtained_privilege") == "root").select("attacker_id", F.col("compromised_host").alias("owned_host"))
    return root if once else root.distinct()


def goal_reached_bag(store: FactStore, owned: DataFrame) -> DataFrame:
    """Goals on owned machines, as often as they were stated."""
    goals = store.attacker_goals.select("attacker_id", F.col("target_host_name").alias("reached_target"))
    return goals.join(owned.select("attacker_id", F.col("owned_host").alias("reached_target")), ["attacker_id", "reached_target"], "left_semi")


def goal_reached(store: FactStore, owned: DataFrame) -> DataFrame:
    return goal_reached_bag(store, owned).distinct()


class State:
    """A snapshot whose derived relations are found region by region when they are read; none is kept."""

    def __init__(self, store: FactStore, access: DataFrame | None, ways: DataFrame, regions: Regions, local: bool = True):
        self.store, self.access, self.ways, self.regions, self.local = store, access, ways, regions, local

    @staticmethod
    def of(store: FactStore, access: DataFrame | None = None, ways: DataFrame | None = None, local: bool = True) -> State | None:
        """Nothing if a region is too large for a task."""
        ways = stored(exploit_ways(store, access).distinct()) if ways is None else ways
        regions = Regions(ways)
        return State(store, access, ways, regions, local) if regions.fit else None

    def parts(self) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        return self.ways, _flaws(self.store) if self.local else None, _positions(self.store)

    def executions(self) -> DataFrame:
        return self.regions.executions(*self.parts())

    def goals_bag(self) -> DataFrame:
        return self.regions.goals(*self.parts(), _goals(self.store))

    def facts(self) -> DerivedFacts:
        executions = self.executions()
        access = effective_access(self.store) if self.access is None else self.access
        out = DerivedFacts(access, executions, owns_machine(executions, once=True), self.goals_bag().distinct())
        object.__setattr__(out, "state", self)
        return out


class Step:
    """Two snapshots beside each other; regions of both graphs together."""

    def __init__(self, before: State, after: State):
        self.before, self.after = before, after
        self._parts = [_both(old, new) for old, new in zip(before.parts(), after.parts(), strict=True)]
        self._parts[0] = stored(self._parts[0])
        self.regions = Regions(self._parts[0])

    @staticmethod
    def of(before: DerivedFacts | None, after: DerivedFacts) -> Step | None:
        """Nothing if one of the states isn't known by regions, or a region of both is too large."""
        old, new = before and before.state, after.state
        if old is None or new is None or old.local != new.local:
            return None
        step = Step(old, new)
        return step if step.regions.fit else None

    def changes(self) -> DataFrame:
        """Executions that only one state has, with diff."""
        return self.regions.changes(*self._parts)

    def left(self) -> DataFrame:
        return self.regions.left(*self._parts)

    def same_goals(self) -> bool:
        return self.before.store.attacker_goals is self.after.store.attacker_goals

    def goal_changes(self, changes: DataFrame) -> DataFrame:
        """Goals (attacker_id, reached_target, diff) that only one state has."""
        pair = ["attacker_id", "reached_target"]
        if self.same_goals():
            root = changes.filter("obtained_privilege = 'root'").select("attacker_id", F.col("compromised_host").alias("reached_target"), "diff")
            return _goals(self.before.store).withColumnRenamed("host", "reached_target").distinct().join(root, pair).select(*pair, "diff")
        one = [s.goals_bag().distinct().withColumn("diff", F.lit(d)) for s, d in ((self.before, -1), (self.after, 1))]
        return one[0].unionByName(one[1]).groupBy(*pair).agg(F.sum("diff").cast("int").alias("diff")).filter("diff <> 0")

    def access_changes(self) -> DataFrame | None:
        """Effective access that only one state has, with diff; nothing where the table is the same."""
        old, new = self.before.access, self.after.access
        if old is new and old is not None:
            return None
        one = [(effective_access(s.store) if s.access is None else s.access).select(*ROUTE, F.lit(d).alias("diff")) for s, d in ((self.before, -1), (self.after, 1))]
        return one[0].unionByName(one[1]).groupBy(*ROUTE).agg(F.sum("diff").cast("int").alias("diff")).filter("diff <> 0")


def _both(old: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
    """Rows of two tables, once, with the bits of those that have them."""
    if old is None or new is None:
        return None
    every = old.withColumn("world", F.lit(1)).unionByName(new.withColumn("world", F.lit(2)))
    return every.groupBy(*old.columns).agg(F.bit_or("world").alias("world"))


def _goals(store: FactStore) -> DataFrame:
    return store.attacker_goals.select("attacker_id", F.col("target_host_name").alias("host"))


def goals_bag(store: FactStore) -> DataFrame:
    """Goals reached from a snapshot, as often as they were stated."""
    state = State.of(store)
    return goal_reached_bag(store, owns_machine(exec_code(store))) if state is None else state.goals_bag()


def evaluate(store: FactStore, local: bool = True, **options) -> DerivedFacts:
    """All derived relations of a snapshot; with small_edges 0 by rounds, else each region by region when it is read."""
    state = State.of(store, local=local) if options.get("small_edges", 1) else None
    if state is not None:
        return state.facts()
    access = cut(effective_access(store))
    executions = exec_code(store, local, cut(reach_hosts(store, access, **options)), access)
    owned = owns_machine(executions, once=True)
    return DerivedFacts(access, executions, owned, goal_reached(store, owned))


def evaluate_hops(store: FactStore, hops: int) -> DerivedFacts:
    """Executions after at most ``hops`` steps over stated access; denies and local flaws don't count here.

    With no hop, positions are returned as they were stated, repeats included. One lazy plan.
    """
    p = store.attacker_positions
    held = p.select("attacker_id", F.col("starting_host").alias("compromised_host"), F.col("initial_privilege").alias("obtained_privilege"))
    access = store.network_access.select(*ROUTE).distinct()
    steps = access.join(_holes(store), ["destination_host", "service_name"]).select("source_host", F.col("destination_host").alias("to"), "privilege").distinct()
    for _ in range(hops):
        at = held.select("attacker_id", F.col("compromised_host").alias("source_host")).distinct()
        new = at.join(steps, "source_host").select("attacker_id", F.col("to").alias("compromised_host"), F.col("privilege").alias("obtained_privilege"))
        held = held.unionByName(new).distinct()
    owned = owns_machine(held)
    return DerivedFacts(access, held, owned, goal_reached_bag(store, owned))


def demo_owned(store: FactStore) -> DataFrame:
    """The short demonstration's ownership: a reached host with root flaws, once per flaw, whatever the service."""
    roots = store.vulnerabilities.filter(F.col("privilege") == "root").select(F.col("host_name").alias("host"))
    return reach_hosts(store).select("attacker_id", "host").join(roots, "host").select("attacker_id", F.col("host").alias("owned_host"))


def goal_relevant_edges(store: FactStore) -> DataFrame:
    """Exploit edges that can lie on a way to some goal: those into hosts from which a goal can be reached."""
    edges = exploit_edges(store)
    goals = store.attacker_goals.select(F.lit("*").alias("attacker_id"), F.col("target_host_name").alias("host")).distinct()
    back = reach(goals, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.join(back.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
