"""Comparing derived states: differences, counts of changes, affected hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachline.operators import rules, updates
from breachline.plans.facts import DERIVED, DERIVED_FIELD, DerivedFacts, fact_text

#: Arguments (from 0) that name hosts.
HOSTS = {"effectiveAccess": (0, 1), "execCode": (1,), "ownsMachine": (1,), "goalReached": (1,)}


def changed_facts(before: DerivedFacts, after: DerivedFacts) -> DataFrame:
    """(predicate, args, diff): -1 for facts only before, 1 for facts only after."""
    if (step := rules.Step.of(before, after)) is not None:
        return updates.step_changes(step, list(DERIVED))
    old, new = before.tagged().distinct().withColumn("diff", F.lit(-1)), after.tagged().distinct().withColumn("diff", F.lit(1))
    return old.unionByName(new).groupBy("predicate", "args").agg(F.sum("diff").cast("long").alias("diff")).filter("diff <> 0")


def affected_hosts(before: DerivedFacts, after: DerivedFacts) -> DataFrame:
    """Hosts that some changed fact names; both ends of an access edge."""
    if (step := rules.Step.of(before, after)) is not None:
        # machines and goals change where executions do, unless the goals themselves are others
        own = step.changes().select(F.col("compromised_host").alias("host"))
        if not step.same_goals():
            own = own.unionByName(step.goal_changes(step.changes()).select(F.col("reached_target").alias("host")))
        if (ways := step.access_changes()) is not None:
            own = own.unionByName(ways.select(F.explode(F.array("source_host", "destination_host")).alias("host")))
        return own.distinct()
    changed = changed_facts(before, after)
    at = F.when(F.col("predicate") == "effectiveAccess", F.slice("args", 1, 2)).otherwise(F.slice("args", 2, 1))
    return changed.select(F.explode(at).alias("host")).distinct()


def update_metrics(before: DerivedFacts, after: DerivedFacts) -> DataFrame:
    """One row of symmetric-difference counts; changed_base_facts is 0 and the depth unknown, as nothing here measures them."""
    changed = changed_facts(before, after)
    of = lambda p: F.count(F.when(F.col("predicate") == p, 1)).cast("long")
    counts = changed.agg(
        F.lit(0).cast("long").alias("changed_base_facts"),
        of("execCode").alias("changed_exec_code_facts"),
        of("ownsMachine").alias("changed_ownership_facts"),
        of("goalReached").alias("changed_goal_facts"),
        F.count("*").cast("long").alias("changed_derived_facts"),
        F.lit(None).cast("long").alias("recursive_depth_estimate"),
    )
    return counts.crossJoin(affected_hosts(before, after).agg(F.count("*").cast("long").alias("affected_hosts")))


def difference_sample(left: DerivedFacts, right: DerivedFacts, size: int = 5) -> DataFrame:
    """(relation, side, place, fact): the first few facts, in order, that only one state has."""
    from pyspark.sql import Window

    changed = changed_facts(left, right)
    order = Window.partitionBy("predicate", "diff").orderBy("args")
    ranked = changed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    names = F.create_map(*[F.lit(x) for kv in DERIVED_FIELD.items() for x in kv])
    side = F.when(F.col("diff") < 0, "only_left").otherwise("only_right")
    return ranked.select(F.element_at(names, F.col("predicate")).alias("relation"), side.alias("side"), F.col("place").cast("long").alias("place"), fact_text(F.col("predicate"), F.col("args")).alias("fact"))


def compare(left: DerivedFacts, right: DerivedFacts) -> str:
    """Empty if both states are equal; else a line for each relation that differs."""
    rows = difference_sample(left, right).collect()
    lines = []
    for predicate in DERIVED:
        name = DERIVED_FIELD[predicate]
        own = sorted((r for r in rows if r.relation == name), key=lambda r: r.place)
        if own:
            only = {s: [r.fact for r in own if r.side == s] for s in ("only_left", "only_right")}
            n = [x.relation(predicate).distinct().count() for x in (left, right)]
            lines.append(f"{name} differs: left_count={n[0]}, right_count={n[1]}, only_left=[{'; '.join(only['only_left'])}], only_right=[{'; '.join(only['only_right'])}]")
    return "\n".join(lines)


def derived_count(state: DerivedFacts) -> int:
    """Executions, ownerships and goals; effective access doesn't count."""
    return state.code_executions.count() + state.machines_owned.count() + state.goals_reached.count()


def host_census(store) -> DataFrame:
    """Distinct hosts of access edges, vulnerabilities, positions and goals; firewall rules name none."""
    one = lambda df, c: df.select(F.col(c).alias("host"))
    all_ = one(store.network_access, "source_host")
    for df, c in ((store.network_access, "destination_host"), (store.vulnerabilities, "host_name"), (store.attacker_positions, "starting_host"), (store.attacker_goals, "target_host_name")):
        all_ = all_.unionByName(one(df, c))
    return all_.distinct()
