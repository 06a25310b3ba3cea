"""Change logs over the base relations, and states and change feeds derived from them.

A change log has rows (seq, op, predicate, args), op being insert or remove. Relations are bags: an
insert adds a copy, a remove takes one copy away, and a remove that finds none does nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breachline.operators import rules
from breachline.plans.facts import BASE, DERIVED, DerivedFacts, FactStore, tagged
from breachline.plans.lineage import sent, stored
from breachline.sources.facts_text import store_of

LOG = "seq bigint, op string, predicate string, args array<string>"


def change_log(spark: SparkSession, rows: Iterable[tuple[str, str, tuple[str, ...]]], start: int = 1) -> DataFrame:
    """A log of (op, predicate, args) in order."""
    return spark.createDataFrame([(start + k, op, p, list(a)) for k, (op, p, a) in enumerate(rows)], LOG)


def normalised(log: DataFrame) -> DataFrame:
    """The log with firewall actions spelled out: inserts of a deny are denies whatever they say; removals name their action, deny by default."""
    fire = F.col("predicate") == "firewallDeny"
    route = F.slice("args", 1, 3)
    action = F.when(F.col("op") == "insert", F.lit("deny")).otherwise(F.coalesce(F.get("args", F.lit(3)), F.lit("deny")))
    return log.withColumn("args", F.when(fire, F.concat(route, F.array(action))).otherwise(F.col("args")))


def replayed(base: DataFrame, log: DataFrame) -> DataFrame:
    """(predicate, args, copies): counts (predicate, args, copies) after the log, in order of seq.

    A count that starts at c and takes steps of 1 down to 0 at the least ends at
    c + S - min(0, min over prefixes of (c + S_i)), S being sums of steps; so it needs no loop.
    """
    steps = normalised(log).select("predicate", "args", "seq", F.when(F.col("op") == "insert", 1).otherwise(-1).cast("long").alias("step"))
    held = base.groupBy("predicate", "args").agg(F.sum("copies").cast("long").alias("step")).withColumn("seq", F.lit(None).cast("long"))
    order = Window.partitionBy("predicate", "args").orderBy(F.col("seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    sums = held.unionByName(steps).withColumn("sum", F.sum("step").over(order))
    ends = sums.groupBy("predicate", "args").agg(F.sum("step").alias("total"), F.min("sum").alias("low"))
    return ends.select("predicate", "args", (F.col("total") - F.least(F.lit(0), "low")).cast("long").alias("copies")).filter("copies > 0")


def counted(store: FactStore) -> DataFrame:
    return store.tagged().groupBy("predicate", "args").agg(F.count("*").cast("long").alias("copies"))


def store_from(counts: DataFrame) -> FactStore:
    """The relations of counted facts, each as often as it counts."""
    return store_of(counts.select("predicate", "args", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("predicate", "args"))


def named_facts(log: DataFrame) -> DataFrame:
    """(predicate, args) of the facts that a log inserts or removes."""
    return normalised(log).select("predicate", "args").distinct()


def apply_updates(store: FactStore, log: DataFrame, named: DataFrame | None = None) -> FactStore:
    """The store after a log. Only facts that the log names are counted and replayed; all others stay as they are."""
    named = stored(named_facts(log)) if named is None else named
    kinds = {r.predicate for r in named.select("predicate").distinct().collect()}  # at most six
    gone = {p: sent(named.filter(F.col("predicate") == p).select(*[F.get("args", F.lit(k)).alias(c) for k, c in enumerate(BASE[p])])) for p in kinds}
    held = None
    for p in kinds:
        own = store.relation(p).join(gone[p], list(BASE[p]), "left_semi").groupBy(*BASE[p]).agg(F.count("*").cast("long").alias("copies"))
        own = own.select(F.lit(p).alias("predicate"), F.array(*BASE[p]).alias("args"), "copies")
        held = own if held is None else held.unionByName(own)
    if held is None:
        return store
    fresh = store_from(stored(replayed(held, log)))
    for p in kinds:
        kept = store.relation(p).join(gone[p], list(BASE[p]), "left_anti").select(*BASE[p])
        store = store.with_relation(p, kept.unionByName(fresh.relation(p)))
    return store


def consolidated(feed: DataFrame) -> DataFrame:
    """Signed rows summed per (time, predicate, args); what cancels out is gone."""
    return feed.groupBy("time", "predicate", "args").agg(F.sum("diff").cast("long").alias("diff")).filter("diff <> 0")


def state_as_of(feed: DataFrame, time: Column | int) -> DataFrame:
    """(predicate, args, diff): what a feed (time, predicate, args, diff) adds up to before ``time``."""
    return feed.filter(F.col("time") < time).groupBy("predicate", "args").agg(F.sum("diff").cast("long").alias("diff")).filter("diff <> 0")


def positive(feed: DataFrame) -> DataFrame:
    """The facts that a feed leaves, as a set."""
    return feed.groupBy("predicate", "args").agg(F.sum("diff").alias("diff")).filter("diff > 0").select("predicate", "args")


def change_feed(before: DerivedFacts | None, after: DerivedFacts, time: int, access: bool = False) -> DataFrame:
    """(time, predicate, args, diff) from one state to the next; effective access only if asked for."""
    keep = list(DERIVED) if access else [p for p in DERIVED if p != "effectiveAccess"]
    if (step := rules.Step.of(before, after)) is not None:
        return step_changes(step, keep).select(F.lit(time).cast("long").alias("time"), "predicate", "args", "diff")
    new = after.tagged().filter(F.col("predicate").isin(keep)).withColumn("diff", F.lit(1))
    if before is not None:
        new = new.unionByName(before.tagged().filter(F.col("predicate").isin(keep)).withColumn("diff", F.lit(-1)))
    return consolidated(new.withColumn("time", F.lit(time).cast("long")))


def step_changes(step: rules.Step, keep: list[str]) -> DataFrame:
    """(predicate, args, diff) of the predicates to keep between two states that are known by regions."""
    changes = stored(step.changes())
    root = changes.filter("obtained_privilege = 'root'").select("attacker_id", F.col("compromised_host").alias("owned_host"), "diff")
    found = {"execCode": changes, "ownsMachine": root, "goalReached": step.goal_changes(changes)}
    if "effectiveAccess" in keep and (ways := step.access_changes()) is not None:
        found["effectiveAccess"] = ways
    out = None
    for p in keep:
        if p in found:
            own = tagged(found[p], p, DERIVED[p], F.col("diff").cast("long").alias("diff"))
            out = own if out is None else out.unionByName(own)
    return out


def left(before: DerivedFacts, after: DerivedFacts) -> DataFrame:
    """(predicate, args) that the feeds of a first state and of the step to a second leave, effective access apart."""
    if (step := rules.Step.of(before, after)) is None:
        return positive(change_feed(None, before, 0).unionByName(change_feed(before, after, 1)))
    executions = step.left()
    goal = lambda df: tagged(df, "goalReached", DERIVED["goalReached"], F.col("diff"))
    goals = goal(before.goals_reached.withColumn("diff", F.lit(1))).unionByName(goal(step.goal_changes(step.changes())))
    own = tagged(rules.owns_machine(executions, once=True), "ownsMachine", DERIVED["ownsMachine"])
    return tagged(executions, "execCode", DERIVED["execCode"]).unionByName(own).unionByName(positive(goals))
