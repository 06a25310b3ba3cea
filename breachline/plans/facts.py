"""The base and derived relations, their schemas, and stores of them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIVILEGES = ("none", "user", "root")

#: Columns of the base relations by predicate; all are strings. firewall_rule's action is not part of its text form.
BASE = {
    "vulExists": ("host_name", "vulnerability_id", "affected_service", "privilege"),
    "localVulExists": ("host_name", "vulnerability_id", "privilege"),
    "hacl": ("source_host", "destination_host", "service_name"),
    "firewallDeny": ("source_zone", "destination_host", "service_name", "rule_action"),
    "attackerLocated": ("attacker_id", "starting_host", "initial_privilege"),
    "attackGoal": ("attacker_id", "target_host_name"),
}
DERIVED = {
    "effectiveAccess": ("source_host", "destination_host", "service_name"),
    "execCode": ("attacker_id", "compromised_host", "obtained_privilege"),
    "ownsMachine": ("attacker_id", "owned_host"),
    "goalReached": ("attacker_id", "reached_target"),
}
#: Store field of each predicate.
FIELD = {
    "vulExists": "vulnerabilities",
    "localVulExists": "local_vulnerabilities",
    "hacl": "network_access",
    "firewallDeny": "firewall_rules",
    "attackerLocated": "attacker_positions",
    "attackGoal": "attacker_goals",
}
DERIVED_FIELD = {"effectiveAccess": "effective_network_access", "execCode": "code_executions", "ownsMachine": "machines_owned", "goalReached": "goals_reached"}


def schema(predicate: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), False) for c in (BASE | DERIVED)[predicate]])


def priv_rank(privilege: Column) -> Column:
    """none < user < root."""
    return F.when(privilege == "none", 0).when(privilege == "user", 1).otherwise(2)


@dataclass(frozen=True)
class FactStore:
    """The six base relations. They are bags: a row may occur several times."""

    vulnerabilities: DataFrame
    local_vulnerabilities: DataFrame
    network_access: DataFrame
    firewall_rules: DataFrame
    attacker_positions: DataFrame
    attacker_goals: DataFrame

    @staticmethod
    def of(spark: SparkSession, rows: Mapping[str, Iterable[tuple[str, ...]]]) -> FactStore:
        """A store of rows by predicate; missing predicates are empty. Deny rules may omit their action."""

        def frame(predicate: str) -> DataFrame:
            own = [(*r, "deny") if predicate == "firewallDeny" and len(r) == 3 else tuple(r) for r in rows.get(predicate, ())]
            return spark.createDataFrame(own, schema(predicate))

        return FactStore(**{f: frame(p) for p, f in FIELD.items()})

    @staticmethod
    def read(spark: SparkSession, folder: str) -> FactStore:
        return FactStore(**{f: spark.read.parquet(f"{folder}/{f}") for f in FIELD.values()})

    def write(self, folder: str) -> None:
        for f in FIELD.values():
            getattr(self, f).write.mode("overwrite").parquet(f"{folder}/{f}")

    def relation(self, predicate: str) -> DataFrame:
        return getattr(self, FIELD[predicate])

    def with_relation(self, predicate: str, df: DataFrame) -> FactStore:
        return replace(self, **{FIELD[predicate]: df})

    def tagged(self) -> DataFrame:
        """All base facts as (predicate, args): four arguments at most, the action of firewall rules included."""
        return _union([tagged(self.relation(p), p, c) for p, c in BASE.items()])


@dataclass(frozen=True)
class DerivedFacts:
    """The four derived relations, as sets."""

    #: Where they are found region by region, the rules' State; not a field.
    state = None

    effective_network_access: DataFrame
    code_executions: DataFrame
    machines_owned: DataFrame
    goals_reached: DataFrame

    def relation(self, predicate: str) -> DataFrame:
        return getattr(self, DERIVED_FIELD[predicate])

    def tagged(self) -> DataFrame:
        return _union([tagged(self.relation(p), p, c) for p, c in DERIVED.items()])

    def counts(self) -> dict[str, int]:
        return {f.name: getattr(self, f.name).count() for f in fields(self)}


def tagged(df: DataFrame, predicate: str, columns: tuple[str, ...], *more: Column) -> DataFrame:
    return df.select(F.lit(predicate).alias("predicate"), F.array(*columns).alias("args"), *more)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fact_text(predicate: Column, args: Column) -> Column:
    """predicate(a, b, c); a firewall rule shows its first three arguments."""
    shown = F.when(predicate == "firewallDeny", F.slice(args, 1, 3)).otherwise(args)
    return F.concat(predicate, F.lit("("), F.array_join(shown, ", "), F.lit(")"))
