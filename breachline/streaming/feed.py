"""Keeping derived facts current under a stream of change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from breachline.operators.updates import LOG, change_feed
from breachline.plans.engines import Engine
from breachline.plans.facts import DerivedFacts, fact_text
from breachline.plans.lineage import cut


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change-log rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(LOG).parquet(folder)


class ChangeFeed:
    """Applies each micro-batch to an engine and writes what changed.

    The batch id is the logical time. Output goes to ``batch=<id>`` and is overwritten when a batch
    is run again; a batch that the engine has already applied is not applied twice.
    """

    def __init__(self, engine: Engine, out: str):
        self.engine, self.out = engine, out
        self.applied = -1
        self.state = self._state()

    def _state(self) -> DerivedFacts:
        now = self.engine.current_derived_facts()
        return DerivedFacts(*[cut(getattr(now, f)) for f in DerivedFacts.__dataclass_fields__])

    def batch(self, log: DataFrame, batch_id: int) -> None:
        if batch_id > self.applied:
            before = self.state
            self.engine.apply_updates(log)
            self.state, self.applied = self._state(), batch_id
            self._feed = cut(change_feed(before, self.state, batch_id))
        self._feed.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")

    def start(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        return log.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).start()


def shown(feed: DataFrame) -> DataFrame:
    """A feed (time, predicate, args, diff) as lines; the sign says whether a fact came or went."""
    sign = F.when(F.col("diff") > 0, "+").otherwise("-")
    mark = F.when(F.col("predicate") == "goalReached", " (TARGET COMPROMISED)").otherwise("")
    return feed.select(F.concat(F.lit("  [t="), F.col("time"), F.lit("] "), sign, F.lit(" "), fact_text(F.col("predicate"), F.col("args")), mark).alias("line"))
