"""Cutting lineage between the rounds of a loop, and sending small tables to all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows (of a few names each) are sent to all executors.
SENT_ROWS = 200_000


def checkpoint_ready(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir. Where it is unset, a fresh folder in local mode (tests), an error else."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="breachline-"))


_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that it survives lost executors.

    A checkpoint also keeps what the optimiser knows of the rows, which it can't work out for every
    union (it fails on a column it has dropped); nothing here needs that, so it is left out.
    """
    spark = df.sparkSession
    checkpoint_ready(spark)
    before = spark.conf.get(_CONSTRAINTS)
    spark.conf.set(_CONSTRAINTS, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_CONSTRAINTS, before)


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df, marked for broadcast when it has at most so many rows (counted)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared checkpoint folder: a small part of a checkpoint's size where names repeat.

    The files stay until the run's folder is deleted.
    """
    spark = df.sparkSession
    checkpoint_ready(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
