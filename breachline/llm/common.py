"""Shared helpers of the training-data operators: table access, lineage cuts, text expressions."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word contract: space, and \t \n \v \f \r.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh folder in local mode (tests), an error else."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _local_dirs.get(context.applicationId) or _local_dirs.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='breachline-')}")
    return found.rstrip("/")


def ship_code(spark: SparkSession) -> None:
    """Send the package to Python workers that could not import it otherwise."""
    root = Path(__file__).resolve().parents[2]
    reach = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p, "breachline", "llm").is_dir() for p in reach) or spark.conf.get("spark.breachline.shipped", "") == "yes":
        return
    folder = tempfile.mkdtemp(prefix="breachline-code-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/breachline", "zip", root, "breachline"))
    spark.conf.set("spark.breachline.shipped", "yes")


#: Rows of an Arrow batch while a table is written: texts are long, and two workers share an executor's memory.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The file names are unique, so that a rerun never reads an earlier run's table. The session's
    setting for Arrow batches is put back after the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, ARROW_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, before)
    return spark.read.schema(df.schema).parquet(path)


def without_blanks(text: Column) -> Column:
    """text less every character of [\\x20\\x09-\\x0D]; byte-level replaces, no regular expression."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of text, in order."""
    return F.filter(F.split(text, f"{BLANK_CLASS}+"), lambda w: w != "")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """df, marked for broadcast when it has at most ``rows`` rows (counted); df must be materialised.

    With ``weight``, what each row counts for: the length of an array in it, say.
    """
    if weight is not None:
        return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= rows else df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed_join(rows: DataFrame, table: DataFrame, key: str, often: str, small: int, most: int = 50_000) -> DataFrame:
    """rows joined with a materialised table that is unique by key; ``often`` says how many rows a key meets.

    A small table is broadcast. Else its keys of more than ``most`` rows are (there are few), so that
    no key brings more than that to one task.
    """
    sent = broadcast_if_small(table, small)
    if sent is not table:
        return rows.join(sent, key)
    heavy = table.filter(F.col(often) > most)
    if heavy.isEmpty():
        return rows.join(table, key)
    heavy = broadcast_if_small(heavy, small)
    light = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(light.join(table.filter(F.col(often) <= most), key))
