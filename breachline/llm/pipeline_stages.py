"""The stages of the corpus pipeline, each one operator whose decisions take effect.

Empty tables go through all stages. Columns besides doc_id, text, source and n_chars are carried
along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breachline.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from breachline.llm.common import broadcast_if_small, materialise

#: Decisions of at most this many rows are broadcast to the documents, larger ones shuffled.
SMALL_ROWS = 500_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps.

    Null or empty texts are rejected (too few words). Rows are judged one by one, whatever their ids.
    """
    return quality_rules.kept_rows(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their recurring lines; those that lose all their words go. n_chars follows the text.

    Null texts and rows with a null id stay as they are; rows that repeat an id each lose their own lines.
    """
    cut = line_dedup.line_dedup(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text")))
    changed = F.col("n_dropped") > 0
    columns = []
    for c in docs.columns:
        was = F.col("row")[c]
        if c == "n_chars":
            was = F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(was)
        columns.append((F.col("text") if c == "text" else was).alias(c))
    return cut.filter(~changed | (F.col("text") != "")).select(*columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by five-word shingles at a similarity of 0.8.

    Rows with a null id stay. Rows that repeat an id are compared like any others: the text with the
    smallest hash goes by the id, its other texts by a hash of their own; of rows with one id and text
    the first by a hash of all columns stays. Texts without words stay.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("hash"))
    again = rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("hash").alias("least")).filter("n > 1")
    again = broadcast_if_small(materialise(again.select("id", "least"), "near-repeated"), SMALL_ROWS)
    own = F.xxhash64("id", "text").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)  # after other ids
    keyed = rows.join(again, "id", "left").withColumn("key", F.when(F.col("hash") != F.col("least"), own).otherwise(F.col("id")))
    found = near_dedup.near_dedup(keyed.select("key", "text"), k=5, percent=80, id_col="key")
    gone = materialise(found.filter(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct(), "near-gone")
    kept = keyed.join(broadcast_if_small(gone, SMALL_ROWS), "key", "left_anti")
    copy = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    once = kept.filter("least IS NOT NULL").withColumn("copy", copy).filter("copy = 1")
    return kept.filter("least IS NULL").select("row").unionByName(once.select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole; every row has a decision of its own.

    Texts without words are taken zero times. Null ids and sources count like any others.
    """
    return mixing.taken_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null texts are the end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
