"""Exact dedup as a tree merge of sorted digest runs, in DataFrame operations only.

The documents of each input partition are a run of digests. In binomial rounds ``fan_in`` runs at a
time, those whose numbers differ in one digit, are exchanged and merged: round k leaves one run for
every ``fan_in ** k`` partitions, cut into as many ranges of digests, so the number of tasks stays the
same and no task holds a whole run. A slot (run, range) is brought to one task and sorted; equal
digests are neighbours then, and a sort aggregate retains the best row of each, verified against a
second hash and the normalised length. A digest that a third of all rows share is spread over the
runs in the first round and is one row a run from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachline.llm.common import keyed_join, materialise, shuffle_parts, without_blanks

FAN_IN = 4
#: Tables of groups of at most this many rows are broadcast to the members, larger ones shuffled.
SMALL_ROWS = 200_000
KEY = ("digest", "check", "n_norm")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: SHA-256 of the normalised text, a second hash, and lengths. Null text is empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.col("_norm")
    return docs.select(F.col(id_col).alias("doc_id"), without_blanks(text).alias("_norm"), F.length(text).cast("long").alias("n_chars_text")).select(
        "doc_id",
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("check"),
        F.length(norm).cast("long").alias("n_norm"),
        "n_chars_text",
    )


def rounds_for(runs: int, fan_in: int = FAN_IN) -> int:
    """Rounds until so many runs are one."""
    k = 1
    while fan_in**k < runs:
        k += 1
    return k


def first_runs(members: DataFrame, rounds: int, fan_in: int = FAN_IN) -> DataFrame:
    """Rows (run, digest, check, n_norm, best, group_size): the rows of a partition are a run, each a group of its own.

    Of equal digests the smallest ``best`` stays: most code points, then the smallest id, null last.
    """
    best = F.struct((-F.col("n_chars_text")).alias("n"), F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"))
    run = (F.spark_partition_id() % fan_in**rounds).cast("int")
    return members.select(run.alias("run"), *KEY, best.alias("best"), F.lit(1).cast("long").alias("group_size"))


def merge_round(runs: DataFrame, k: int, rounds: int, fan_in: int = FAN_IN) -> DataFrame:
    """Round k (from 1): ``fan_in`` runs at a time become one, sorted by digest within ``fan_in ** k`` ranges of digests."""
    ranges = fan_in**k
    top = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    slot = (F.floor(F.col("run") / fan_in) * ranges + F.floor(top * ranges / (1 << 32))).cast("int")
    met = runs.withColumn("slot", slot).drop("run").repartitionById(fan_in**rounds, "slot").sortWithinPartitions("slot", *KEY)
    merged = met.groupBy("slot", *KEY).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return merged.select(F.floor(F.col("slot") / ranges).cast("int").alias("run"), *KEY, "best", "group_size")


def merge_runs(members: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, check, n_norm) -> keep_id, group_size, after as many rounds as the session's shuffle partitions need."""
    rounds = rounds_for(shuffle_parts(members.sparkSession), fan_in)
    runs = first_runs(members, rounds, fan_in)
    for k in range(1, rounds + 1):
        runs = merge_round(runs, k, rounds, fan_in)
    return runs.select(*KEY, F.col("best.id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting blanks; of equal texts the one with the most code
    points stays, then the smallest id (of any ordered type). Null text equals empty text, and
    all-blank texts equal it too. Rows repeated with one id count in group_size, and each is returned.
    A null id sorts last and stays only where nothing else can. An empty table gives an empty result;
    other columns of docs are ignored, whatever their names.
    """
    members = materialise(digests(docs, id_col, text_col), "digests")
    groups = materialise(merge_runs(members, fan_in), "digest-groups")
    # digest, check and length are one key here: groups of copies of any size are joined without meeting in one task
    keyed = lambda df: df.withColumn("key", F.struct(*KEY)).drop(*KEY)
    return keyed_join(keyed(members.drop("n_chars_text")), keyed(groups), "key", "group_size", SMALL_ROWS).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key.digest")).alias("text_sha256"),
    )


SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM n GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
