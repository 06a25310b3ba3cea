"""The registered queries of this subpackage, each one operator over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breachline.llm import chat, exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, suffix_dedup
from breachline.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_mixing says apart from its draws, which SQL can't make."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_pii says of the base kinds, apart from the spans that its estimate adds."""
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents"))).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies over one stored ledger: what each of their rules rejects, alone and with others."""
    return quality_rules.policy_report(table(spark, sf_dir, "documents"))


_OPS = (op1_chat_formatting, op2_exact_dedup, op3_line_dedup, op4_suffix_dedup, op5_quality_classifier, op6_pii, op7_best_fit_packing, op8_minhash_near_dedup, op9_quality_rules, op10_mixing)
QUERIES = {f.__name__: f for f in (*_OPS, mixing_targets, pii_base, quality_ablations)}
ORACLES = {
    "op1_chat_formatting": chat.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_suffix_dedup": suffix_dedup.SQL,
    "op8_minhash_near_dedup": near_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "mixing_targets": mixing.SQL,
    "pii_base": pii.SQL,
    "quality_ablations": quality_rules.REPORT_SQL,
}
