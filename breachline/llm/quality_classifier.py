"""A quality classifier from weak labels.

Heuristic labelers vote bad or abstain on every document, each defect being seen by several of them.
Expectation-maximisation over the counts of vote patterns (at most two to the power of the labelers)
estimates the share of good documents and how often each labeler fires on good and on bad ones; the
posteriors of a bounded sample of documents train a linear scorer over hashed byte trigrams, which
scores every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachline.llm import bytescan
from breachline.llm.common import BLANK_CLASS, BLANKS, WORD_REGEX, materialise, ship_code

DIM = 1 << 12
#: Training takes at most this many documents, those with the smallest hash of (id, text, seed); the driver gets WIDTH numbers of each.
SAMPLE = 2000
_EDGE = np.uint32(0x01000193)
SYMBOLS = r"[#*$%&|<>{}\\~^=]"
LABELERS = ("hardly_a_word", "symbols", "symbols_at_ends", "long_words", "capitals", "exclamations", "stutter", "few_distinct_words", "odd_sentences")


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (of the text) and votes: bit k set where labeler k says bad."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"{BLANK_CLASS}+"), lambda x: x != "")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"), words.alias("words"))
    t, w = F.col("text"), F.col("w")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    blanks = F.length(F.translate(t, "".join(BLANKS), ""))
    read = read.select("doc_id", "hash", "text", F.size("words").alias("w"), F.size(F.array_distinct("words")).alias("kinds"), F.greatest(blanks, F.lit(1)).alias("chars"))
    many = w >= 20
    ends = count(rf"[.?!](?={BLANK_CLASS}|$)")
    labelers = (
        w < 3,
        many & (count(SYMBOLS) >= 0.3 * w),
        many & (count(rf"{SYMBOLS}(?={BLANK_CLASS}|$)") >= 0.2 * w),
        many & ((F.col("chars") > 6.3 * w) | (F.col("chars") < 3 * w)),
        many & (count(r"\p{Lu}") >= 0.3 * F.col("chars")),
        many & (count("!") >= 0.3 * w),
        many & (count(rf"(?<![^\x20\x09-\x0D])({WORD_REGEX}){BLANK_CLASS}+\1(?![^\x20\x09-\x0D])") >= 0.15 * w),
        (w >= 50) & (F.col("kinds") < 0.56 * w) & (w < 4000),
        (w >= 50) & ((200 * ends < w) | (2 * ends > w)),
    )
    total = F.lit(0)
    for k, vote in enumerate(labelers):
        total = total + F.when(vote, 1 << k).otherwise(0)
    return read.select("doc_id", "hash", total.cast("int").alias("votes"))


def estimate(patterns: list[tuple[int, int]], n: int = len(LABELERS), rounds: int = 200) -> tuple[float, list[tuple[float, float]], dict[int, float]]:
    """EM over (votes, count): share of good documents, (hits on bad, false alarms on good) per labeler, posterior of good per pattern.

    Labelers are taken as independent given the class. All start alike, firing on a third of the bad
    and on one in fifty of the good; pseudo-counts of a few documents keep rates off nought and one.
    """
    share, rates = 0.8, [(0.33, 0.02)] * n
    total = sum(c for _, c in patterns)
    posterior: dict[int, float] = {}
    for _ in range(rounds):
        for v, _count in patterns:
            odds = math.log(share / (1 - share))
            for k, (hit, alarm) in enumerate(rates):
                odds += math.log(alarm / hit) if v >> k & 1 else math.log((1 - alarm) / (1 - hit))
            posterior[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        good = sum(posterior[v] * c for v, c in patterns)
        share = (8 + good) / (10 + total)
        for k in range(n):
            fired = [(c, posterior[v]) for v, c in patterns if v >> k & 1]
            hit = (0.33 + sum(c * (1 - p) for c, p in fired)) / (1 + total - good)
            alarm = (0.02 + sum(c * p for c, p in fired)) / (1 + good)
            rates[k] = hit, alarm
    return share, rates, posterior


#: Features beside the trigrams: texts by length and share of distinct trigrams, and by the share of the commonest one.
LENGTHS, DISTINCT, COMMONEST = 16, 8, 12
WIDTH = DIM + LENGTHS * DISTINCT + COMMONEST


def _features(text: bytes) -> np.ndarray:
    """Square roots of the shares of DIM hashed byte trigrams, which say what is written, and marks for how often
    it is said again; a text of fewer than three bytes has the marks alone."""
    b = np.frombuffer(text, dtype=np.uint8)
    out = np.zeros(WIDTH, dtype=np.float32)
    counts = np.zeros(DIM, dtype=np.int64)
    size = 1 << 20
    for at in range(0, max(len(b) - 2, 0), size):
        x = b[at : at + size + 2].astype(np.uint32)
        h = ((x[:-2] * _EDGE + x[1:-1]) * _EDGE + x[2:]) * np.uint32(0x9E3779B1)
        counts += np.bincount(h >> np.uint32(20), minlength=DIM)
    n = max(len(b) - 2, 1)
    out[:DIM] = np.sqrt(counts / n)
    length = min(LENGTHS - 1, n.bit_length())
    distinct = min(DISTINCT - 1, int(DISTINCT * np.count_nonzero(counts) / min(n, DIM // 4)))
    out[DIM + length * DISTINCT + distinct] = 0.5
    out[DIM + LENGTHS * DISTINCT + min(COMMONEST - 1, int(100 * counts.max() / n))] = 0.5
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t for t in batch.column(2).cast(pa.binary()).to_pylist()]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for b in batches for x in bytescan.slices(b, 2)):
        blobs = [_features(t).tobytes() for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(blobs, pa.binary())], names=["doc_id", "hash", "votes", "features"])


def fit(rows: list[tuple[bytes, float]], steps: int = 400) -> np.ndarray:
    """Weights and bias of a ridge-penalised logistic scorer; rows are (features as 32-bit floats, target)."""
    if not rows:
        return np.zeros(WIDTH + 1)
    x = np.frombuffer(b"".join(f for f, _ in rows), dtype=np.float32).reshape(len(rows), WIDTH)
    y = np.array([p for _, p in rows], dtype=np.float32)
    weight = np.zeros(WIDTH, dtype=np.float32)
    bias, rate = np.float32(0), np.float32(2.0)
    speed, speed_b = np.zeros_like(weight), np.float32(0)
    for _ in range(steps):
        d = (1 / (1 + np.exp(-(x @ weight + bias))) - y) / len(y)
        speed = np.float32(0.9) * speed + x.T @ d + np.float32(1e-5) * weight
        speed_b = np.float32(0.9) * speed_b + d.sum()
        weight -= rate * speed
        bias -= rate * speed_b
    return np.append(weight, bias)


def _scored(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in bytescan.slices(b, 2)):
            scores = [float(1 / (1 + np.exp(-(_features(t) @ weights[:-1] + weights[-1])))) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "hash", "score"])

    return run


def classify(docs: DataFrame, threshold: float = 0.5, seed: int = 5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, votes, posterior (of the weak labels), score (of the scorer), kept.

    kept is score >= threshold. Null text is empty and is scored by the bias alone. Repeated rows
    and null ids are scored alike and count one by one; of equal rows the sample takes one. An empty
    table gives an empty result, and other columns of docs are ignored. The sample holds the ``sample``
    smallest hashes of (id, text, seed), so reruns agree.
    """
    ship_code(docs.sparkSession)
    voted = materialise(votes(docs, id_col, text_col), "quality-votes")
    patterns = sorted((r.votes, r.n) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect())  # at most 2^9 rows
    _, _, posterior = estimate(patterns)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    drawn = voted.orderBy(F.xxhash64("doc_id", "hash", F.lit(seed)), "doc_id", "hash").limit(sample).distinct()
    drawn = F.broadcast(drawn.select(F.col("doc_id").alias("i"), F.col("hash").alias("h"), "votes"))  # at most sample rows
    chosen = texts.join(drawn, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).select("doc_id", "hash", "text", "votes").dropDuplicates(["doc_id", "hash"])
    featured = materialise(chosen.mapInArrow(_featured, "doc_id bigint, hash bigint, votes int, features binary"), "quality-sample").collect()
    weights = fit([(bytes(f), posterior[v]) for _, _, v, f in sorted((r.doc_id or 0, r.hash, r.votes, bytes(r.features)) for r in featured)])
    scored = materialise(texts.mapInArrow(_scored(weights), "doc_id bigint, hash bigint, score double"), "quality-scores")
    # votes and scores are functions of the text; the id only keeps rows with one text apart
    once: DataFrame = voted.groupBy(F.col("doc_id").alias("i"), F.col("hash").alias("h")).agg(F.max("votes").alias("votes"))
    table = ", ".join(f"{v}, {p!r}D" for v, p in posterior.items()) or "0, 0.5D"
    known: Column = F.element_at(F.expr(f"map({table})"), F.col("votes"))
    joined = scored.join(once, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")))
    return joined.select("doc_id", "votes", known.alias("posterior"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("kept"))
