"""Best-fit packing of tokenised documents by linear grouping.

Pieces have at most ``capacity`` lengths, so a histogram of lengths says all that a packing needs.
Large lengths are cut into groups of equal cardinality and rounded up to the largest of their group.
Which configurations of those few sizes to use, and how often, is a linear program: columns are
generated by a knapsack over its prices until none is worth adding, and uses are rounded down. Actual
lengths then take the places of the rounded ones; the few large pieces that rounding leaves, and after
them the small ones, go where they fit best. The plan says which ranks of each length go to which
sequences, as ranges: its size depends on the capacity and the number of groups, not on the corpus.
Executors rank the pieces of each length and look their places up.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breachline.llm.common import materialise, ship_code

CAPACITY = 1024
END_ID = 2
GROUPS = 100
#: Columns are generated until none is worth adding, or this often; any round's answer is a packing.
COLUMNS = 3000
#: Lengths up to capacity / SMALL are packed last, one by one.
SMALL = 8
#: Pieces of one length that are ranked in one group.
RANKED = 2000
CACHE = 400_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Characters for which all versions of Unicode tables agree on what is a letter, a digit or a space.
_ODD = re.compile("[^\x20-\x7e\n\t\r¡-ɏ]")
_SPACED = re.compile(r" [ \n\t\r]| \Z")


def _bytes(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _WordIds(dict):
    """' ' + word -> its ids as little-endian 32-bit; a bounded cache of a byte-level encoder."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of the byte-level tokenizer file, as little-endian unsigned 32-bit bytes.

    Texts of common characters are cut at single spaces, where this tokenizer always starts a new
    word, and words are looked up; all others are encoded whole by the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words = _WordIds(self._ordinary(path) or self._slow)

    @staticmethod
    def _ordinary(path: str):
        """A faster encoder over the same vocabulary, where one is installed and built from this file."""
        try:
            import tiktoken
        except ImportError:
            return None
        import json

        model = json.load(open(path, encoding="utf-8"))["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token) and not token.startswith("<|")}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: _bytes(encode(text))

    def _slow(self, text: str) -> bytes:
        return _bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text) or _SPACED.search(text) or any(s in text for s in self.special):
            return self._slow(text)
        first, *rest = text.split(" ")
        return (self.words.encode(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def _tokenised(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        end = _bytes([END_ID])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                start = 0
                for piece in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if piece == 0 else capacity
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start += length
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (size number -> how often) and their uses, rounded down, of an optimal fractional packing.

    The fewest sequences that hold counts[g] pieces of sizes[g], by the simplex method with generated columns.
    """
    m = len(sizes)
    if not m:
        return []
    demand = np.array(counts, dtype=float)
    columns = [np.zeros(m, dtype=np.int64) for _ in range(m)]
    for g, size in enumerate(sizes):
        columns[g][g] = capacity // size
    inverse = np.diag([1.0 / (capacity // size) for size in sizes])
    uses = inverse @ demand
    most = capacity // min(sizes)
    for _ in range(COLUMNS):
        price = inverse.sum(axis=0)
        # the dearest column: best[k][w] is the highest price of at most k pieces of total size w at most
        best, choice = np.zeros(capacity + 1), []
        for _ in range(most):
            picked, better = np.full(capacity + 1, -1), best.copy()
            for g, size in enumerate(sizes):
                offer = best[: capacity + 1 - size] + price[g]
                win = offer > better[size:] + 1e-12
                better[size:][win] = offer[win]
                picked[size:][win] = g
            if (picked < 0).all():
                break
            choice.append(picked)
            best = better
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(m, dtype=np.int64), capacity
        for picked in reversed(choice):
            if (g := picked[room]) >= 0:
                column[g] += 1
                room -= sizes[g]
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, uses / step, np.inf)
        out = int(np.argmin(ratio))
        columns[out] = column
        inverse[out] /= step[out]
        for i in range(m):
            if i != out:
                inverse[i] -= step[i] * inverse[out]
        uses = np.maximum(inverse @ demand, 0)
    return [({g: int(k) for g, k in enumerate(c) if k}, int(u + 1e-6)) for c, u in zip(columns, uses, strict=True)]


class Plan:
    """Places for ranks of lengths: entry e sends rank low[e] + i of length[e] to sequence first[e] + i at offset[e]."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity = capacity
        self.used = defaultdict(int)  # ranks of each length given out
        self.entries: list[tuple[int, int, int, int]] = []
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> blocks (first sequence, how many)
        self.sequences = 0
        small = {n: c for n, c in counts.items() if n <= capacity // SMALL}
        self._large({n: c for n, c in counts.items() if n > capacity // SMALL}, groups)
        for n in sorted(small, reverse=True):
            self._best_fit(n, small[n])
        order = sorted(self.entries)
        self.length, self.low, self.first, self.offset = (np.array(x, dtype=np.int64) for x in zip(*order, strict=True)) if order else [np.zeros(0, np.int64)] * 4

    def _give(self, length: int, first: int, n: int, offset: int) -> None:
        self.entries.append((length, self.used[length], first, offset))
        self.used[length] += n

    def _open(self, lengths: list[int], n: int) -> None:
        """n new sequences, each with pieces of these lengths."""
        at = 0
        for x in lengths:
            self._give(x, self.sequences, n, at)
            at += x
        if at < self.capacity:
            self.free[self.capacity - at].append((self.sequences, n))
        self.sequences += n

    def _grouped(self, counts: dict[int, int], groups: int) -> list[list[list[int]]]:
        """Runs [length, count], largest first, in groups of equal cardinality."""
        per = max(1, -(-sum(counts.values()) // groups))
        out, room = [], 0
        for n in sorted(counts, reverse=True):
            c = counts[n]
            while c:
                if not room:
                    out.append([])
                    room = per
                take = min(c, room)
                out[-1].append([n, take])
                c -= take
                room -= take
        return out

    def _large(self, counts: dict[int, int], groups: int) -> None:
        if full := counts.pop(self.capacity, 0):
            self._open([self.capacity], full)
        held = self._grouped(counts, groups)
        # groups that end on one length are one size
        merged: list[list[list[int]]] = []
        for g in held:
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        sizes = [g[0][0] for g in merged]
        left = [sum(c for _, c in g) for g in merged]
        for uses, n in configurations(sizes, left, self.capacity):
            n = min([n, *(left[g] // k for g, k in uses.items())])
            if n:
                for g, k in uses.items():
                    left[g] -= k * n
                self._substitute([merged[g] for g, k in uses.items() for _ in range(k)], n)
        rest: dict[int, int] = defaultdict(int)
        for runs in merged:
            for length, c in runs:
                rest[length] += c
        for length in sorted(rest, reverse=True):
            self._best_fit(length, rest[length])

    def _substitute(self, slots: list[list[list[int]]], n: int) -> None:
        """n sequences with an actual piece of each slot's group; the same group may fill several slots."""
        taken = []
        for runs in slots:
            need, own = n, []
            while need:
                length, c = runs[0]
                take = min(c, need)
                own.append((length, take))
                need -= take
                runs[0][1] -= take
                if not runs[0][1]:
                    runs.pop(0)
            taken.append(own)
        ends = sorted({int(e) for own in taken for e in np.cumsum([c for _, c in own])})
        at = 0
        places = [np.cumsum([c for _, c in own]) for own in taken]
        for end in ends:
            self._open([own[int(np.searchsorted(p, at, side="right"))][0] for own, p in zip(taken, places, strict=True)], end - at)
            at = end

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            room = next((r for r in range(length, self.capacity) if self.free.get(r)), None)
            if room is None:
                fresh = -(-n // (self.capacity // length))
                self._open([length], fresh)
                n -= fresh
                continue
            first, have = self.free[room].pop()
            use = min(have, n)
            self._give(length, first, use, self.capacity - room)
            if have > use:
                self.free[room].append((first + use, have - use))
            if room > length:
                self.free[room - length].append((first, use))
            n -= use

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks (from 0 within their length)."""
        key = lambda n, r: (n << np.int64(45)) + r
        e = np.searchsorted(key(self.length, self.low), key(length, rank), side="right") - 1
        return self.first[e] + rank - self.low[e], self.offset[e]


def _placed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            sequence, offset = plan.places(columns[3].to_numpy(zero_copy_only=False), columns[5].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and END_ID; null or empty text is END_ID alone. Documents longer than the
    capacity are cut into full pieces after a first one that takes the rest. Repeated rows, null ids
    and rows of one doc_id are documents of their own. An empty table gives an empty result; other
    columns of docs are ignored. Ties between pieces of one length go by id, piece and content.
    """
    ship_code(docs.sparkSession)
    path = tokenizer or tokenizer_file()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(texts.mapInArrow(_tokenised(path, capacity), PIECES), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = Plan(counts, capacity, groups)
    # ranks within a length: places within salted parts, after the sizes of the parts before
    parts = F.element_at(F.expr(f"map({', '.join(f'{n}L, {-(-c // RANKED)}L' for n, c in counts.items()) or '0L, 1L'})"), F.col("length"))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts))
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(plan), f"{PIECES}, sequence_id bigint, offset bigint")
