"""Removal of repeated 100-byte strings by a common-prefix-aware merge sort of suffixes.

Only suffixes at anchors are sorted: the anchor of a WIDTH-byte window is the smallest hash of its
GRAM-byte substrings, so equal windows have equal anchors at equal offsets, and each anchor stands
for a range of window starts. Anchors whose substring occurs nowhere else drop out first.

A suffix is sorted by its anchor's hash, the bytes from the anchor on (right), then the bytes before
it, backwards (left). Tasks sort the suffixes of their documents into runs, front-coded (shared
prefix length and rest), cut by ranges of the anchor hash, and exchange them. A loser tree merges
the runs of a range; it carries every contender's common prefix with the last output and so compares
no known prefix twice. Repeats are read off these common prefixes: neighbours that share everything
are one context, and two suffixes of an anchor share a window if the common prefixes of their rights
and of their lefts add up to its length. The earliest place of each window is its source.

Anchors that occur more than HOT times would bring too many contexts to one range. For these every
window is a suffix of its own, spread over all ranges by a hash of the window; among them, neighbours
that share a whole window are repeats.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachline.llm import bytescan
from breachline.llm.common import broadcast_if_small, keyed_join, materialise, ship_code, shuffle_parts

WIDTH, GRAM = 100, 28
HOT = 50_000
#: Bytes (of keys, with what Python adds) that a task sorts at a time; suffixes that a range gets (expected).
RUN_BYTES, RANGE = 24 << 20, 60_000
#: Removed ranges that a task holds before it sends them on.
HELD = 20_000
#: Suffixes of one anchor that are compared pair by pair; more are settled by blocks of common prefixes.
FEW = 12
SMALL_ROWS, SMALL_RANGES = 300_000, 50_000
LAST = (1 << 63) - 1
_PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)

Place = tuple[int, int, int]  # document, its text's hash, byte offset


def anchors(text: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window start of each anchor of a buffer of fewer than 2**20 bytes."""
    n = len(text) - gram + 1
    c = bytescan.prefix_hashes(bytescan.BYTE[text])
    h = bytescan.mix((c[gram:] - c[:-gram]) * bytescan.powers(bytescan.INVERSE, n))
    low = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    span, reach = width - gram + 1, 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = (low & _LOW).astype(np.int64)
    return h, at, low, c


def _ranges(at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each maximal range of valid starts with one anchor."""
    own = at[starts]
    edge = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.append(edge[1:], len(own)) - 1
    return own[edge], starts[edge], starts[last]


def scan(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text (and per piece of a long one): its number, anchor hashes, places, first and last window starts."""
    at = 0
    for held in bytescan.batches(texts, _PIECE // 2):
        if sum(map(len, held)) + len(held) <= _PIECE:
            size = np.array([len(t) for t in held])
            if (size >= width).any():
                first = np.concatenate(([0], np.cumsum(size)))
                buf = np.frombuffer(b"".join(held), dtype=np.uint8)
                h, place, _, _ = anchors(buf, width, gram)
                count = np.maximum(size - width + 1, 0)
                starts = np.arange(count.sum()) + np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
                a, lo, hi = _ranges(place, starts)
                cut = np.searchsorted(lo, first)
                for i in range(len(held)):
                    if count[i]:
                        s = slice(cut[i], cut[i + 1])
                        yield at + i, h[a[s]], a[s] - first[i], lo[s] - first[i], hi[s] - first[i]
        else:
            for i, text in enumerate(held):
                for begin in range(0, max(len(text) - width + 1, 0), _PIECE):
                    buf = np.frombuffer(text[begin : begin + _PIECE + width - 1], dtype=np.uint8)
                    h, place, _, _ = anchors(buf, width, gram)
                    a, lo, hi = _ranges(place, np.arange(len(buf) - width + 1))
                    yield at + i, h[a], a + begin, lo + begin, hi + begin
        at += len(held)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for b in batches for x in bytescan.slices(b, 1, bytescan.CHUNK)):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, h, a, _, _ in _joined(scan(batch.column(1).cast(pa.binary()).to_pylist()), ids):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(i), pa.array(a.astype(np.int32))], names=["gram", "did", "pos"])


def _joined(found: Iterable, ids: np.ndarray, size: int = 100_000) -> Iterator[tuple]:
    """The anchors of several texts in arrays of about size rows."""
    held, n = [], 0

    def out() -> tuple:
        i = np.repeat(ids[[x[0] for x in held]], [len(x[1]) for x in held])
        return i, *(np.concatenate([x[k] for x in held]) for k in range(1, 5))

    for x in found:
        held.append(x)
        n += len(x[1])
        if n >= size:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which known bytes are known to agree."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(run: list[tuple[bytes, object]]) -> list[tuple[int, bytes, object]]:
    """A sorted run of (key, value) as (length shared with the key before, the rest, value)."""
    out, last = [], b""
    for key, value in run:
        shared = common_prefix(last, key, 0)
        out.append((shared, key[shared:], value))
        last = key
    return out


class LoserTree:
    """Merges front-coded sorted runs into one stream of (shared with the one before, key, value).

    Every contender knows its common prefix with the last winner. Of two, the one that shares more
    comes first, and the other keeps what it shares; only if both share the same are bytes compared,
    from there on, and the loser then knows its common prefix with the winner.
    """

    def __init__(self, runs: list[Iterable[tuple[int, bytes, object]]]):
        self.runs = [iter(r) for r in runs]
        self.n = 1
        while self.n < max(1, len(runs)):
            self.n *= 2
        self.key: list[bytes | None] = [None] * self.n
        self.shared = [0] * self.n
        self.value: list[object] = [None] * self.n
        for i in range(len(runs)):
            self._next(i)
        self.loser = [0] * self.n
        winners = list(range(self.n))
        at = self.n
        while at > 1:  # the first tournament
            at //= 2
            winners = [self._play(at + j, winners[2 * j], winners[2 * j + 1]) for j in range(at)]
        self.top = winners[0]

    def _next(self, i: int) -> None:
        got = next(self.runs[i], None)
        if got is None:
            self.key[i] = None
            return
        shared, rest, self.value[i] = got
        last = self.key[i]
        self.key[i] = rest if not shared else last[:shared] + rest
        self.shared[i] = shared

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner goes up, the loser stays at the node."""
        ka, kb = self.key[a], self.key[b]
        if ka is None or kb is None:
            win, lose = (b, a) if ka is None else (a, b)
        else:
            sa, sb = self.shared[a], self.shared[b]
            if sa > sb:
                win, lose = a, b
            elif sb > sa:
                win, lose = b, a
            else:
                both = common_prefix(ka, kb, sa)
                first = both == len(ka) if both == len(ka) or both == len(kb) else ka[both] < kb[both]
                win, lose = (a, b) if first else (b, a)
                self.shared[lose] = both
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.key[self.top] is not None:
            i = self.top
            yield self.shared[i], self.key[i], self.value[i]
            self._next(i)
            node, win = (self.n + i) // 2, i
            while node:
                win = self._play(node, win, self.loser[node])
                node //= 2
            self.top = win


ANCHOR, WINDOW = b"\0", b"\1"
_HEAD = 9  # tag and hash


def context_key(gram: int, right: bytes, left: bytes) -> bytes:
    """Tag, anchor hash, right, left backwards, length of right: equal keys are equal contexts."""
    return b"".join((ANCHOR, gram.to_bytes(8, "big"), right, left[::-1], len(right).to_bytes(2, "big")))


def window_key(window: bytes) -> bytes:
    return WINDOW + hashlib.blake2b(window, digest_size=8).digest() + window


def _sides(key: bytes) -> tuple[int, int]:
    """Bytes before and after the place of a suffix that its key covers."""
    if key[:1] == WINDOW:
        return 0, len(key) - _HEAD
    right = int.from_bytes(key[-2:], "big")
    return len(key) - _HEAD - 2 - right, right


def _span(key: bytes, place: Place) -> tuple[int, int, int, int]:
    left, right = _sides(key)
    return place[0], place[1], place[2] - left, place[2] + right


def _pairwise(group: list[list], width: int) -> Iterator[tuple[int, int, int, int]]:
    """Removed ranges among a few contexts of one anchor, each [key, place, prefix shared with the one before]."""
    sides = [_sides(key) for key, _, _ in group]
    lefts = [key[_HEAD + right : -2] for (key, _, _), (_, right) in zip(group, sides, strict=True)]
    for i in range(len(group)):
        low = width + max(r for _, r in sides)
        for k in range(i + 1, len(group)):
            low = min(low, group[k][2] - _HEAD)
            right = min(low, sides[i][1], sides[k][1])
            if right + min(sides[i][0], sides[k][0]) < width:
                continue
            left = common_prefix(lefts[i], lefts[k], 0)
            if left + right >= width:
                d, t, at = max(group[i][1], group[k][1])
                yield d, t, at - left, at + right


def _by_blocks(group: list[list], width: int) -> Iterator[tuple[int, int, int, int]]:
    """The same for many contexts: windows that start j bytes before the anchor are equal where neither order of
    contexts, by rights or by lefts, has a neighbour that shares less than the window needs."""
    m = len(group)
    group = [group[0][:2] + [0], *group[1:]]
    nl, nr = np.array([_sides(key) for key, _, _ in group]).T
    lefts = [key[_HEAD + r : -2] for (key, _, _), r in zip(group, nr.tolist(), strict=True)]
    by_left = sorted(range(m), key=lefts.__getitem__)
    shared_left = np.array([0] + [common_prefix(lefts[a], lefts[b], 0) for a, b in zip(by_left, by_left[1:], strict=False)])
    shared_right = np.array([x[2] - _HEAD for x in group])
    by_place = np.array(sorted(range(m), key=lambda i: group[i][1]))
    covered = np.zeros((m, int(nl.max()) + 1), dtype=bool)
    for j in range(covered.shape[1]):
        block = np.cumsum(shared_right < width - j)
        other = np.empty(m, dtype=np.int64)
        other[by_left] = np.cumsum(shared_left < j)
        have = by_place[(nl[by_place] >= j) & (nr[by_place] >= width - j)]
        first = np.unique(block[have] * (m + 1) + other[have], return_index=True)[1]
        later = np.ones(len(have), dtype=bool)
        later[first] = False
        covered[have[later], j] = True
    edge = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    for (i, low), (_, high) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
        d, t, at = group[i][1]
        yield d, t, at - high + 1, at - low + width


def repeats(merged: Iterable[tuple[int, bytes, Place]], width: int = WIDTH) -> Iterator[tuple[int, int, int, int]]:
    """Removed ranges (document, text hash, start, end) of a sorted stream of (prefix shared with the one before, key, place)."""
    group: list[list] = []

    def settled() -> Iterator[tuple[int, int, int, int]]:
        if len(group) > 1:
            yield from (_pairwise if len(group) <= FEW else _by_blocks)(group, width)

    for shared, key, place in merged:
        if group and shared == len(key) == len(group[-1][0]):
            place, group[-1][1] = max(place, group[-1][1]), min(place, group[-1][1])
            if place != group[-1][1]:
                yield _span(key, place)
            continue
        if shared < _HEAD or key[:1] == WINDOW:
            yield from settled()
            group = []
        group.append([key, place, shared])
    yield from settled()


def _merged(ranges: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of each document, overlapping and touching ones joined."""
    out: list[tuple[int, int, int, int]] = []
    for d, t, s, e in sorted(ranges):
        if out and out[-1][:2] == (d, t) and s <= out[-1][3]:
            if e > out[-1][3]:
                out[-1] = (d, t, out[-1][2], e)
        else:
            out.append((d, t, s, e))
    return out


RUN_ROWS = "bucket int, body binary, did bigint, tie bigint, s int, e int"


def _run_batch(bodies: list[tuple[int, bytes]], ranges: list[tuple[int, int, int, int]], buckets: int) -> pa.RecordBatch:
    none = [None] * len(bodies)
    columns = [[b for b, _ in bodies] + [r[0] % buckets for r in ranges], [x for _, x in bodies] + [None] * len(ranges)] + [none + [r[k] for r in ranges] for k in range(4)]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "body", "did", "tie", "s", "e"])


_COLUMNS = (("shared", "<u2"), ("rest", "<u2"), ("did", "<i8"), ("tie", "<i8"), ("pos", "<i4"))


def packed(run: list[tuple[int, bytes, Place]]) -> bytes:
    """A front-coded run as compressed bytes: its length, columns of numbers, the rests of the keys."""
    columns = ([x[0] for x in run], [len(x[1]) for x in run], *([x[2][k] for x in run] for k in range(3)))
    return zlib.compress(b"".join([len(run).to_bytes(4, "little"), *(np.array(c, dtype=t).tobytes() for c, (_, t) in zip(columns, _COLUMNS, strict=True)), *(x[1] for x in run)]), 1)


def unpacked(body: bytes, step: int = 256) -> Iterator[tuple[int, bytes, Place]]:
    """The run again, decoded as it is read."""
    body = zlib.decompress(body)
    n, at, columns = int.from_bytes(body[:4], "little"), 4, []
    for _, kind in _COLUMNS:
        columns.append(np.frombuffer(body, dtype=kind, count=n, offset=at))
        at += columns[-1].nbytes
    for low in range(0, n, step):
        for shared, rest, *place in zip(*(c[low : low + step].tolist() for c in columns), strict=True):
            yield shared, body[at : at + rest], tuple(place)
            at += rest


def _runs(buckets: int, width: int = WIDTH, gram: int = GRAM):
    """Rows (did, tie, text, positions; those of hot anchors as -1 - position) to sorted front-coded runs."""

    def flush(held: list[tuple], gone: list) -> pa.RecordBatch:
        held.sort()
        runs: dict[int, list] = defaultdict(list)
        last: dict[int, bytes] = {}
        for key, *place in held:
            b = int.from_bytes(key[1:_HEAD], "big") * buckets >> 64
            before = last.get(b, b"")
            shared = common_prefix(before, key, 0)
            if shared == len(key) == len(before):  # the same context starts earlier
                gone.append(_span(key, place))
            else:
                runs[b].append((shared, key[shared:], place))
                last[b] = key
        return _run_batch([(b, packed(r)) for b, r in runs.items()], _merged(gone), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in (x for b in batches for x in bytescan.slices(b, 2, bytescan.CHUNK)):
            dids, ties, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            texts = [zlib.decompress(x) for x in batch.column(2).to_pylist()]
            for i, h, a, lo, hi in scan(texts, width, gram):
                at = np.asarray(marks[i].values, dtype=np.int64)
                hot = set((-1 - at[at < 0]).tolist())
                pick = np.isin(a, np.where(at < 0, -1 - at, at))
                text, d, t = texts[i], dids[i], ties[i]
                # the smallest hash of a window is a small number: mixed again, it spreads over the ranges
                for g, p, s0, s1 in zip(bytescan.mix(h[pick]).tolist(), a[pick].tolist(), lo[pick].tolist(), hi[pick].tolist(), strict=True):
                    if p in hot:
                        held += [(window_key(text[s : s + width]), d, t, s) for s in range(s0, s1 + 1)]
                        size += 320 * (s1 + 1 - s0)
                    else:
                        key = context_key(g, text[p : s1 + width], text[s0:p])
                        held.append((key, d, t, p))
                        size += len(key) + 220
                    if size >= RUN_BYTES:
                        yield flush(held, [])
                        held, size = [], 0
        if held:
            yield flush(held, [])

    return run


def _merge(width: int = WIDTH):
    """Sorted rows of RUN_ROWS, bucket by bucket, to removed ranges."""

    def out(ranges: list) -> pa.RecordBatch:
        rows = _merged(ranges)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["did", "tie", "s", "e"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
        now, bodies = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, body = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if bucket != now and bodies:
                    yield from repeats(LoserTree([unpacked(b) for b in bodies]), width)
                    bodies = []
                now = bucket
                if body is None:
                    yield tuple(batch.column(k)[row].as_py() for k in range(2, 6))
                else:
                    bodies.append(body)
        if bodies:
            yield from repeats(LoserTree([unpacked(b) for b in bodies]), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for r in found(batches):
            held.append(r)
            if len(held) >= HELD:
                yield out(held)
                held = []
        if held:
            yield out(held)

    return run


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, compressed: texts are exchanged twice."""
    for batch in (x for b in batches for x in bytescan.slices(b, b.num_columns - 1)):
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([zlib.compress(x.as_py(), 1) for x in texts], pa.binary())], names=batch.schema.names)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, whole, ranges) to the texts that stay."""
    for batch in (x for b in batches for x in bytescan.slices(b, 1, bytescan.CHUNK)):
        rows = []
        for text, whole, ranges in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            text = zlib.decompress(text.as_py())
            spans = [(0, 0, 0, len(text))] if whole.as_py() else _merged((0, 0, x["s"], x["e"]) for x in ranges.as_py() or ())
            kept, at = [], 0
            for _, _, s, e in spans:
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            rows.append((len(text), sum(e - s for _, _, s, e in spans), len(spans), b"".join(kept)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte goes if it lies in a WIDTH-byte string that also starts earlier: in a document with a
    smaller id, or earlier in the same one. Null text is empty; null ids come last. Rows that share
    an id and a text are one document, rows that share an id only are ordered by a hash of the text.
    Removed bytes may split a character, so what stays is binary. Empty tables give empty results;
    other columns of docs are ignored. Offsets are 32-bit: a text has fewer than 2 GB.
    """
    ship_code(docs.sparkSession)
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    # whole texts that an earlier document has: all their windows are repeats, and none is a first
    long_ = docs.filter(F.octet_length("text") >= WIDTH)
    size = F.octet_length("text").alias("n")
    whole = materialise(long_.select("did", "tie", F.xxhash64(F.lit(1), "text").alias("tie2"), size), "texts")
    keyed = whole.select(F.struct("tie", "tie2", "n").alias("key"), "did", "tie")
    firsts = keyed.groupBy("key").agg(F.min("did").alias("first"), F.max("did").alias("last"), F.count("*").alias("often")).filter(F.col("first") != F.col("last"))
    copies = keyed_join(keyed, materialise(firsts.drop("last"), "first-texts"), "key", "often", SMALL_ROWS)
    copies = materialise(copies.filter(F.col("did") > F.col("first")).select("did", "tie").distinct(), "copies")
    copies = broadcast_if_small(copies, SMALL_ROWS)
    sources = long_.join(copies, ["did", "tie"], "left_anti")
    found = sources.select("did", "text").mapInArrow(_anchor_rows, "gram bigint, did bigint, pos int")
    shared = materialise(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "grams")
    hot_grams = shared.filter(F.col("n") > hot).select("gram", F.lit(True).alias("hot"))
    if hot_grams.isEmpty():
        found = found.withColumn("hot", F.lit(None).cast("boolean"))
    else:
        found = found.join(broadcast_if_small(hot_grams, SMALL_ROWS), "gram", "left")
    # hot anchors are shared anyway: they are spread, and don't meet in the task of their gram
    key = F.when(F.col("hot"), F.xxhash64("did", "pos")).otherwise(F.col("gram"))
    cold = shared.filter(F.col("n") <= hot).select(F.col("gram").alias("key"), F.lit(True).alias("cold"))
    marked = found.withColumn("key", key).join(cold.hint("shuffle_hash"), "key", "left").filter("hot OR cold")
    marked = marked.select("did", F.when(F.col("hot"), -1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"))
    marked = materialise(marked.groupBy("did").agg(F.collect_list("pos").alias("marks"), F.count("*").alias("n")), "anchors")
    total = marked.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * shuffle_parts(spark), -(-total // RANGE))
    zipped = sources.select("did", "tie", "text").mapInArrow(_zipped, "did bigint, tie bigint, text binary")
    runs = zipped.join(marked.select("did", "marks"), "did").select("did", "tie", "text", "marks").mapInArrow(_runs(buckets), RUN_ROWS)
    exchanged = runs.repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket")
    ranges = exchanged.mapInArrow(_merge(), "did bigint, tie bigint, s int, e int")
    ranges = materialise(ranges.groupBy("did", "tie").agg(F.collect_list(F.struct("s", "e")).alias("ranges")), "ranges")
    docs = docs.select("doc_id", "did", "tie", "text").mapInArrow(_zipped, "doc_id bigint, did bigint, tie bigint, text binary")
    marks = docs.join(copies.withColumn("whole", F.lit(True)), ["did", "tie"], "left").join(broadcast_if_small(ranges, SMALL_RANGES, F.size("ranges")), ["did", "tie"], "left")
    return marks.select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges").mapInArrow(_removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(result: DataFrame) -> DataFrame:
    kept: Column = F.sha2("kept", 256)
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"))


#: Windows are told apart by MD5, so that none is kept whole.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(places) AS s, unnest(list_transform(places, lambda s: md5_number(substr(x, 2 * s + 1, 200)))) AS win FROM (SELECT doc_id, x, range(0, greatest(length(x) // 2 - 99, 0)) AS places FROM d)),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM p),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM k WHERE k > 1)),
r AS (SELECT doc_id, min(s) AS s, max(s) + 100 AS e FROM i GROUP BY doc_id, island),
n AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed FROM r GROUP BY doc_id),
g AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM r
  UNION ALL SELECT doc_id, coalesce(max(e), 0), max(length(x) // 2) FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id
), h AS (SELECT doc_id, string_agg(substr(x, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
