"""Vectorised hashing of words and byte windows, for operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240607)
#: A random number for every byte value; the second table reads A-Z as a-z.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: An odd base, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: powers up to d give those up to 2d
            step = U64(pow(base, done, 2**64))
            more = min(done, size - done)
            have[done : done + more] = have[:more] * step
            done += more
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of codes[k] * BASE ** k over i <= k < j."""
    c = np.empty(len(codes) + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum(codes * powers(BASE, len(codes)), out=c[1:])
    return c


def span_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the buffer that c was made of; equal spans have equal hashes."""
    return mix((c[end] - c[start]) * powers(INVERSE, len(c))[start] + (end - start).astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not blank."""
    edge = np.diff(np.concatenate(([True], BLANK[buf], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def pieces(text: bytes) -> Iterator[bytes]:
    """text in pieces of about CHUNK bytes, cut where a word ends."""
    at = 0
    while len(text) - at > 2 * CHUNK:
        end = at + CHUNK
        while end < len(text) and not BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: bytes, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """A 64-bit hash for each word of text."""
    found = []
    for piece in pieces(text):
        buf = np.frombuffer(piece, dtype=np.uint8)
        start, end = word_spans(buf)
        found.append(span_hashes(prefix_hashes(table[buf]), start, end))
    return np.concatenate(found)


def batches(texts: Iterable[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    """texts in lists of about size bytes."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def slices(batch: pa.RecordBatch, column: int, size: int = 4 * CHUNK, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """batch in slices of about size bytes of a text column and at most so many rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size))))
        yield batch.slice(at, end - at)
        at = end


def batch_word_hashes(texts: list[bytes], table: np.ndarray = BYTE_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and per text the place of its first (with one more at the end)."""
    if sum(map(len, texts)) > 2 * CHUNK:
        each = [word_hashes(t, table) for t in texts]
        return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    start, end = word_spans(buf)
    firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return span_hashes(prefix_hashes(table[buf]), start, end), np.searchsorted(start, firsts)


_SPREAD = [U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)]


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within each text, and per text the place of its first.

    A text of 1 to k - 1 words has one: all of its words.
    """
    n = np.diff(at)
    total = len(hashes)
    rolled = np.zeros(max(total - k + 1, 0), dtype=np.uint64)
    for j in range(k if total >= k else 0):
        rolled += mix(hashes[j : total - k + 1 + j] + _SPREAD[j % 5]) * _SPREAD[(j + 1) % 5] * U64(2 * j + 1)
    rolled = mix(rolled)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(first[-1], dtype=np.uint64)
    long = n >= k
    if long.any():
        # places of the windows that lie within one text
        owner = np.repeat(np.flatnonzero(long), count[long])
        within = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(count[long])[:-1])), count[long])
        out[first[owner] + within] = rolled[at[owner] + within]
    for i in np.flatnonzero((n > 0) & ~long):
        h = U64(0x1234567 + int(n[i]))
        for x in hashes[at[i] : at[i + 1]]:
            h = mix(np.array([h ^ x]) * _SPREAD[0] + _SPREAD[1])[0]
        out[first[i]] = h
    return out, first
