"""Words and shingles of whole Arrow text columns, in numpy.

Texts are never cut: a column is walked in chunks of whole documents, and words are hashed eight bytes at
a time over all words of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_K1, _K2, _K3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about ``size`` bytes."""
    body, at = raw(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = min(rows, max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1))
        yield first, end, body[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` that cross no document, and each document's first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte runs; equal-length runs of at most eight bytes never collide."""
    lens = ends - starts
    h = mix(lens.astype(np.uint64) * _K3 + np.uint64(seed))
    if not len(starts):
        return h
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(body) + 1,), "<u8", padded, 0, (1,))
    h = mix(h ^ (lanes[starts] & _MASK[np.minimum(lens, 8)]))
    left = np.flatnonzero(lens > 8)
    done = 8
    while len(left):
        h[left] = mix(h[left] ^ (lanes[starts[left] + done] & _MASK[np.minimum(lens[left] - done, 8)]))
        done += 8
        left = left[lens[left] > done]
    return h


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of anything but ASCII white space."""
    return spans(~WHITE[body], at)


def shingle_sets(body: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes.

    Words are compared with A-Z lower-cased.  A document with fewer than ``width`` words has its whole word
    sequence as its one shingle; one without words has none.
    """
    body = LOWER[body]
    starts, ends, first = words(body, at)
    word = hash_spans(body, starts, ends)
    n = len(word)
    rolled = word.copy()
    for j in range(1, width):
        rolled[: n - j] = mix(rolled[: n - j] * _K3 + word[j:]) if n > j else rolled[: n - j]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            acc = np.array([b - a], np.uint64)
            for w in word[a:b]:
                acc = mix(acc * _K1 + w)
            out.append(acc)
        else:
            out.append(word[:0])
    return out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lens > 0
    starts, lens = starts[keep].astype(np.int64), lens[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(lens)[:-1]
    step[ends] = starts[1:] - (starts[:-1] + lens[:-1] - 1)
    return np.cumsum(step)
