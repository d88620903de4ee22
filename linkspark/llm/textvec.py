"""Whole-text vector work on Arrow string columns.

A batch's UTF-8 bytes stay in one numpy array; words, lines, hashes and shingles are computed for all
rows of a block at once, so no Python runs per word. Blocks are cut at row borders to bound memory;
one row longer than the bound makes a block of its own and is still taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
#: ASCII white space, \x09-\x0D and \x20.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """Rows lo..hi of a batch: their bytes (with 8 bytes of padding behind) and row borders."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    @property
    def size(self) -> int:
        return int(self.offs[-1])

    def text(self, a: int, b: int) -> str:
        return self.buf[a:b].tobytes().decode("utf-8", "replace")


def as_large(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """A null counts as an empty text."""
    arr = as_large(column)
    if not len(arr):
        return
    _, o, d = arr.buffers()
    offs = np.frombuffer(o, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        hi = min(hi, len(arr))
        a, b = int(offs[lo]), int(offs[hi])
        buf = np.zeros(b - a + 8, np.uint8)
        buf[: b - a] = data[a:b]
        yield Block(lo, hi, buf, offs[lo : hi + 1] - a)
        lo = hi


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs without ASCII white space."""
    n = block.size
    solid = ~IS_SPACE[block.buf[:n]]
    first = np.zeros(n + 1, bool)
    first[block.offs] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, rows_of(starts, block)


def rows_of(positions: np.ndarray, block: Block) -> np.ndarray:
    return np.searchsorted(block.offs, positions, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step; buf must have 8 bytes of padding."""
    at = np.lib.stride_tricks.as_strided(np.ascontiguousarray(buf).view(np.uint8), (len(buf) - 7, 8), (1, 1))
    left = (ends - starts).astype(np.int64)
    h = mix(_U(seed) ^ left.astype(_U))
    pos, live = starts.astype(np.int64), np.flatnonzero(left > 0)
    pos, left = pos[live], left[live]
    while live.size:
        w = np.ascontiguousarray(at[pos]).view("<u8").ravel().astype(_U)
        short = left < 8
        if short.any():
            w[short] &= (_U(1) << (left[short] * 8).astype(_U)) - _U(1)
        h[live] = mix((h[live] ^ w) * _U(0x9DDFEA08EB382D69) + _U(1))
        more = left > 8
        live, pos, left = live[more], pos[more] + 8, left[more] - 8
    return h


_STEP = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (k <= 5); they may cross rows, callers mask those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = np.zeros(n, _U)
    for i in range(k):
        h += words[i : i + n] * _STEP[i]
    return mix(h + _U(k))


def shingle_sets(block: Block, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each row, ascending within a row: (borders, hashes).

    A-Z is lower-cased. A row with fewer than k words, but one at least, has its whole sequence as one
    shingle; a row without words has none.
    """
    buf = LOWER[block.buf]
    starts, ends, row = word_spans(block)
    words = hash_spans(buf, starts, ends)
    count = np.bincount(row, minlength=block.n)
    h = windows(words, k)
    inside = row[: len(h)] == row[k - 1 :][: len(h)] if len(h) else np.zeros(0, bool)
    h, own = h[inside], row[: len(inside)][inside]
    few = np.flatnonzero((count > 0) & (count < k))
    if few.size:
        first = np.concatenate(([0], np.cumsum(count)))[few]
        s = np.zeros(len(few), _U)
        for i in range(k - 1):
            has = count[few] > i
            s[has] = mix(s[has] * _STEP[4] + words[first[has] + i] + _U(i + 1))
        h, own = np.concatenate((h, mix(s ^ _U(0x2545F4914F6CDD1D)))), np.concatenate((own, few))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[keep], own[keep]
    borders = np.searchsorted(own, np.arange(block.n + 1))
    return borders, h


def segment_sum(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of values[borders[i]:borders[i+1]]; empty segments give 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[borders[1:]] - total[borders[:-1]]
