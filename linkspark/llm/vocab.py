"""Exact tokenizer output from per-worker tables of distinct text chunks.

A text is cut only where the tokenizer must cut as well, so a chunk's ids do not depend on its
neighbours. Each distinct chunk goes through the tokenizer library once per worker; all its later
occurrences are table look-ups made by numpy for a whole block.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain
from string import ascii_lowercase, ascii_uppercase

import numpy as np

from .textvec import IS_SPACE, LOWER, Block, hash_spans

#: Beyond so many distinct chunks a worker's table drops those used least; it bounds memory, never results.
MAX_CHUNKS = 1_000_000
#: Punctuation that word_chunks parts from letters: none composes with a mark or begins a contraction.
STOPS = np.zeros(256, bool)
STOPS[list(b".,!?#$%&*")] = True


@lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _spans(block: Block, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut[block.offs[:-1][block.offs[:-1] < block.size]] = True
    starts = np.flatnonzero(cut[: block.size])
    return starts, np.append(starts[1:], block.size) if len(starts) else starts


def space_chunks(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Chunks for byte-level pre-tokenizers in which a blank belongs to what follows it.

    Cuts stand before a single blank or line feed whose neighbours are known not to be white space:
    printable ASCII, or letters of the two-byte block led by 0xC3. Any other neighbour only makes a
    chunk longer.
    """
    b = block.buf
    n = block.size
    if n < 3:
        return _spans(block, np.zeros(n + 1, bool))
    plain = (b >= 0x21) & (b <= 0x7E)
    left = np.zeros(n, bool)
    left[1:] = plain[: n - 1]
    left[2:] |= (b[: n - 2] == 0xC3) & (b[1 : n - 1] >= 0x80)
    right = plain[1 : n + 1] | (b[1 : n + 1] == 0xC3)
    at = b[:n]
    return _spans(block, np.append(((at == 32) | (at == 10)) & left & right, False))


def word_chunks(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Chunks for a pre-tokenizer that drops white space and splits letters from punctuation.

    Words between ASCII white space, cut again where a letter meets one of STOPS. Letters are
    a-z, A-Z and the letters led by 0xC3; other neighbours are left uncut.
    """
    b = block.buf
    n = block.size
    at = b[:n]
    solid = ~IS_SPACE[at]
    first = np.zeros(n + 1, bool)
    first[block.offs] = True
    letter = ((at | 32) >= 97) & ((at | 32) <= 122)
    wide = np.zeros(n, bool)  # the second byte of such a letter
    wide[1:] = (at[:-1] == 0xC3) & (at[1:] >= 0x80) & (at[1:] != 0x97) & (at[1:] != 0xB7)
    tail = letter | wide
    head = letter.copy()
    head[:-1] |= wide[1:]
    stop = STOPS[at]
    turn = np.zeros(n, bool)
    turn[1:] = (tail[:-1] & stop[1:]) | (stop[:-1] & head[1:])
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n] | turn))
    brk = np.ones(n, bool)
    brk[:-1] = ~solid[1:] | first[1:n] | turn[1:]
    return starts, np.flatnonzero(solid & brk) + 1


class ChunkTable:
    """Distinct chunks by 64-bit hash, with the ids that the library gives them."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending, with their rows
        self.row = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def trim(self) -> None:
        """Keep the chunks used most, half the bound at most; chunks used once always go."""
        least = 2
        while np.count_nonzero(self.uses >= least) > MAX_CHUNKS // 2:
            least *= 2
        kept = self.uses >= least
        live = kept[self.row]
        self.keys, self.row = self.keys[live], (np.cumsum(kept) - 1)[self.row[live]].astype(np.int32)
        size, old = self.length[kept], self.start[kept]
        to = np.cumsum(size, dtype=np.int64)
        self.uses, self.length, self.start = self.uses[kept] >> 1, size, to - size
        self.ids = self.ids[np.repeat(old - self.start, size) + np.arange(int(size.sum()))]

    def prepare(self, block: Block) -> Block:
        """The block with bytes folded that the tokenizer itself would fold."""
        return block

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, start, ids) of the texts' ids."""
        ids = [e.ids for e in load(self.path).encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return size, np.cumsum(size) - size, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))

    def look_up(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of the table for each span."""
        if len(self.keys) > MAX_CHUNKS:
            self.trim()
        block = self.prepare(block)
        distinct, where, back, times = np.unique(hash_spans(block.buf, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, distinct)
        rows = np.full(len(distinct), -1, np.int64)
        inside = np.flatnonzero(at < len(self.keys))
        known = inside[self.keys[at[inside]] == distinct[inside]]
        rows[known] = self.row[at[known]]
        new = np.flatnonzero(rows < 0)
        if new.size:
            size, start, ids = self._encode([block.text(a, b) for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            rows[new] = len(self.length) + np.arange(new.size)
            self.keys, self.row = np.insert(self.keys, at[new], distinct[new]), np.insert(self.row, at[new], rows[new])
            self.uses = np.concatenate((self.uses, np.zeros(new.size, np.int64)))
            self.length = np.concatenate((self.length, size.astype(np.int32)))
            self.start = np.concatenate((self.start, len(self.ids) + start))
            self.ids = np.concatenate((self.ids, ids))
        self.uses[rows] += times
        return rows[back]


class WordTable(ChunkTable):
    """Many one-word chunks go through the library in one call, parted again at its word-end tokens."""

    @property
    def word_end(self) -> np.ndarray:
        return _word_ends(self.path)

    def prepare(self, block: Block) -> Block:
        """A-Z in lower case where the tokenizer does that as well: not before a mark, with which only one of the
        cases may compose, and not where an added token, which is found before that, could be made or lost."""
        special = _folds(self.path)
        if special is None:
            return block
        buf = block.buf.copy()
        buf[:-1] = np.where(buf[1:] < 0xCC, LOWER[buf[:-1]], buf[:-1])
        low = buf.tobytes().lower()
        return block if any(x in low for x in special) else Block(block.lo, block.hi, buf, block.offs)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = [i for i, t in enumerate(texts) if t.isalpha() and t.lower().isalpha()]
        done = np.zeros(len(texts), bool)
        order, sizes, flat = [], [], []
        for a in range(0, len(plain), 512):
            part = plain[a : a + 512]
            got = np.array(load(self.path).encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.word_end[got]) + 1
            if len(ends) == len(part) and ends[-1] == len(got):
                done[part] = True
                order.append(part)
                sizes.append(np.diff(ends, prepend=0))
                flat.append(got)
        rest = np.flatnonzero(~done).tolist()
        size, _, ids = super()._encode([texts[i] for i in rest])
        size, ids = np.concatenate([*sizes, size]), np.concatenate([*flat, ids]).astype(np.uint32)
        by = np.argsort(np.concatenate([*order, rest]).astype(np.int64))
        return size[by], (np.cumsum(size) - size)[by], ids


@lru_cache(maxsize=4)
def _folds(path: str) -> list[bytes] | None:
    """Added tokens in lower case, if the tokenizer puts A-Z in lower case; else None."""
    t = load(path)
    if t.normalizer is None or t.normalizer.normalize_str(ascii_uppercase) != ascii_lowercase:
        return None
    return [x.content.encode().lower() for x in t.get_added_tokens_decoder().values()]


@lru_cache(maxsize=4)
def _word_ends(path: str) -> np.ndarray:
    vocab = load(path).get_vocab(True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return out


@lru_cache(maxsize=4)
def table(kind: type, path: str) -> ChunkTable:
    """The worker's own table; workers are reused from task to task."""
    return kind(path)
