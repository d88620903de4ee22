"""SentencePiece-model encoding and decoding with N-best segmentation.

Pieces and their merge order come from a model file. A text is prepared as the model's processor does (blanks
become U+2581, one goes before the text where the model says so) and cut into chunks before each single
U+2581 that stands between other characters, between a letter that no piece joins to a stop and a stop, and around line
feeds where no longer piece holds one; all are checked against all pieces when the model is loaded.

Scores. A byte-pair model's scores are ranks of merges, and their sums mean nothing, so segmentations are
ordered by how far they depart from the tokenizer's own: a piece that the tokenizer's encoding has at its place
costs nothing, any other -log p, where p falls with the piece's rank by Zipf's law. The best segmentation is
therefore always the library's encoding, with score 0 (tests: all texts of the smallest table), and the
others follow by the information of the pieces that they change. Ties keep the order of the search,
which depends on the chunk alone.

Search. Over a chunk's lattice of pieces, a forward Viterbi pass gives the least cost of every prefix. Those
are exact remaining costs for an A* search from the chunk's end to its start: an entry of the queue is a suffix,
held as a chain of pieces, and the next edge to try at its front; a popped suffix is extended along the edges
without loss at once, and only its siblings wait, so the search is linear in the chunk for each segmentation.
Characters that no piece covers fall back to their bytes, or to the unknown piece.

A document's N best segmentations are combinations of its chunks' N best: again best first, from the sums of
differences to the best. Chunk results are kept in a table of the worker, bounded by MAX_CHUNKS: beyond it,
what was used once goes and what came again stays.

Null and empty texts have no piece and score 0, with one segmentation. Repeated rows are encoded alike; empty
tables give no rows; further columns are ignored, whatever their names. Very long chunks are searched as a whole.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = "▁"
#: What a byte of a character that no piece covers costs, more than any piece.
FALLBACK = 20.0
#: Ranks count from here in Zipf's law, which flattens it for the first merges.
ZIPF_FROM = 100
#: Beyond so many distinct chunks a worker's table drops the words used least; it bounds memory, never results.
MAX_CHUNKS = 800_000
#: Before a single blank between other characters.
BORDER = f"(?<=[^{BLANK}])(?={BLANK}[^{BLANK}])"
STOPS = ".,!?$%&*#|"


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters of chunks that are searched together; a longer chunk goes alone.
TOGETHER = 100_000


def _head_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h + ord(c) + 1) * int(_STEP) & (1 << 64) - 1
    return h


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp = sp
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        true = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in true}
        # The order of merges: higher scores first.
        self.rank = {self.text[i]: r for r, i in enumerate(sorted(true, key=lambda i: (-sp.get_score(i), i)))}
        p = 1 / (np.arange(len(true)) + ZIPF_FROM)
        cost = -np.log(p / p.sum())
        self.cost = {piece: float(cost[r]) for piece, r in self.rank.items()}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        if any(re.search(BORDER, p) for p in self.ids):
            raise ValueError("a piece of this model spans a word border")
        joined = re.escape("".join(sorted({x for p in self.ids for x in re.findall(rf"([^\W\d_])(?=[{re.escape(STOPS)}])", p)})))
        #: Whether nothing ever joins a line feed, so that texts can be cut around each.
        self.lines = not any("\n" in p and len(p) > 1 for p in self.ids)
        around = r"|(?<=\n)(?=[\s\S])|(?<=[\s\S])(?=\n)" if self.lines else ""
        self.border = re.compile(BORDER + rf"|(?<=[^\W\d_{joined}])(?=[{re.escape(STOPS)}])" + around)
        raw = [t.encode() for t in self.text]
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw_size = np.array([len(r) for r in raw], np.int32)
        self.raw_start = np.concatenate(([0], np.cumsum(self.raw_size)[:-1])).astype(np.int32)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        # Characters of each piece; a character in bytes counts at its first byte.
        self.width = np.array([int(len(r) == 1 and not 0x80 <= r[0] < 0xC0) if i in set(self.byte.values()) else len(t) for i, (t, r) in enumerate(zip(self.text, raw, strict=True))], np.int64)
        # Every beginning of a piece by its hash: its id if it is a piece itself, else -1.
        heads = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        h = np.array([_head_hash(t) for t in heads], np.uint64)
        by = np.argsort(h)
        self.head, self.head_id = h[by], np.fromiter(heads.values(), np.int64, len(heads))[by]
        if (self.head[1:] == self.head[:-1]).any():
            raise ValueError("two beginnings of pieces share a hash")
        self.id_cost = np.zeros(n)
        self.id_cost[list(self.ids.values())] = [self.cost[p] for p in self.ids]

    def prepare(self, text: str) -> str:
        """The processor's own normalisation, blanks as U+2581; the blank it puts first is kept."""
        return self.sp.normalize(text).replace(" ", BLANK) if text else ""

    def merged(self, chunk: str) -> list[str]:
        """The tokenizer's own segmentation: neighbours merge in the order of ranks, leftmost first."""
        rank = self.rank
        parts = list(chunk)
        waiting = [(rank[parts[i] + parts[i + 1]], i, i + 1, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank]
        heapq.heapify(waiting)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        while waiting:
            _, i, j, x, y = heapq.heappop(waiting)
            if parts[i] != x or after[i] != j or parts[j] != y:
                continue
            parts[i], parts[j] = x + y, ""
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if (r := rank.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(waiting, (r, i, k, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := rank.get(parts[h] + parts[i])) is not None:
                heapq.heappush(waiting, (r, h, i, parts[h], parts[i]))
        return [p for p in parts if p]

    def borders(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of the words, each behind a blank and laid end to end: where each begins, and for every character
        whether a piece of the tokenizer's own encoding begins there."""
        size = np.array([len(w) + 1 for w in words], np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        begins = np.zeros(int(at[-1]) + 1, bool)
        width = self.width[np.array([x for i in range(0, len(words), 1000) for x in self.sp.encode(" ".join(words[i : i + 1000]))], np.int64)]
        ends = np.cumsum(width)
        if len(ends) and ends[-1] == at[-1]:
            begins[ends - width] = True
        if not begins[at[:-1]].all():  # the processor would prepare these words once more
            begins[:] = False
            for a, w in zip(at.tolist(), words, strict=False):
                begins[a + np.cumsum([0, *map(len, self.merged(BLANK + w))])[:-1]] = True
        return at[:-1], begins[:-1]

    def lattice(self, chunks: list[str], begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, piece, cost) of every edge of all chunks by end, and each chunk's first node. begins marks
        where pieces of the tokenizer's own segmentation begin; its edges cost nothing. A character that no piece
        covers has an edge of piece -1 - code point."""
        x = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.array([len(c) for c in chunks], np.int64)
        first = np.cumsum(size) - size
        chunk = np.repeat(np.arange(len(chunks)), size)
        stop = (first + size)[chunk]
        marks = np.append(np.flatnonzero(begins), len(x))
        own_end = np.minimum(marks[np.minimum(np.cumsum(begins), len(marks) - 1)], stop)  # where the piece that begins here ends
        live, h = np.arange(len(x)), np.zeros(len(x), np.uint64)
        starts, ends, pieces = [], [], []
        covered = np.zeros(len(x), bool)
        n = 0
        while live.size:
            h = (h + x[live + n].astype(np.uint64) + np.uint64(1)) * _STEP
            n += 1
            k = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
            hit = self.head[k] == h
            live, h, k = live[hit], h[hit], self.head_id[k[hit]]
            piece = k >= 0
            starts.append(live[piece])
            ends.append(live[piece] + n)
            pieces.append(k[piece])
            if n == 1:
                covered[live[piece]] = True
            more = live + n < stop[live]
            live, h = live[more], h[more]
        bare = np.flatnonzero(~covered)
        start, end, piece = np.concatenate([*starts, bare]), np.concatenate([*ends, bare + 1]), np.concatenate([*pieces, -1 - x[bare]])
        code = x[start]
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF) if self.byte else np.ones(len(code), np.int64)
        cost = np.where(piece >= 0, self.id_cost[np.maximum(piece, 0)], FALLBACK * n_bytes)
        cost[begins[start] & (end == own_end[start])] = 0.0
        order = np.argsort(end, kind="stable")  # a few ascending runs
        start, end, piece, cost = start[order], end[order], piece[order], cost[order]
        shift = chunk[start]  # a chunk has one node more than it has characters
        return start + shift, end + shift, piece, cost, first + np.arange(len(chunks))

    def ids_of(self, piece: int) -> list[int]:
        if piece >= 0:
            return [piece]
        return [self.byte[b] for b in chr(-1 - piece).encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def n_best(self, chunks: list[str], begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (chunk, rank; -inf where there are fewer), numbers of ids alike, and all ids in that order."""
        start, end, piece, cost, base = self.lattice(chunks, begins)
        size = np.array([len(c) for c in chunks], np.int64)
        last, nodes = base + size, int(size.sum()) + len(chunks)
        depth = end - np.repeat(base, size + 1)[end]
        order = np.argsort(depth.astype(np.int16 if len(depth) and depth.max() < 1 << 15 else np.int64), kind="stable")
        s, e, c = start[order], end[order], cost[order]
        cut = np.searchsorted(depth[order], np.arange(1, int(size.max(initial=0)) + 2))
        ahead = np.zeros(nodes)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # forward Viterbi, one character on in all chunks
            own = e[a:b]
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            ahead[own[new]] = np.minimum.reduceat(ahead[s[a:b]] + c[a:b], new)
        loss = ahead[start] + cost - ahead[end]
        order = np.lexsort((loss, end))
        loss, start, piece = loss[order], start[order], piece[order]
        first = np.searchsorted(end[order], np.arange(nodes + 1))

        # A*, the queues of all chunks advancing together: every round takes each queue's least entry to a
        # whole segmentation. An entry: chunk, priority, loss so far, edge to take, behind the last edge into
        # the same node, and the pieces that follow, a chain in (piece, next).
        links, behind, n_links = [], [], 0
        some = np.flatnonzero(size > 0)
        queue = [some, np.zeros(len(some)), np.zeros(len(some)), first[last[some]], first[last[some] + 1], np.full(len(some), -1)]
        totals, heads = np.full((len(chunks), n), np.inf), np.full((len(chunks), n), -1)
        for rank in range(n):
            by = np.lexsort((queue[1], queue[0]))
            queue = [x[by] for x in queue]
            place = np.arange(len(by)) - np.searchsorted(queue[0], queue[0])
            chunk, total, done, k, stop, tail = (x[place == 0] for x in queue)
            if not len(chunk):
                break
            rest = (place > 0) & (place < n - rank)  # no more of them can be wanted
            waiting = [[x[rest]] for x in queue]
            at, who = np.arange(len(chunk)), chunk
            totals[chunk, rank] = total
            front = tail.copy()
            while at.size:
                if rank < n - 1:
                    sibling = np.flatnonzero(k + 1 < stop)
                    after, so_far = k[sibling] + 1, done[sibling]
                    for column, x in zip(waiting, (who[sibling], so_far + loss[after], so_far, after, stop[sibling], tail[sibling]), strict=True):
                        column.append(x)
                links.append(piece[k])
                behind.append(tail)
                tail = n_links + np.arange(len(k))
                n_links += len(k)
                front[at] = tail
                j = start[k]
                on = j > base[who]
                at, who, j, tail, total = at[on], who[on], j[on], tail[on], total[on]
                k, stop, done = first[j], first[j + 1], total  # on along the edge without loss
            heads[chunk, rank] = front
            queue = [np.concatenate(x) for x in waiting]

        links, behind = np.concatenate([*links, np.zeros(0, np.int64)]), np.concatenate([*behind, np.zeros(0, np.int64)])
        own, at = np.arange(heads.size), heads.ravel()
        owners, steps, pieces, step = [], [], [], 0
        while len(at):
            owners.append(own[at >= 0])
            at = at[at >= 0]
            own = owners[-1]
            pieces.append(links[at])
            steps.append(np.full(len(at), step))
            at, step = behind[at], step + 1
        owners, pieces = np.concatenate(owners), np.concatenate(pieces)
        order = np.lexsort((np.concatenate(steps), owners))
        owners, pieces = owners[order], pieces[order]
        bare = np.flatnonzero(pieces < 0)
        if bare.size:  # characters in bytes
            spelled = [self.ids_of(x) for x in pieces[bare].tolist()]
            times = np.ones(len(pieces), np.int64)
            times[bare] = [len(x) for x in spelled]
            to = np.cumsum(times) - times
            owners, pieces = np.repeat(owners, times), np.repeat(pieces, times)
            for a, x in zip(to[bare].tolist(), spelled, strict=True):
                pieces[a : a + len(x)] = x
        return -(ahead[last][:, None] + totals), np.bincount(owners, minlength=heads.size).reshape(heads.shape), pieces.astype("<u4")

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes that a piece sequence stands for."""
        size = self.raw_size[ids]
        to = np.cumsum(size, dtype=np.int32 if len(ids) < 1 << 20 else np.int64)
        return self.raw[np.repeat(self.raw_start[ids] - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0, dtype=to.dtype)]


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class ChunkTable:
    """Distinct chunks of a worker: the ids of their segmentations, the best score and the losses of the next.
    Words between blanks are kept with the rows of their chunks, so a known word costs one look-up."""

    def __init__(self, path: str, n: int):
        self.model, self.n = load(path), n
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.uses = np.zeros(0, np.int64)  # of each word
        self.of_word = np.zeros(0, np.int32)  # the words' rows, end to end
        self.word_start, self.word_size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.score = np.zeros(0)
        self.loss = np.zeros((0, self.n - 1))
        self.size = np.zeros((0, self.n), np.int32)
        self.start = np.zeros(0, np.int64)  # of a chunk's first segmentation; the others lie behind it
        self.ids = np.zeros(0, "<u4")

    def trim(self) -> None:
        """Keep the words used most, half the bound at most; words used once always go."""
        least = 2
        while np.count_nonzero(self.uses >= least) > MAX_CHUNKS // 2:
            least *= 2
        kept = self.uses >= least
        self.words = dict(zip(compress(self.words, kept.tolist()), range(len(kept)), strict=False))
        size, old = self.word_size[kept], self.word_start[kept]
        to = np.cumsum(size, dtype=np.int64)
        rows, of_word = np.unique(self.of_word[np.repeat(old - (to - size), size) + np.arange(int(size.sum()))], return_inverse=True)
        self.uses, self.of_word, self.word_start, self.word_size = self.uses[kept] >> 1, of_word.astype(np.int32), to - size, size
        live = np.zeros(len(self.size), bool)
        live[rows] = True
        self.index = dict(zip(compress(self.index, live.tolist()), range(len(rows)), strict=True))
        self.score, self.loss, self.size, old = self.score[rows], self.loss[rows], self.size[rows], self.start[rows]
        size = self.size.sum(1, dtype=np.int64)
        to = np.cumsum(size)
        self.start = to - size
        self.ids = self.ids[np.repeat(old - self.start, size) + np.arange(int(size.sum()))]

    def add(self, chunks: list[str], begins: list[np.ndarray]) -> None:
        """Chunks go in order of length, so that those searched together end together."""
        todo = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
        found = []
        while todo:
            size = np.cumsum([len(chunks[i]) for i in todo[:8000]])
            k = max(1, int(np.searchsorted(size, TOGETHER)))
            some, todo = todo[:k], todo[k:]
            base = len(self.index)
            self.index.update(zip((chunks[i] for i in some), range(base, base + k), strict=False))
            found.append(self.model.n_best([chunks[i] for i in some], np.concatenate([begins[i] for i in some]), self.n))
        score, count, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        self.score = np.concatenate((self.score, score[:, 0]))
        self.loss = np.concatenate((self.loss, score[:, :1] - score[:, 1:]))
        every = count.sum(1)
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(every) - every))
        self.size = np.concatenate((self.size, count.astype(np.int32)))
        self.ids = np.concatenate((self.ids, ids))

    def learn(self, new: list[str], chunks: list[list[str]], begin: list[int], begins: np.ndarray) -> None:
        """Enter words (or loose chunks), each with the chunks that it consists of; word i lies at begin[i] of
        the piece borders `begins`."""
        missing: dict[str, np.ndarray] = {}
        for parts, at in zip(chunks, begin, strict=True):
            for c in parts:
                if c not in self.index and c not in missing:
                    missing[c] = begins[at : at + len(c)]
                at += len(c)
        if missing:
            self.add(list(missing), list(missing.values()))
        base = len(self.word_size)
        self.words.update(zip(new, range(base, base + len(new)), strict=True))
        size = np.array([len(c) for c in chunks], np.int32)
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        self.word_start = np.concatenate((self.word_start, len(self.of_word) + np.cumsum(size, dtype=np.int64) - size))
        self.word_size = np.concatenate((self.word_size, size))
        self.of_word = np.concatenate((self.of_word, np.fromiter(map(self.index.__getitem__, chain.from_iterable(chunks)), np.int32, int(size.sum()))))

    def marks(self, chunk: str) -> np.ndarray:
        out = np.zeros(len(chunk), bool)
        out[np.cumsum([0, *map(len, self.model.merged(chunk))])[:-1]] = True
        return out

    def rows(self, whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of the chunks of prepared texts, laid end to end, and each text's borders in them."""
        if len(self.index) > MAX_CHUNKS or len(self.word_size) > 2 * MAX_CHUNKS:
            self.trim()
        split, words = self.model.border.split, self.words
        plain = [w[:1] == BLANK and w[-1:] != BLANK and BLANK + BLANK not in w for w in whole]
        # A word keeps the line feed before it, if any, else a blank stands there; so a blank before a line feed
        # leaves an empty word. A chunk of a text that has to be cut as a whole stands behind two blanks, which no word holds.
        line = BLANK + "\n" if self.model.lines else "\n"
        parts = [w[1:].replace("\n", line).split(BLANK) if p else [BLANK + BLANK + c for c in split(w)] if w else [] for w, p in zip(whole, plain, strict=True)]
        new = list(set().union(*parts).difference(words))
        if free := [x for x in new if x and x[0] != BLANK]:
            at, begins = self.model.borders(free)
            own = np.array([self.model.lines and x[0] == "\n" for x in free])
            self.learn(free, [[BLANK + x] if x.isalpha() else split(x if o else BLANK + x) for x, o in zip(free, own.tolist(), strict=True)], (at + own).tolist(), begins)
        if loose := [x for x in new if not x or x[0] == BLANK]:
            chunks = [x[2:] or BLANK for x in loose]
            at = np.cumsum([0, *map(len, chunks)])[:-1]
            self.learn(loose, [[x] for x in chunks], at.tolist(), np.concatenate([self.marks(x) for x in chunks]))
        n = np.array([len(t) for t in parts], np.int64)
        at = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        self.uses += np.bincount(at, minlength=len(self.uses))
        size = self.word_size[at]
        to = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        rows = self.of_word[np.repeat(self.word_start[at] - to[:-1], size) + np.arange(int(to[-1]))]
        return rows, to[np.concatenate(([0], np.cumsum(n)))]

    def flat(self, rows: np.ndarray) -> np.ndarray:
        """Ids of the chunks' best segmentations, laid end to end."""
        size = self.size[rows, 0]
        to = np.cumsum(size)
        return self.ids[np.repeat(self.start[rows] - (to - size), size) + np.arange(int(size.sum()))] if len(rows) else self.ids[:0]

    def one(self, row: int, k: int) -> np.ndarray:
        """Ids of a chunk's segmentation k."""
        at = self.start[row] + int(self.size[row, :k].sum())
        return self.ids[at : at + self.size[row, k]]


@lru_cache(maxsize=2)
def table(path: str, n: int) -> ChunkTable:
    return ChunkTable(path, n)


def combinations(losses: list[tuple[int, list[float]]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n cheapest choices of an alternative a position: (loss, ((position, alternative), ...)).

    losses has (position, ascending losses of its alternatives) of the n positions whose first alternative
    is cheapest; a choice that uses another position is dearer than n that do not.
    """
    out: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for p, alternatives in losses:
        out = sorted(out + [(d + x, (*c, (p, k + 1))) for d, c in out for k, x in enumerate(alternatives)])[:n]
    return out


def alternatives(known: ChunkTable, rows: np.ndarray, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n best choices for a text with these chunks."""
    first = known.loss[rows, 0] if n > 1 else np.zeros(0)
    near = np.flatnonzero(np.isfinite(first))
    if len(near) > n - 1:
        near = near[np.lexsort((near, first[near]))[: n - 1]]
    return combinations([(int(i), [x for x in known.loss[rows[i]].tolist() if np.isfinite(x)]) for i in near], n)


def sequences(known: ChunkTable, rows: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """The n best segmentations of a whole text with these chunks: (score, ids), best first."""
    score, best = float(known.score[rows].sum()), known.flat(rows)
    to = np.cumsum(known.size[rows, 0])
    out = []
    for loss, choice in alternatives(known, rows, known.n):
        parts, at = [], 0
        for i, k in sorted(choice):
            parts += [best[at : to[i] - known.size[rows[i], 0]], known.one(rows[i], k)]
            at = to[i]
        out.append((score - loss, np.concatenate([*parts, best[at:]]) if parts else best))
    return out


def encode(text: str, known: ChunkTable) -> list[tuple[float, np.ndarray]]:
    """The n best segmentations of a whole text: (score, ids)."""
    return sequences(known, known.rows([known.model.prepare(text)])[0])


def decode(ids: np.ndarray | list[int], model: PieceModel) -> str:
    """The prepared text of a piece sequence; byte pieces are joined before decoding."""
    return model.bytes_of(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


def decode_text(ids: np.ndarray | list[int], model: PieceModel) -> str:
    """The text itself: blanks as blanks, without the one that the model puts first."""
    whole = decode(ids, model).replace(BLANK, " ")
    return whole[1:] if whole[:1] == " " and model.prepare("x")[:1] == BLANK else whole


N_BEST = pa.list_(pa.struct([("rank", pa.int32()), ("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decodes", pa.bool_())]))
SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, score double, n_found int, last_score double, decodes boolean, restores boolean, n_best array<struct<rank int, score double, n_pieces long, ids_crc32 long, decodes boolean>>"


def n_best_summary(docs: DataFrame, path: str, n: int = 4, with_ids: bool = False) -> DataFrame:
    """Best segmentation of each whole text, the number of segmentations found (n at most), the score of
    the last of them, whether all decode to the prepared text, and whether that gives back the text itself
    (not where the processor's normalisation changes it). n_best has all of them, ranked from 1: every
    sequence is assembled and decoded as a whole. with_ids adds the sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table(path, n)
        m = known.model
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                whole = [m.prepare(t) for t in texts]
                rows, cut = known.rows(whole)
                out, every = [], []
                for i, w in enumerate(whole):
                    found = sequences(known, rows[cut[i] : cut[i + 1]])
                    want = np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8)
                    ranked = [(r, score, len(ids), zlib.crc32(ids.tobytes()), np.array_equal(m.bytes_of(ids), want)) for r, (score, ids) in enumerate(found, 1)]
                    _, score, size, crc, _ = ranked[0]
                    back = w.replace(BLANK, " ")
                    out.append((size, crc, score, len(ranked), ranked[-1][1], all(x[-1] for x in ranked), texts[i] in (back, back[1:]), ranked))
                    if with_ids:
                        every.append([ids.tolist() for _, ids in found])
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), N_BEST), strict=True)]
                names = ["doc_id", "n_pieces", "ids_crc32", "score", "n_found", "last_score", "decodes", "restores", "n_best"]
                lists = [pa.array(every, pa.list_(pa.list_(pa.int64())))] if with_ids else []
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, *lists], names=names + ["segmentations"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + ", segmentations array<array<long>>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n_best_summary(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
