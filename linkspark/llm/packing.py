"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps at most `open_windows` open windows. A document first fills whole sequences; its
rest goes to the open window that it fits best. If it fits none and no further window may be opened,
the fullest window takes as much of it as it holds and is emitted full. At the end of a partition the
open windows are merged: their pieces are laid end to end, full sequences are emitted, and what is
left (less than one sequence) meets the rests of up to `merge_width` partitions. The last rest of such a
group is cut into sequences whose lengths are powers of two, which need no padding.

Null text: empty, so the document is the end id alone. Equal rows and equal ids are packed as they come;
an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stash
from .textvec import blocks
from .vocab import WordTable, table, word_chunks

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Packer:
    """pieces are (doc_id, start, ids, doc_tokens); emit() takes a finished window's pieces."""

    def __init__(self, length: int, open_windows: int, base: int):
        self.length, self.limit, self.next = length, open_windows, base
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        whole = len(ids) // self.length * self.length
        for a in range(0, whole, self.length):
            self.emit([(doc, start + a, ids[a : a + self.length], total)])
        start, ids = start + whole, ids[whole:]
        while len(ids):
            k = bisect_left(self.free, (len(ids), -1))
            if k < len(self.free):  # best fit
                free, w = self.free.pop(k)
                take = len(ids)
            elif len(self.open) < self.limit:
                w = max(self.open, default=-1) + 1
                free, take = self.length, len(ids)
                self.open[w] = []
            else:  # none fits: the fullest is filled up and goes
                free, w = self.free.pop(0)
                take = free
            self.open[w].append((doc, start, ids[:take], total))
            if take == free:
                self.emit(self.open.pop(w))
            else:
                insort(self.free, (free - take, w))
            start, ids = start + take, ids[take:]

    def merge(self) -> list:
        """Pieces of the open windows laid end to end; full sequences go, the rest is returned."""
        pending, size = [], 0
        for w in [w for _, w in self.free]:
            for doc, start, ids, total in self.open[w]:
                while len(ids):
                    cut = ids[: self.length - size]
                    pending.append((doc, start, cut, total))
                    size, start, ids = size + len(cut), start + len(cut), ids[len(cut) :]
                    if size == self.length:
                        self.emit(pending)
                        pending, size = [], 0
        self.free, self.open = [], {}
        return pending

    def finish(self, rest: list) -> None:
        """The rest in sequences of lengths that are powers of two, longest first."""
        left = sum(len(p[2]) for p in rest)
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                room, part = 1 << bit, []
                while room:
                    doc, start, ids, total = rest[0]
                    part.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        rest[0] = (doc, start + room, ids[room:], total)
                    else:
                        rest = rest[1:]
                    room -= len(part[-1][2])
                self.emit(part)

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_TYPES)


def document_ids(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, borders, ids) of each block: the library's ids of every text, then end_id."""
    known = table(WordTable, path)
    for block in blocks(column):
        starts, ends = word_chunks(block)
        rows = known.look_up(block, starts, ends) if len(starts) else np.zeros(0, np.int64)
        size = known.length[rows]
        to = np.cumsum(size)
        flat = known.ids[np.repeat(known.start[rows] - (to - size), size) + np.arange(int(size.sum()))] if len(rows) else np.zeros(0, np.uint32)
        borders = np.concatenate(([0], to))[np.searchsorted(starts, block.offs)]
        out = np.insert(flat, borders[1:], end_id).astype("<u4")
        yield block.lo, borders + np.arange(block.n + 1), out


def pack(docs: DataFrame, path: str, end_id: int, length: int = 2048, open_windows: int = 64, merge_width: int = 64) -> DataFrame:
    """One row a piece; sequence ids are unique, offsets gapless."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        packer = Packer(length, open_windows, pid << 32)
        wrap = lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.binary()), pa.nulls(len(b), pa.int64())], names=[*_TYPES.names, "ids", "part"])
        for batch in batches:
            doc = batch.column(0).to_pylist()
            for lo, borders, ids in document_ids(batch.column(1), path, end_id):
                for i in range(len(borders) - 1):
                    packer.add(doc[lo + i], ids[borders[i] : borders[i + 1]])
                packer.open = {w: [(d, s, x.copy() if x.base is not None else x, t) for d, s, x, t in p] for w, p in packer.open.items()}
                yield wrap(packer.flush())
        rest = packer.merge()
        yield wrap(packer.flush())
        if rest:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rest], pa.int64()), pa.array([r[1] for r in rest], pa.int64()), pa.array([len(r[2]) for r in rest], pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array([r[3] for r in rest], pa.int64()), pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array([r[2].tobytes() for r in rest], pa.binary()), pa.array([pid] * len(rest), pa.int64())],
                names=[*_TYPES.names, "ids", "part"],
            )

    def last(key: tuple, t: pa.Table) -> pa.Table:
        packer = Packer(length, 1 << 30, (1 << 60) + (key[0].as_py() << 32))
        rows = sorted(t.select(["part", "doc_id", "start", "ids", "doc_tokens"]).to_pylist(), key=lambda r: (r["part"], r["doc_id"] is None, r["doc_id"], r["start"]))
        for i, r in enumerate(rows):
            packer.open[i] = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])]
            packer.free.append((0, i))
        packer.finish(packer.merge())
        return pa.Table.from_batches([packer.flush()])

    done = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, PIECE + ", ids binary, part long"), "packed")
    names = _TYPES.names
    rest = done.where("part is not null").withColumn("merge_group", F.expr(f"part div {merge_width}"))
    merged = rest.groupBy("merge_group").applyInArrow(last, PIECE)
    return done.where("part is null").select(*names).unionByName(merged)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
