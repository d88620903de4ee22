"""Token counts of whole documents, from counts of distinct pre-tokens.

Each text falls into pre-tokens whose pieces do not depend on their neighbours.

1. Every task reduces its texts to distinct pre-tokens; one aggregation makes them distinct over all documents,
   with their frequency in the corpus.
2. The tokenizer counts the pieces of each distinct pre-token, once. The table of counts is written.
3. Each document's pre-token frequencies are joined to the counts and summed. The most frequent pre-tokens, `head`
   at most, are broadcast (16 bytes each, so 16 MB at most) and joined by position inside the task that reads
   the text; the frequencies of all others, which are rare, travel to the table by an equi-join on the
   pre-token. Nothing is dropped: a table of fewer pre-tokens simply has no others.

Pre-tokens are told apart by 64-bit hashes. Ids are never put together for a document.

Null text: 0 bytes, 0 tokens. Repeated rows and repeated or null ids give one result each; empty tables give no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .textvec import Block, blocks, hash_spans, segment_sum
from .vocab import load, space_chunks

#: A task gives out its distinct pre-tokens when it has so many, and starts anew.
HELD = 500_000


def pretokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the block's pre-tokens."""
    starts, ends = space_chunks(block)
    return starts, ends, hash_spans(block.buf, starts, ends)


def distinct_pretokens(texts: DataFrame) -> DataFrame:
    """key, pretoken, n: all distinct pre-tokens and how often they occur. texts has the column text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, text, count = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], np.zeros(0, np.int64)

        def held() -> pa.RecordBatch:
            keys = np.empty(len(known), np.int64)
            keys[place] = known.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(text, pa.string()), pa.array(count)], names=["key", "pretoken", "n"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                starts, ends, h = pretokens(block)
                if not len(h):
                    continue
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                old = known[at] == h if len(known) else np.zeros(len(h), bool)
                count[place[at[old]]] += n[old]
                new = np.flatnonzero(~old)
                text += [block.text(a, b) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
                both = np.concatenate((known, h[new]))
                order = np.argsort(both, kind="stable")
                known, place = both[order], np.concatenate((place, len(count) + np.arange(len(new))))[order]
                count = np.concatenate((count, n[new]))
                if len(known) > HELD:
                    yield held()
                    known, place, text, count = known[:0], place[:0], [], count[:0]
        yield held()

    return texts.mapInArrow(run, "key long, pretoken string, n long").groupBy("key").agg(F.first("pretoken").alias("pretoken"), F.sum("n").alias("n"))


def with_pieces(found: DataFrame, path: str) -> DataFrame:
    """key, n, pieces: every distinct pre-token counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for batch in batches:
            pieces = [len(e) for a in range(0, len(batch), 1000) for e in t.encode_batch_fast(batch.column(1).slice(a, 1000).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pieces, pa.int32())], names=["key", "n", "pieces"])

    return found.select("key", "pretoken", "n").mapInArrow(run, "key long, n long, pieces int")


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens by the byte-level tokenizer file at path."""
    work = Scratch(docs.sparkSession)
    counted = work.stash(with_pieces(distinct_pretokens(docs.select(F.col(text_col).alias("text"))), path), "pretokens")
    # The frequency from which no more than `head` pre-tokens are, by eighths of powers of two.
    rank = F.floor(F.log2("n") * 8)
    taken, least = 0, None
    for r in counted.groupBy(rank.alias("rank")).count().orderBy(F.desc("rank")).collect():
        taken += r["count"]
        if taken > head:
            break
        least = r["rank"]
    most = counted.where(rank >= least if least is not None else F.lit(False)).select("key", "pieces").toArrow()
    keys, pieces = most["key"].to_numpy(), most["pieces"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    keys, pieces, whole = keys[order], pieces[order], taken <= head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in blocks(batch.column(1)):
                starts, _, h = pretokens(block)
                h, back = np.unique(h.view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                borders = np.searchsorted(starts, block.offs)
                tokens = segment_sum(np.where(hit, pieces[at] if len(keys) else 0, 0)[back], borders)
                # The rest: frequencies by document.
                own = np.flatnonzero(~hit[back])
                pair, n = np.unique((np.searchsorted(borders, own, "right") - 1) * max(len(h), 1) + back[own], return_counts=True)
                cut = np.searchsorted(pair // max(len(h), 1), np.arange(block.n + 1))
                rest = pa.StructArray.from_arrays([pa.array(h[pair % max(len(h), 1)]), pa.array(n)], names=["key", "n"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.n), pa.array(np.diff(block.offs)), pa.array(tokens), pa.array(row + np.arange(block.n)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rest)],
                    names=["doc_id", "n_bytes", "n_tokens", "row", "rest"],
                )
                row += block.n

    joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, row long, rest array<struct<key: long, n: long>>")
    if whole:  # every pre-token was broadcast
        work.close()
        return joined.select("doc_id", "n_bytes", "n_tokens")
    joined = work.stash(joined, "counted", keep=True)
    rare = joined.where("size(rest) > 0").select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.n")
    more = rare.join(counted.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    more = work.stash(more, "rare", keep=True)
    work.close()
    return joined.drop("rest").join(more, "row", "left").select("doc_id", "n_bytes", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", counts["n_tokens"] > limit)
