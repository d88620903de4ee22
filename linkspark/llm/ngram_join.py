"""Exact Jaccard self-join on five-word shingle sets, by universe partitioning and the pigeonhole principle.

Two sets of sizes a <= b with 100*|A n B| >= 75*|A u B| differ in at most (a+b)/7 <= a/3 tokens. Sizes fall
into bands. Each band cuts the universe of hashed shingles into its own segments; a set meets a segment in
a subset, and if two sets differ in at most D tokens then at most D of their subsets differ. So with
H = a//3 the H+1 cheapest non-empty subsets of either set, under one global order, must have one in common;
these are its signatures. A set also enters the next lower band if a partner may lie there.

* Cost-based allocation. The order of the subsets is their cost: subsets of shingles that no partition
  found frequent come first, larger subsets before smaller, then frequent ones by frequency. Frequencies
  come from a pass over all documents whose summaries have a fixed bound; they steer cost only, never
  which links are found.
* One-deletion neighbourhoods. Where the bound is a single difference (3 to 5 shingles) one segment is
  enough: the whole set and each set with one token removed are indexed. For larger bounds a deletion
  neighbourhood buys two units of the pigeonhole sum for 1 + c signatures (c tokens in the subset) against
  two exact subsets for 2, so the allocation takes exact subsets.
* A band whose segments are too few for one of its sets (fewer than H+1 of its subsets are non-empty,
  checked for every document) uses single tokens as its segments instead, where that cannot happen.

Candidates are verified on the whole sets, so links are exact up to equality of 64-bit hashes. Before the
sets travel, pairs are dropped whose histograms over the universe already differ by more than the bound: the
sum of differences of counts never exceeds the number of differing tokens. A histogram has eight bins or more
a token up to FINE bins, and two or more beyond, of half a byte each: with fewer bins differences cancel and far
more pairs pass. Identical
sets are one node throughout; their copies are never paired. A bucket of up to `pair_limit` different
sets gives all its pairs. A larger one first gives stars, each round with another centre; after those links
are known, its members that are still in different components are compared pair by pair inside the task
that holds them, in blocks of bounded size, and only pairs that pass size and histogram go on. Buckets of the
same members count once. That last step is quadratic in the members of a bucket that do not link, so it is
the allocation's task to keep such buckets small.

No key gathers a group in one task. Signatures whose shingles are all found in SPLIT_FROM texts or more are dealt
by document, not by signature, and their buckets go straight to the stars; members of large buckets are
dealt by bucket and part (`parts` of about BLOCK members), and what is known of a bucket is sent to each part.

Nulls and texts without words have the empty set and link with nothing. Rows with equal doc_id count as
one node for each different text, and so do rows with a null doc_id. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, joined
from .scratch import Scratch
from .textvec import blocks, mix, segment_sum, shingle_sets

_U = np.uint64
#: First sizes of the bands; below 3 only identical sets link.
BANDS = np.array([3, 6] + [12 << i for i in range(40)], np.int64)
#: Bands that begin lower have single tokens as segments.
SEGMENTED_FROM = 96
#: Largest and smallest number of bins of a histogram; counts are held at 15.
SKETCH, FINE, LEAST_SKETCH = 4096, 1024, 16
#: Signatures of shingles that so many texts share are dealt by document, in buckets of SPLIT parts.
SPLIT_FROM, SPLIT = 1_000_000, 512
#: Members of one part of a large bucket.
BLOCK = 1500
#: Documents to verify up to which a Bloom filter of 16 bits each picks them (32 MB at most); beyond, a join does.
BLOOM_MOST = 1 << 24


def content_ids(borders: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, independent of order; the empty set gets 0."""
    n = np.diff(borders)
    c = mix(segment_sum(mix(h ^ _U(0xD6E8FEB86659FD93)), borders) + n.astype(_U) * _U(0x9E3779B97F4A7C15))
    return np.where(n > 0, c | _U(1), _U(0))


def segments_of(band: int, single: frozenset[int]) -> int:
    """Number of segments of a band; 0 stands for single tokens."""
    low = int(BANDS[band])
    return 0 if low < SEGMENTED_FROM or band in single else low * 3 // 2


def subsets(band: int, segments: int, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, content hash, size, first token, token order) of the non-empty subsets, grouped by row."""
    salt = _U(0x632BE59BD9B4E019 * (band + 1) & (1 << 64) - 1)
    x = mix(h ^ salt)
    if not segments:
        return row, x, np.ones(len(x), np.int64), np.arange(len(x)), np.arange(len(x))
    key = row.astype(np.int64) * segments + (x % _U(segments)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    content = np.add.reduceat(mix(x[order]), first) if len(first) else np.zeros(0, _U)
    return key[first] // segments, mix(content + (key[first] % segments).astype(_U) + salt), size, first, order


class Hot:
    """Frequencies of the shingles that were found frequent; 0 for all others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> _U(44)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.seen[(h >> _U(44)).astype(np.int64)])
        if maybe.size:
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == h[maybe], self.counts[at], 0)
        return out


def signatures(borders: np.ndarray, h: np.ndarray, hot: Hot, single: frozenset[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, how many texts share its rarest shingle, as far as known) of all rows of a block."""
    n = np.diff(borders)
    own = np.searchsorted(BANDS, n, "right") - 1
    rows, sigs, heats = [], [], []
    for band in range(int(own.max(initial=-1)) + 1):
        top = int(BANDS[band + 1])
        here = own == band
        above = (own == band + 1) & ((3 * n + 3) // 4 < top)
        take = np.flatnonzero(here | above)
        if not take.size:
            continue
        size = n[take]
        local = np.repeat(np.arange(len(take)), size)
        at = np.repeat(borders[take] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        tokens = h[at]
        if band == 0:  # one difference: the whole set, and each set less one token
            x = mix(tokens ^ _U(0xA24BAED4963EE407))
            whole = segment_sum(x, np.concatenate(([0], np.cumsum(size))))
            rows += [take, take[local]]
            sigs += [mix(whole), mix(whole[local] - x)]
            heat, from_ = hot.of(tokens), np.concatenate(([0], np.cumsum(size)[:-1]))
            least = np.minimum.reduceat(heat, from_)
            others = heat.copy()  # without one token of the least, the least is the next
            others[np.unique(np.where(heat == least[local], local, -1), return_index=True)[1][-len(take) :]] = 1 << 62
            lone = (heat == least[local]) & (np.bincount(local, heat == least[local])[local] == 1)
            heats += [least, np.where(lone, np.minimum.reduceat(others, from_)[local], least[local])]
            continue
        own_row, content, width, first, order = subsets(band, segments_of(band, single), local, tokens)
        heat = hot.of(tokens)[order]
        cost = np.minimum.reduceat(heat, first) if len(first) != len(order) else heat
        quota = np.where(here[take], size // 3 + 1, (top - 1) // 3 + 1)
        pick = np.lexsort((content, -width, cost, own_row))
        own_row = own_row[pick]
        start = np.searchsorted(own_row, np.arange(len(take)))
        keep = np.arange(len(pick)) - start[own_row] < quota[own_row]
        rows.append(take[own_row[keep]])
        sigs.append(content[pick[keep]])
        heats.append(cost[pick[keep]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(heats)


def short_of_segments(borders: np.ndarray, h: np.ndarray) -> set[int]:
    """Bands in which some row of the block has too few non-empty subsets."""
    n = np.diff(borders)
    own = np.searchsorted(BANDS, n, "right") - 1
    out = set()
    for band in np.unique(own[own >= 0]).tolist():
        if segments := segments_of(band, frozenset()):
            take = np.flatnonzero(own == band)
            local = np.repeat(np.arange(len(take)), n[take])
            at = np.concatenate([np.arange(borders[i], borders[i + 1]) for i in take])
            row = subsets(band, segments, local, h[at])[0]
            if (np.bincount(row, minlength=len(take)) < n[take] // 3 + 1).any():
                out.add(band)
    return out


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sketches(borders: np.ndarray, h: np.ndarray) -> list[bytes]:
    """Counts of each row's tokens by the leading bits of their hashes, two to a byte; sums and differences of
    counts that are held at 15 stay lower bounds."""
    n = np.maximum(np.diff(borders), 1)
    bits = np.ceil(np.log2(np.clip(np.maximum(2 * n, np.minimum(8 * n, FINE)), LEAST_SKETCH, SKETCH))).astype(int)
    out = []
    for a, b, k in zip(borders[:-1].tolist(), borders[1:].tolist(), bits.tolist(), strict=True):
        n = np.minimum(np.bincount((h[a:b] >> _U(64 - k)).astype(np.int64), minlength=1 << k), 15).astype(np.uint8)
        out.append((n[::2] | n[1::2] << 4).tobytes())
    return out


def folded(sketch: list[bytes], bins: int) -> np.ndarray:
    """Histograms of one size, brought to `bins` by adding neighbours."""
    raw = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(sketch), -1)
    return np.stack((raw & 15, raw >> 4), axis=2).reshape(len(sketch), bins, -1).sum(2, dtype=np.int16)


def gaps(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Sum of differences of each pair of histograms, at the coarser one's bins."""
    size = 2 * np.array([list(map(len, one)), list(map(len, two))], np.int64).reshape(2, -1)
    out = np.zeros(size.shape[1], np.int64)
    for a, b in np.unique(size, axis=1).T.tolist():
        at = np.flatnonzero((size[0] == a) & (size[1] == b))
        for i in range(0, len(at), 4000):
            some, bins = at[i : i + 4000], min(a, b)
            out[some] = np.abs(folded([one[k] for k in some], bins) - folded([two[k] for k in some], bins)).sum(1, dtype=np.int64)
    return out


class Fresh:
    """Which rows of a block hold a set that this task has not met before."""

    def __init__(self):
        self.seen: set[int] = set()

    def of(self, cids: np.ndarray) -> np.ndarray:
        new = np.zeros(len(cids), bool)
        for i, x in enumerate(cids.tolist()):
            if x not in self.seen:
                self.seen.add(x)
                new[i] = True
        return new


def frequent_shingles(docs: DataFrame, work: Scratch, k: int, share: float = 0.001, most: int = 131_072, summary: int = 500_000) -> tuple[Hot, frozenset[int]]:
    """Shingles that at least `share` of a partition's different texts have, up to `most` of them by count,
    and the bands that need single tokens. A partition keeps at most `summary` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total, bands, fresh = np.zeros(0, _U), np.zeros(0, np.int64), 0, set(), Fresh()
        for batch in batches:
            for block in blocks(batch.column(0)):
                borders, h = shingle_sets(block, k)
                bands |= short_of_segments(borders, h)
                new = fresh.of(content_ids(borders, h))
                total += int(new.sum())
                x, c = np.unique(h[np.repeat(new, np.diff(borders))], return_counts=True)
                often = c > 1
                both = np.concatenate((keys, x[often]))
                keys, back = np.unique(both, return_inverse=True)
                counts = np.bincount(back, np.concatenate((counts, c[often])), len(keys)).astype(np.int64)
                if len(keys) > summary:
                    best = np.sort(np.argpartition(counts, -summary // 2)[-summary // 2 :])
                    keys, counts = keys[best], counts[best]
        keep = counts >= max(4, share * total)
        yield pa.RecordBatch.from_arrays([_i64(keys[keep]), pa.array(counts[keep]), pa.nulls(int(keep.sum()), pa.int32())], names=["shingle", "n", "band"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(bands), pa.int64()), pa.nulls(len(bands), pa.int64()), pa.array(sorted(bands), pa.int32())], names=["shingle", "n", "band"])

    found = work.stash(docs.select("text").mapInArrow(run, "shingle long, n long, band int"), "frequent")
    top = found.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(most).toPandas()
    single = frozenset(r[0] for r in found.where("band is not null").select("band").distinct().collect())
    return Hot(top["shingle"].to_numpy(np.int64).view(_U), top["n"].to_numpy(np.int64)), single


def candidate_rows(docs: DataFrame, k: int, hot: Hot, single: frozenset[int], pair_limit: int) -> DataFrame:
    """a, b, parts: candidate pairs of content ids (no parts), or (bucket, content id) of large buckets.

    Signatures travel as packed arrays, one row a batch and part, so no row is made for a signature. Within a
    part 32 bits tell them apart: a chance collision adds a candidate, which verification drops.
    """
    spark = docs.sparkSession
    n_shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * n_shuffle

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for batch in batches:
            sig, cid, heat = [np.zeros(0, _U)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
            for block in blocks(batch.column(0)):
                borders, h = shingle_sets(block, k)
                c = content_ids(borders, h)
                new = fresh.of(c)
                n = np.diff(borders)
                h = h[np.repeat(new, n)]
                row, s, f = signatures(np.concatenate(([0], np.cumsum(n * new))), h, hot, single)
                sig.append(s)
                cid.append(c[row])
                heat.append(f)
            s, c, split = np.concatenate(sig), np.concatenate(cid), np.concatenate(heat) >= SPLIT_FROM
            # Parts from `parts` on hold signatures that are dealt by document.
            part = np.where(split, parts + (mix(c) % _U(parts)).astype(np.int64), (mix(s) % _U(parts)).astype(np.int64))
            order = np.argsort(part, kind="stable")
            s, c, cut = s[order], c[order], np.searchsorted(part[order], np.arange(2 * parts + 1))
            full = np.flatnonzero(np.diff(cut))
            short = [(s[cut[p] : cut[p + 1]] if p >= parts else s[cut[p] : cut[p + 1]].astype("<u4")).tobytes() for p in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([c[cut[p] : cut[p + 1]].tobytes() + x for p, x in zip(full, short, strict=True)], pa.binary())], names=["part", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, cids, splits = [], [], []
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                n = len(x) // (16 if p >= parts else 12)
                cids.append(x[: 8 * n].view(_U).copy())
                sigs.append(x[8 * n :].view(_U).copy() if p >= parts else x[8 * n :].view("<u4").astype(_U) | _U(p << 32))
                splits.append(np.full(n, p >= parts))
        if not sigs:
            return
        s, c, split = np.concatenate(sigs), np.concatenate(cids), np.concatenate(splits)
        del sigs, cids, splits
        order = np.lexsort((c, s, split))
        s, c, split = s[order], c[order], split[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (split[1:] != split[:-1])
        s, c, split = s[new], c[new], split[new]
        first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (split[1:] != split[:-1]))))
        size = np.diff(np.append(first, len(s)))
        split = split[first]
        pairs = []
        small = (size > 1) & (size <= pair_limit) & ~split
        small = first[small], size[small]
        for i in range(pair_limit):
            for j in range(i + 1, pair_limit):
                f = small[0][small[1] > j]
                pairs.append(np.stack((c[f + i], c[f + j])))
        large = (size > pair_limit) | split
        f, n, split = first[large], size[large], split[large]
        who, n_parts = s[f], np.where(split, SPLIT, -(-n // BLOCK))
        if len(f):  # buckets of the same members count once, where all members are here
            ends = np.stack((f, f + n), 1).ravel()
            same = np.add.reduceat(np.append(mix(c), _U(0)), ends)[::2] + n.astype(_U)
            who = np.where(split, mix(who ^ _U(0x94D049BB133111EB)), same)
            who, keep = np.unique(who, return_index=True)
            f, n, n_parts = f[keep], n[keep], n_parts[keep]
        at = np.repeat(f - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        lead = np.repeat(c[f], n)
        pairs.append(np.stack((lead, c[at]))[:, c[at] != lead])
        a, b = np.concatenate(pairs, axis=1)
        a, b = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        for x, y, z in ((a, b, None), (np.repeat(who, n).view(np.int64), c[at].view(np.int64), np.repeat(n_parts, n))):
            for i in range(0, len(x), 100_000):
                some = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[some]), pa.array(y[some]), pa.nulls(len(x[some]), pa.int64()) if z is None else pa.array(z[some])], names=["a", "b", "parts"])

    packed = docs.select("text").mapInArrow(emit, "part long, packed binary")
    return packed.repartition(n_shuffle, "part").mapInArrow(meet, "a long, b long, parts long")


def may_link(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose sizes and histograms allow a link."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = gaps(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield batch.select([0, 1]).filter(pa.array(7 * gap <= batch.column(4).to_numpy()))

    one = reps.select(F.col("cid").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("m"))
    two = reps.select(F.col("cid").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("n"))
    near = pairs.join(one, "a").join(two, "b").where("4 * least(m, n) >= 3 * greatest(m, n)")
    return near.select("a", "b", "x", "y", (F.col("m") + F.col("n")).alias("size")).mapInArrow(close, "a long, b long")


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, work: Scratch, k: int) -> DataFrame:
    """The pairs (a, b) of content ids whose sets are alike enough."""
    pairs = work.stash(may_link(pairs, reps), "may-link")
    need = work.stash(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(reps.select("cid", "doc_id"), "cid"), "needed")
    count = need.count()
    bits = 1 << max(10, (16 * min(count, BLOOM_MOST)).bit_length())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    bloom = np.zeros(bits // 64, np.int64)
    if count <= BLOOM_MOST:
        words = need.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toPandas()
        bloom[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    else:  # too many for a filter: the wanted rows are found by a join
        bloom[:] = -1
        wanted = need.select(F.col("doc_id").alias("wanted")).distinct()
        docs = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bloom.view(_U)[p >> 6] >> (p & 63).astype(_U) & _U(1)).astype(bool)))
            for block in blocks(batch.column(1)):
                borders, h = shingle_sets(block, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.n), _i64(content_ids(borders, h)), pa.array([h[borders[i] : borders[i + 1]].tobytes() for i in range(block.n)], pa.binary())], names=["doc_id", "cid", "shingles"]
                )

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                    both = np.sort(np.concatenate((x, y)), kind="stable")
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok[i] = 100 * same >= 75 * (len(x) + len(y) - same)
            yield batch.select([0, 1]).filter(pa.array(ok))

    made = docs.select("doc_id", "text", place.alias("p")).mapInArrow(sets, "doc_id long, cid long, shingles binary")
    # Not an equality: the join stays partitioned by cid alone, as what follows needs it.
    chosen = need.select("cid", F.col("doc_id").alias("rep"))
    made = made.join(chosen, "cid").where("coalesce(not (doc_id < rep or doc_id > rep), doc_id is null and rep is null)").dropDuplicates(["cid"]).select("cid", "shingles")
    x = pairs.join(made.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
    both = x.join(made.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
    links = work.stash(both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "links")
    return links


def apart(buckets: DataFrame, group: DataFrame, work: Scratch, turn: int) -> DataFrame:
    """bucket, part, cid, component, lead, n, n_parts of the buckets whose members are in different components:
    lead is a member (cid, component) that changes with turn, n the number of members.

    What is known of a bucket goes to each of its parts, so members meet it by bucket and part.
    """
    member = buckets.join(group.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    member = work.stash(member.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("parts"))), "members")
    known = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.max("parts").alias("n_parts"), F.min_by(F.struct("cid", "component"), F.xxhash64("cid", F.lit(turn))).alias("lead"))
    known = known.where("lo <> hi").select("bucket", "n", "n_parts", "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("part"))
    left = work.stash(member.drop("parts").join(known, ["bucket", "part"]), "apart")
    return left


def blockwise(left: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's members in different components that size and histogram allow.

    Members in the component of the bucket's lead need no comparison with one another. So a bucket of more
    than a block of members is cut into parts of those and parts of all others, and only the others' parts meet
    every part, two in a task of their own: the work is others x members, not the square of the group.
    """

    names = ["bucket", "i", "j", "cid", "n_shingles", "component", "part", "sketch"]

    def compare(t: pa.Table, found: set[tuple[int, int]]) -> None:
        cid, n, comp, part = (t[c].to_numpy() for c in ("cid", "n_shingles", "component", "part"))
        order = np.argsort(n, kind="stable")
        cid, n, comp, part = cid[order], n[order], comp[order], part[order]
        sketch = t["sketch"].to_pylist()
        sketch = [sketch[i] for i in order]
        two = t["i"][0].as_py() != t["j"][0].as_py()
        # Neighbours in size share a number of bins; views holds the bucket at each such number.
        bins = 2 * np.array(list(map(len, sketch)))
        views = {}
        for b in np.unique(bins).tolist():
            from_ = int(np.searchsorted(bins, b))
            fold = np.concatenate([folded([sketch[i] for i in np.flatnonzero(bins == x).tolist()], b) for x in (b, 2 * b) if (bins == x).any()])
            views[b] = from_, fold, fold.reshape(len(fold), -1, max(1, b // 64)).sum(2)
        for x in range(len(cid)):
            from_, fine, rough = views[int(bins[x])]
            y = np.arange(x + 1, int(np.searchsorted(n, n[x] * 4 // 3, "right")))
            y = y[(comp[y] != comp[x]) & ((part[y] != part[x]) | (not two))]
            for view in (rough, fine):
                if len(y):
                    y = y[7 * np.abs(view[y - from_] - view[x - from_]).sum(1, dtype=np.int64) <= n[x] + n[y]]
            found.update((min(a, b), max(a, b)) for a, b in zip([int(cid[x])] * len(y), cid[y].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after the other; a pair that many of a task's groups hold is given once."""
        found: set[tuple[int, int]] = set()
        rest: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest.append(batch)
            t = pa.Table.from_batches(rest) if rest else None
            if t is None or not len(t):
                continue
            key = np.stack([t[c].to_numpy() for c in names[:3]])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            cut = np.concatenate(([0], cut, [len(t)] if batch is None else []))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                compare(t.slice(int(a), int(b - a)), found)
            rest = t.slice(int(cut[-1])).combine_chunks().to_batches() if cut[-1] < len(t) else []
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    other = F.col("component") != F.col("lead.component")
    sizes = left.groupBy("bucket").agg(F.count_if(other).alias("n_other"), F.max("n_parts").alias("n_parts"))
    sizes = sizes.select("bucket", "n_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)).alias("part"))
    whole, at = F.col("n") <= BLOCK, F.xxhash64("cid", F.lit(11))
    others, rest = F.ceil(F.col("n_other") / BLOCK), F.ceil((F.col("n") - F.col("n_other")) / BLOCK)
    # Parts of the others count from 0, those of the lead's component from -1 downwards.
    place = F.when(whole, F.lit(0).cast("long")).when(other, F.pmod(at, others)).otherwise(-1 - F.pmod(at, rest))
    upward = F.sequence(F.lit(0).cast("long"), F.greatest(others, F.lit(1).cast("long")) - 1)
    downward = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(rest, F.lit(1).cast("long"))), lambda x: -x)
    meets = F.when(whole, F.array(F.lit(0).cast("long"))).when(other, F.concat(upward, downward)).otherwise(upward)
    placed = left.join(sizes, ["bucket", "part"]).select("bucket", "cid", "component", place.alias("part"), F.explode(meets).alias("q"))
    first = F.when((F.col("part") >= 0) & (F.col("q") >= 0), F.least("part", "q")).otherwise(F.greatest("part", "q"))
    second = F.when((F.col("part") >= 0) & (F.col("q") >= 0), F.greatest("part", "q")).otherwise(F.least("part", "q"))
    met = placed.select("bucket", "cid", "component", "part", first.alias("i"), second.alias("j")).join(reps.select("cid", "n_shingles", "sketch"), "cid")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, *names[:3]).sortWithinPartitions(*names[:3]).select(*names)
    return met.mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, work: Scratch, k: int = 5, pair_limit: int = 6, star_rounds: int = 2, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cid, key of every row; cid, component, doc_id, key of every set but the empty
    one). key is the text's hash; a set has the smallest doc_id of its rows, null only if all are null. The first
    stays when `work` is closed if keep."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for batch in batches:
            for block in blocks(batch.column(1)):
                borders, h = shingle_sets(block, k)
                c = content_ids(borders, h)
                new = fresh.of(c)  # a task's copies of a set need its histogram once
                sketch = iter(sketches(np.concatenate(([0], np.cumsum(np.diff(borders)[new]))), h[np.repeat(new, np.diff(borders))]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(np.diff(borders).astype(np.int64)), _i64(c), pa.array([next(sketch) if x else None for x in new], pa.binary()), batch.column(2).slice(block.lo, block.n)], names=["doc_id", "n_shingles", "cid", "sketch", "key"])

    described = work.stash(docs.mapInArrow(describe, "doc_id long, n_shingles long, cid long, sketch binary, key long"), "described", keep)
    docs = docs.select("doc_id", "text")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("least")
    reps = described.where("cid <> 0").groupBy("cid").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("sketch", ignorenulls=True).alias("sketch"))
    reps = work.stash(reps.select("cid", "least.doc_id", "n_shingles", "sketch", "least.key"), "representatives")
    hot, single = frequent_shingles(docs, work, k)
    found = work.stash(candidate_rows(docs, k, hot, single, pair_limit), "candidates")
    pairs = work.stash(found.where("parts is null").select("a", "b").distinct(), "pairs")
    buckets = work.stash(found.where("parts is not null").select(F.col("a").alias("bucket"), F.col("b").alias("cid"), "parts").distinct(), "buckets")
    work.discard(found)
    group = components(verify(docs, reps, pairs, work, k).select(F.col("a").alias("u"), F.col("b").alias("v")), work)
    for turn in range(star_rounds + 1):
        left = apart(buckets, group, work, turn)
        if not left.take(1):
            break
        if turn < star_rounds:
            star = left.where("component <> lead.component")
            again = star.select(F.least("cid", "lead.cid").alias("a"), F.greatest("cid", "lead.cid").alias("b")).distinct()
        else:
            again = blockwise(left, reps)
        again = work.stash(again.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        if again.take(1):
            group = joined(group, verify(docs, reps, again, work, k), work)
            pairs = pairs.unionByName(again)
    named = reps.join(group.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    return described, named.select("cid", "component", "doc_id", "key")


def near_duplicates(docs: DataFrame, k: int = 5, pair_limit: int = 6, star_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    work = Scratch(docs.sparkSession)
    described, named = grouped(docs, work, k, pair_limit, star_rounds, keep=True)
    # Components so far are named by content ids; rename them by their smallest document.
    name = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = work.stash(named.join(name, "component").select("cid", "component_id"), "named", keep=True)
    work.close()
    return described.join(of, "cid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def text_key() -> Column:
    return F.xxhash64("text")


def one_of_each(docs: DataFrame) -> DataFrame:
    """doc_id, key, n: of each component the row of smallest doc_id (null only where all are null), then smallest
    set and text hash; n is how many rows of docs have both. Rows with a doc_id but without words are each
    a component of their own; rows without either are left to the caller."""
    work = Scratch(docs.sparkSession)
    described, named = grouped(docs, work)
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "cid", "key")).alias("first")).select("first.doc_id", "first.key")
    alone = described.where("cid = 0 and doc_id is not null").select("doc_id", "key").distinct()
    rows = described.where("cid <> 0 or doc_id is not null").groupBy(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key")).agg(F.count("*").alias("n"))
    keep = first.unionByName(alone)
    keep = work.stash(keep.join(rows, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "n"), "keep", keep=True)
    work.close()
    return keep


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
