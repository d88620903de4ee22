"""Nearest neighbours by hierarchical navigable small-world graphs, one a shard.

Vectors are dealt to shards by a hash of their id, `shard_size` to a shard on average, so the number of
shards follows the table. A shard's index is built in one task and stored as flat arrays (vectors, ids,
neighbour lists of every layer) in one row of a table. Queries come in packed blocks. Every block has to meet
every shard: blocks are dealt to lanes of `lane_blocks`, a lane and a shard meet in one cogrouped task
(keys shard, dimension, lane), which so holds one shard and one lane, and the shard results are merged by score,
ties by id. Scores are Euclidean distances in double precision on the original vectors.

Equal vectors of a shard are one node of its graph with all their ids, so any number of copies of one
vector neither breaks the graph nor fills the result list unseen. Recall is measured in the tests and
named in the README. Vectors that are null, of no dimension, zero, or hold null or non-finite
components take no part; only vectors of a query's own dimension are its candidates (the shard is split
by dimension). Repeated ids are separate candidates, except the query's own id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import stash


class Graph:
    """A small-world graph over the rows of x (float64). near[l] holds the neighbour lists of layer l as one
    flat array of `width` columns, -1 where a list is shorter."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray], entry: int):
        self.x, self.near, self.entry = x, near, entry
        self.norm = np.einsum("ij,ij->i", x, x)

    @classmethod
    def build(cls, x: np.ndarray, m: int = 12, effort: int = 64, seed: int = 5) -> Graph:
        r = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - r.random(len(x))) / np.log(m)).astype(int), 8)
        near = [np.full((len(x), 2 * m if layer == 0 else m), -1, np.int32) for layer in range(int(level.max(initial=0)) + 1)]
        g = cls(x, near, 0)
        top = int(level[0])
        for i in range(1, len(x)):
            q, at = x[i], [(g.distance(x[i], np.array([g.entry]))[0], g.entry)]
            for layer in range(top, -1, -1):
                if layer > level[i]:
                    at = g.search_layer(q, at, 1, layer)
                    continue
                at = g.search_layer(q, at, effort, layer)
                chosen = g.spread(at, m)
                near[layer][i, : len(chosen)] = chosen
                for j in chosen:
                    g.link(j, i, layer)
            if level[i] > top:
                top, g.entry = int(level[i]), i
        return g

    def distance(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared, up to rounding; order only."""
        return self.norm[rows] - 2.0 * (self.x[rows] @ q) + q @ q

    def spread(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Up to m of the found, nearest first, leaving out those nearer to a chosen one than to the centre;
        those fill up what remains."""
        found = sorted(found)[: 3 * m]
        ids = np.array([i for _, i in found])
        v = self.x[ids]
        between = self.norm[ids][:, None] + self.norm[ids][None, :] - 2.0 * (v @ v.T)
        chosen: list[int] = []
        for k, (d, _) in enumerate(found):
            if len(chosen) < m and (not chosen or between[k, chosen].min() >= d):
                chosen.append(k)
        rest = [k for k in range(len(found)) if k not in set(chosen)]
        return [int(ids[k]) for k in chosen + rest[: m - len(chosen)]]

    def link(self, j: int, i: int, layer: int) -> None:
        row = self.near[layer][j]
        free = int((row >= 0).sum())
        if free < len(row):
            row[free] = i
            return
        own = np.append(row, i)
        chosen = self.spread(list(zip(self.distance(self.x[j], own).tolist(), own.tolist(), strict=True)), len(row))
        row[:] = -1
        row[: len(chosen)] = chosen

    def search_layer(self, q: np.ndarray, start: list[tuple[float, int]], effort: int, layer: int) -> list[tuple[float, int]]:
        seen = {i for _, i in start}
        ahead = list(start)
        heapq.heapify(ahead)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        near = self.near[layer]
        while ahead:
            d, i = heapq.heappop(ahead)
            if d > -best[0][0] and len(best) >= effort:
                break
            new = [j for j in near[i].tolist() if j >= 0 and j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(self.distance(q, np.array(new)).tolist(), new, strict=True):
                if len(best) < effort:
                    heapq.heappush(best, (-e, j))
                    heapq.heappush(ahead, (e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                    heapq.heappush(ahead, (e, j))
        return sorted((-d, i) for d, i in best)

    def search(self, q: np.ndarray, effort: int) -> list[int]:
        at = [(float(self.distance(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(len(self.near) - 1, 0, -1):
            at = self.search_layer(q, at, 1, layer)
        return [i for _, i in self.search_layer(q, at, effort, 0)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), dim of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), F.size(v).alias("dim"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(vectors: DataFrame, shard_size: int = 2048, m: int = 12, effort: int = 64) -> DataFrame:
    """One row a shard and dimension: ids sorted within equal vectors, distinct vectors, neighbours."""
    good = usable(vectors)
    shards = max(1, -(-good.count() // shard_size))

    def make(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        x, ids = _matrix(t["embedding"], dim), t["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        distinct, back = np.unique(x[order], axis=0, return_inverse=True)
        member = np.argsort(back.ravel(), kind="stable")
        start = np.searchsorted(back.ravel()[member], np.arange(len(distinct) + 1))
        shuffle = np.random.default_rng(len(distinct)).permutation(len(distinct))  # sorted input makes poor graphs
        ids = np.concatenate([ids[order][member[start[i] : start[i + 1]]] for i in shuffle])
        start = np.concatenate(([0], np.cumsum(np.diff(start)[shuffle])))
        g = Graph.build(distinct[shuffle], m, effort)
        return pa.table({"shard": [key[0].as_py()], "dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "start": [start.tobytes()], "vectors": [g.x.tobytes()], "near": [[n.tobytes() for n in g.near]], "entry": [g.entry]})

    dealt = good.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return dealt.groupBy("shard", "dim").applyInArrow(make, "shard long, dim int, ids binary, start binary, vectors binary, near array<binary>, entry long")


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, effort: int = 96, block: int = 512, lane_blocks: int = 16) -> DataFrame:
    """query_id, vec_id, score: up to k results of every query from every shard."""

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "lane": pa.array([key[1].as_py() // lane_blocks], pa.int64()), "q_ids": [t["vec_id"].to_numpy().tobytes()], "q": [_matrix(t["embedding"], key[0].as_py()).tobytes()]})

    def look(key: tuple, shards: pa.Table, asked: pa.Table) -> pa.Table:
        a, b, s = [], [], []
        dim = key[1].as_py()
        for r in shards.to_pylist():
            x = np.frombuffer(r["vectors"], np.float64).reshape(-1, dim)
            g = Graph(x, [np.frombuffer(n, np.int32).reshape(len(x), -1) for n in r["near"]], r["entry"])
            ids, start = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["start"], np.int64)
            for q_ids, q in zip(asked["q_ids"], asked["q"], strict=True):
                for qid, v in zip(np.frombuffer(q_ids.as_buffer(), np.int64).tolist(), np.frombuffer(q.as_buffer(), np.float64).reshape(-1, dim), strict=True):
                    rows = np.array(g.search(v, max(effort, k + 1)))
                    score = np.sqrt(((g.x[rows] - v) ** 2).sum(1))
                    last = np.sort(score)[min(k, len(score) - 1)]  # equal distances at the end all stay until the ids decide
                    out = [(d, y) for i, d in zip(rows.tolist(), score.tolist(), strict=True) if d <= last for y in ids[start[i] : start[i + 1]][: k + 1].tolist() if y != qid]
                    for d, y in sorted(out)[:k]:
                        a.append(qid)
                        b.append(y)
                        s.append(d)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    # Blocks are dealt by a hash over a number of groups that follows the number of queries.
    groups = max(1, -(-queries.count() // block))
    packed = queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).groupBy("dim", "g").applyInArrow(pack, "dim int, lane long, q_ids binary, q binary")
    lanes = -(-groups // lane_blocks)
    shards = index.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    keys = ["shard", "dim", "lane"]
    one, two = index.withColumn("lane", every(lanes)).groupBy(*keys), packed.withColumn("shard", every(shards)).groupBy(*keys)
    return one.cogroup(two).applyInArrow(look, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_size: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score."""
    index = stash(build_index(vectors, shard_size), "index")
    found = search_index(index, usable(queries), k)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
