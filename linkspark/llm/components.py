"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges that one task may contract: 16 bytes each.
SMALL = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by one edge from each node to the smallest node it reaches there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])


def _named(e: DataFrame) -> DataFrame:
    """(node, component) of edges from every other node to its component's smallest."""
    return e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))).alias("e")).select(F.col("e.u").alias("node"), F.col("e.v").alias("component")).distinct()


def joined(group: DataFrame, edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, component) after further edges (a, b) between nodes of `group` and others, which are their own
    components so far. Only components that the edges touch are looked at."""
    own = group.select("node", "component")
    touched = edges.join(own.toDF("a", "u"), "a", "left").join(own.toDF("b", "v"), "b", "left")
    touched = touched.select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v"))
    found = components(touched.where("u <> v").distinct(), work)
    moved = own.join(found.toDF("component", "now"), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return work.stash(moved.unionByName(found.join(own, "node", "left_anti")), "components")


def components(edges: DataFrame, work: Scratch | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; component is its smallest reachable node.

    edges has the long columns u and v. Alternating large-star and small-star rounds run until no edge
    changes; every round is a grouped minimum and a join, written to the shared folder. A node with very
    many neighbours is reduced by partial aggregation, and its side of the join is a skew join. Up to SMALL edges
    are contracted in one task instead, as a partition of larger graphs is.
    """
    work = work or Scratch(edges.sparkSession)
    e = work.stash(edges.where("u <> v").select("u", "v").mapInArrow(_contract, "u long, v long"), "edges")
    if e.count() <= SMALL:
        return work.stash(_named(e.repartition(1).mapInArrow(_contract, "u long, v long")), "components")
    seen = None
    for _ in range(most_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.stash(large.where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        small = small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct()
        e = work.stash(small.mapInArrow(_contract, "u long, v long").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return work.stash(_named(e), "components")
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
