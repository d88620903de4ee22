"""Dictionary selection by marginal gain on held-out links.

Occurrences are found distributed: each held-out link is matched against the candidate pool (bounded by
`pool`, broadcast). The greedy choice itself is sequential by nature; it runs in one task on the
held-out sample that the queries bound by `bodies` (20,000), as the reference's reservoir does, never on the corpus.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

SELECTED = "kind string, rank int, candidate string, n long, saved_bits long, gain double, cost_bits long, net_score double"


def dictionary_cost(candidate, overhead: int = 16):
    return (8 * F.octet_length(candidate) + overhead).cast("long")


def occurrences(pool: DataFrame, heldout: DataFrame) -> DataFrame:
    """candidate, saved_bits, n, occurrences without overlap, weight of the link, for pairs that occur.

    pool holds 512 rows at most by its limit, so broadcasting it is bounded.
    """
    body = heldout.select(U.compression_body(F.col("url")).alias("body"), U.url_weight(F.col("url")).alias("weight"))
    hit = body.join(F.broadcast(pool), F.contains("body", "candidate"))
    return hit.withColumn("occurrences", F.expr("(length(body) - length(replace(body, candidate, ''))) div length(candidate)")).drop("body")


def initial_scores(pool: DataFrame, heldout: DataFrame, overhead: int = 16) -> DataFrame:
    """candidate, occurrences, net_score of each candidate alone."""
    gain = occurrences(pool, heldout).groupBy("candidate").agg(F.sum("occurrences").alias("occurrences"), F.sum(F.col("occurrences") * F.col("saved_bits") * F.col("weight")).alias("gain"))
    full = pool.select("candidate").join(gain, "candidate", "left")
    return full.select("candidate", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), (F.coalesce("gain", F.lit(0.0)) - dictionary_cost(F.col("candidate"), overhead)).alias("net_score"))


def _rounded(score: float) -> int:
    """Hundredths, halves away from zero."""
    x = score * 100
    return math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5)


class Greedy:
    """Lazy greedy choice over one sample. Covered spans are kept per link as marks on its bytes."""

    def __init__(self, pool: list[tuple[str, int, int]], bodies: list[tuple[bytes, float]], overhead: int):
        self.pool, self.overhead = pool, overhead
        self.bodies = bodies
        self.marks = [bytearray(len(b)) for b, _ in bodies]
        self.where = [[i for i, (b, _) in enumerate(bodies) if c.encode() in b] for c, _, _ in pool]

    def spans(self, k: int, i: int):
        """Uncovered occurrences of candidate k in link i, left to right without overlap."""
        c, (text, _), marks = self.pool[k][0].encode(), self.bodies[i], self.marks[i]
        at = text.find(c)
        while at >= 0:
            free = not any(marks[at : at + len(c)])
            if free:
                yield at, at + len(c)
            at = text.find(c, at + (len(c) if free else 1))

    def cost(self, k: int) -> int:
        return 8 * len(self.pool[k][0].encode()) + self.overhead

    def net(self, k: int) -> float:
        return sum(sum(1 for _ in self.spans(k, i)) * self.pool[k][2] * self.bodies[i][1] for i in self.where[k]) - self.cost(k)

    def cover(self, k: int) -> None:
        for i in self.where[k]:
            for a, b in list(self.spans(k, i)):
                self.marks[i][a:b] = b"\x01" * (b - a)

    def choose(self, budget: int) -> tuple[list[tuple[int, float]], list[tuple[int, float, float]]]:
        """(chosen with net score, shadowed with first and last score)."""
        first = [self.net(k) for k in range(len(self.pool))]
        queue = [(-_rounded(s), k) for k, s in enumerate(first) if s > 0]
        heapq.heapify(queue)
        chosen: list[tuple[int, float]] = []
        while queue and len(chosen) < budget:
            promised, k = heapq.heappop(queue)
            now = self.net(k)
            if _rounded(now) < -promised and queue and _rounded(now) < -queue[0][0]:
                if now > 0:
                    heapq.heappush(queue, (-_rounded(now), k))
            elif now > 0:
                self.cover(k)
                chosen.append((k, now))
        taken = {k for k, _ in chosen}
        faded = [(k, s, self.net(k)) for k, s in enumerate(first) if s > 0 and k not in taken]
        faded = sorted(((k, s, t) for k, s, t in faded if t <= s * 0.25), key=lambda x: -x[1])
        return chosen, faded


def select_dictionary(pool: DataFrame, heldout: DataFrame, budget: int = 128, overhead: int = 16, shadow_limit: int = 50) -> DataFrame:
    """Rows of kind selected and shadowed; shadowed rows have the first score as gain and the last as net.

    pool: candidate, n, saved_bits, total_score, ordered by score and candidate. Both inputs are bounded.
    """
    links = heldout.select(F.lit("link").alias("kind"), U.compression_body(F.col("url")).alias("text"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("saved_bits"), F.lit(0).cast("long").alias("total_score"), U.url_weight(F.col("url")).alias("weight"))
    entries = pool.select(F.lit("entry").alias("kind"), F.col("candidate").alias("text"), "n", "saved_bits", "total_score", F.lit(0.0).alias("weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf.kind == "entry"].sort_values(["total_score", "text"], ascending=[False, True])
        bodies = [(t.encode(), w) for t, w in sorted(zip(pdf[pdf.kind == "link"].text, pdf[pdf.kind == "link"].weight, strict=True))]
        g = Greedy(list(zip(rows.text, rows.n, rows.saved_bits, strict=True)), bodies, overhead)
        chosen, faded = g.choose(budget) if len(rows) and bodies else ([], [])
        out = [("selected", r, g.pool[k][0], g.pool[k][1], g.pool[k][2], s + g.cost(k), g.cost(k), s) for r, (k, s) in enumerate(chosen)]
        out += [("shadowed", r, g.pool[k][0], g.pool[k][1], g.pool[k][2], s, g.cost(k), t) for r, (k, s, t) in enumerate(faded[:shadow_limit])]
        return pd.DataFrame(out, columns=["kind", "rank", "candidate", "n", "saved_bits", "gain", "cost_bits", "net_score"])

    one = links.unionByName(entries).withColumn("all", F.lit(0) * F.length("text"))
    return one.groupBy("all").applyInPandas(run, SELECTED)

