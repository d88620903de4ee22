"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words each, the whole text being covered. Every passage is
encoded from its characters and words; gated attention, learned from document labels only, weighs the
passages, and the weighted mean is scored: e = tanh(xA + a), weight ~ exp(w . (tanh(eV) * sigmoid(eU))),
score = sigmoid(c . sum(weight e) + d), calibrated to the class sizes. Training is plain numpy on a
bounded sample of labelled training rows (`per_class`); scoring covers every document.

Null and empty texts, and texts without words, are one passage of zeros and get its score. Repeated rows
score alike; without labels of both classes the score is the training share of label 1 ((n1+1)/(n+2));
empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import Adam, calibrate, held_out, label_sample, sigmoid
from .textvec import IS_SPACE, LOWER, Block, blocks, hash_spans, word_spans

PASSAGE = 64
BIGRAMS = 48
MOD, REST = 4, 2


def _byte_classes() -> np.ndarray:
    c = np.full(256, 9, np.uint8)  # other punctuation and control
    c[97:123], c[65:91], c[48:58], c[128:] = 0, 1, 2, 3
    c[list(b"#*$%&|<>")] = 4
    c[[33, 63]] = 5
    c[[46, 44]] = 6
    c[IS_SPACE] = 7
    c[10] = 8
    return c


CLASS = _byte_classes()
N_CLASS = 10
N_FEATURES = N_CLASS + 6 + BIGRAMS


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(borders of rows in passages, features); each row has one passage at least."""
    n, buf = block.size, block.buf
    starts, ends, row = word_spans(block)
    count = np.bincount(row, minlength=block.n)
    per = np.maximum(1, -(-count // PASSAGE))
    borders = np.concatenate(([0], np.cumsum(per)))
    total = int(borders[-1])
    within = np.arange(len(row)) - np.concatenate(([0], np.cumsum(count)[:-1]))[row] if len(row) else row
    own = borders[row] + within // PASSAGE  # passage of each word
    x = np.zeros((total, N_FEATURES), np.float32)
    if not len(row):
        return borders, x
    words = np.bincount(own, minlength=total)
    first = np.searchsorted(own, np.arange(total))
    live = words > 0
    a = np.zeros(total, np.int64)
    b = np.zeros(total, np.int64)
    a[live] = starts[first[live]]
    b[live] = ends[first[live] + words[live] - 1]
    length = np.maximum(b - a, 1)
    inside = np.zeros(n + 1, np.int64)
    inside[a[live]] += 1
    inside[b[live]] -= 1
    at = np.flatnonzero(np.cumsum(inside)[:n])
    passage = np.repeat(np.flatnonzero(live), (b - a)[live])
    share = np.bincount(passage * N_CLASS + CLASS[buf[at]], minlength=total * N_CLASS).reshape(total, N_CLASS)
    x[:, :N_CLASS] = np.sqrt(share / length[:, None])
    low = LOWER[buf].astype(np.uint32)
    pair = (low[at] * np.uint32(257) + low[at + 1]) * np.uint32(2654435761) >> np.uint32(16)
    gram = np.bincount(passage * BIGRAMS + pair % BIGRAMS, minlength=total * BIGRAMS).reshape(total, BIGRAMS)
    x[:, N_CLASS + 6 :] = np.sqrt(gram / length[:, None])
    h = hash_spans(LOWER[buf], starts, ends)
    order = np.lexsort((h, own))
    same = (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])
    many = np.maximum(words, 1)
    x[:, N_CLASS] = np.bincount(own[order][1:], same, total) / many  # words repeated in the passage
    x[:, N_CLASS + 1] = np.bincount(own[1:], (h[1:] == h[:-1]) & (own[1:] == own[:-1]), total) / many
    size = (ends - starts).astype(np.float64)
    x[:, N_CLASS + 2] = np.log1p(np.bincount(own, size, total) / many) / 3
    x[:, N_CLASS + 3] = np.log1p(np.bincount(own, size * size, total) / many) / 6
    x[:, N_CLASS + 4] = np.bincount(own, size == 1, total) / many
    x[:, N_CLASS + 5] = np.log1p(words) / 4
    return borders, x


class Attention:
    def __init__(self, seed: int = 13, hidden: int = 24, gate: int = 12):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"A": g(N_FEATURES, hidden), "a": np.zeros(hidden), "V": g(hidden, gate), "U": g(hidden, gate), "w": g(gate), "c": g(hidden), "d": np.zeros(1)}
        self.mean, self.std = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.scale, self.shift, self.constant = 1.0, 0.0, None

    def forward(self, x: np.ndarray, borders: np.ndarray):
        p = self.p
        e = np.tanh(x @ p["A"] + p["a"])
        v, u = np.tanh(e @ p["V"]), sigmoid(e @ p["U"])
        s = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        q = np.exp(s - np.maximum.reduceat(s, borders[:-1])[bag])
        q /= np.add.reduceat(q, borders[:-1])[bag]
        z = np.add.reduceat(q[:, None] * e, borders[:-1])
        return e, v, u, q, bag, z, z @ p["c"] + p["d"][0]

    def gradient(self, x: np.ndarray, borders: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        e, v, u, q, bag, z, s = self.forward(x, borders)
        ds = weight * (sigmoid(s) - y) / len(y)
        dz = ds[:, None] * p["c"]
        dq = (dz[bag] * e).sum(1)
        de = q[:, None] * dz[bag]
        da = q * (dq - np.add.reduceat(q * dq, borders[:-1])[bag])
        dv, du = da[:, None] * p["w"] * u * (1 - v * v), da[:, None] * p["w"] * v * u * (1 - u)
        de += dv @ p["V"].T + du @ p["U"].T
        dx = de * (1 - e * e)
        return {"A": x.T @ dx, "a": dx.sum(0), "V": e.T @ dv, "U": e.T @ du, "w": (v * u).T @ da, "c": z.T @ ds, "d": ds.sum(keepdims=True)}

    def logits(self, x: np.ndarray, borders: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.std, borders)[-1]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, size: dict[int, int], steps: int = 700, batch: int = 64) -> Attention:
        every = np.concatenate(bags)
        self.mean, self.std = every.mean(0), every.std(0) + 1e-3
        bags = [(b - self.mean) / self.std for b in bags]
        r, adam = np.random.default_rng(17), Adam(self.p, 0.004)
        classes = [np.flatnonzero(y == c) for c in (0, 1)]
        for _ in range(steps):
            pick = np.concatenate([r.choice(c, batch // 2) for c in classes])
            borders = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])))
            grad = self.gradient(np.concatenate([bags[i] for i in pick]), borders, y[pick], np.ones(len(pick)))
            adam.step({k: g + 2e-4 * self.p[k] for k, g in grad.items()})
        borders = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
        z = np.concatenate([self.forward(np.concatenate(bags[i : i + 200]), borders[i : i + 201][: len(bags[i : i + 200]) + 1] - borders[i])[-1] for i in range(0, len(bags), 200)])
        self.scale, self.shift = calibrate(z, y, size)
        return self

    def score(self, x: np.ndarray, borders: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(borders) - 1, self.constant)
        return sigmoid(self.scale * self.logits(x, borders) + self.shift)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Attention:
    """From at most per_class training rows of either class."""
    sample, size = label_sample(labels, "quality", MOD, REST, {0: per_class, 1: per_class})
    model = Attention()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                borders, x = passages(block)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(block.lo, block.n), pa.array([x[borders[i] : borders[i + 1]].tobytes() for i in range(block.n)], pa.binary())], names=["y", "x"])

    # The sample has 2 * per_class rows of two numbers at most.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "y")
    rows = joined.mapInArrow(encode, "y int, x binary").collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        model.constant = (size.get(1, 0) + 1) / (sum(size.values()) + 2)
        return model
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (y[i], rows[i]["x"]))  # independent of the order of arrival
    return model.fit([bags[i] for i in order], y[order], size)


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """doc_id, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                borders, x = passages(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(model.score(x, borders))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: Attention, name: str) -> DataFrame:
    """docs with the score of its text as a further column."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.float64()), *(pa.array(model.score(*reversed(passages(block)))) for block in blocks(texts))])

    return docs.withColumn(name, scored("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
