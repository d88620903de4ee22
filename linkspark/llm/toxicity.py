"""Toxicity by weak supervision.

1. Voters. Words and word beginnings (4, 5 and 6 bytes of a lower-cased word) that mark toxic training
   documents are mined from a bounded sample; the strongest become lexicon voters, and patterns over all
   mined terms (several different ones, a share of the text, close neighbours, one that is shouted, none
   at all) become pattern voters. A voter fires or abstains.
2. Label model. Every document of the corpus votes. A two-class generative model of the votes estimates
   how often each voter fires in either class, without labels, by expectation and maximisation; each round
   sums over all documents and brings a few numbers a voter to the driver. From the class-conditional
   second moments of the last round come the voters' correlations; the evidence of a voter is divided
   by the number of voters that it agrees with beyond the class.
3. Classifier. A logistic regression over the mined terms is trained on the label model's posteriors of all
   documents of the corpus: documents with the same terms are one weighted row, and every Newton step sums the
   gradient and the non-zero entries of the Hessian over these rows where they lie. It is calibrated to the
   labelled sample and the true class sizes, and scores every whole text.

Of the sample only counts, minima and scores reach the driver, no text. Null and empty texts score as a text without any term. Repeated rows score alike. Without labels of both
classes, or without a term, every score is the training share of label 1 ((n1+1)/(n+2)). Empty tables give no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import calibrate, held_out, label_sample, sigmoid
from .scratch import Scratch
from .textvec import LOWER, Block, blocks, hash_spans, mix, word_spans

MOD, REST = 3, 1
_U = np.uint64
PREFIXES = (4, 5, 6)
MAX_TERMS = 600
LEXICON_VOTERS = 48
#: Pattern voters: distinct terms, share of words, neighbouring hits, shouted hit, no term.
PATTERN_VOTERS = 6
PUNCT = np.zeros(256, bool)
PUNCT[33:48] = PUNCT[58:65] = PUNCT[91:97] = PUNCT[123:127] = True


def terms(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, term hash, shouted) of every word and word beginning of the block."""
    starts, ends, row = word_spans(block)
    buf = block.buf
    for _ in range(4):  # punctuation around a word; what is left of longer runs belongs to it
        starts = np.where((starts < ends) & PUNCT[buf[starts]], starts + 1, starts)
        ends = np.where((starts < ends) & PUNCT[buf[np.maximum(ends - 1, 0)]], ends - 1, ends)
    size = ends - starts
    shout = (buf[starts] >= 65) & (buf[starts] <= 90) & (buf[np.maximum(ends - 1, 0)] >= 65) & (buf[np.maximum(ends - 1, 0)] <= 90) & (size > 1)
    low = LOWER[buf]
    number = np.arange(len(row))
    rows, numbers, hashes, shouts = [], [], [], []
    some = size > 0
    for n in (0, *PREFIXES):
        take = some if n == 0 else size > n
        rows.append(row[take])
        numbers.append(number[take])
        hashes.append(hash_spans(low, starts[take], ends[take] if n == 0 else starts[take] + n, 0x51ED270B + n))
        shouts.append(shout[take])
    return np.concatenate(rows), np.concatenate(numbers), np.concatenate(hashes), np.concatenate(shouts)


@dataclass
class Terms:
    """Mined term hashes, ascending; order ranks them by strength."""

    keys: np.ndarray
    order: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> _U(44)).astype(np.int64)] = True

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, word number, term, shouted) of the mined terms of a block, by row and word; words by row."""
        row, number, h, shout = terms(block)
        at = np.flatnonzero(self.seen[(h >> _U(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        at, k = at[ok], k[ok]
        by = np.lexsort((k, number[at]))
        at, k = at[by], k[by]
        return row[at], number[at], k, shout[at], np.bincount(word_spans(block)[2], minlength=block.n)


def votes(t: Terms, block: Block) -> np.ndarray:
    """One bit a voter, for each row of a block."""
    row, number, k, shout, words = t.hits(block)
    out = np.zeros(block.n, _U)
    rank = np.full(len(t.keys), 63)
    rank[t.order[:LEXICON_VOTERS]] = np.arange(min(LEXICON_VOTERS, len(t.order)))
    bit = rank[k]
    np.bitwise_or.at(out, row[bit < 63], _U(1) << bit[bit < 63].astype(_U))
    new = np.ones(len(number), bool)
    new[1:] = number[1:] != number[:-1]
    hit_words = np.bincount(row[new], minlength=block.n)
    pair = np.unique(row * len(t.keys) + k) // max(1, len(t.keys))
    distinct = np.bincount(pair, minlength=block.n)
    near = np.zeros(block.n, bool)
    r, n = row[new], number[new]
    near[r[1:][(r[1:] == r[:-1]) & (n[1:] - n[:-1] <= 3)]] = True
    loud = np.zeros(block.n, bool)
    loud[row[shout]] = True
    for i, flag in enumerate((distinct >= 2, distinct >= 4, 50 * hit_words >= np.maximum(words, 1), near, loud, hit_words == 0)):
        out |= np.where(flag, _U(1) << _U(LEXICON_VOTERS + i), _U(0))
    return out


N_VOTERS = LEXICON_VOTERS + PATTERN_VOTERS


def unpack(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(N_VOTERS).astype(_U) & _U(1)).astype(np.float64)


@dataclass
class LabelModel:
    prior: float
    toxic: np.ndarray  # P(fires | toxic)
    clean: np.ndarray
    share: np.ndarray  # part of a voter's evidence that is its own, after correlations

    def posterior(self, v: np.ndarray) -> np.ndarray:
        on = np.log(self.toxic) - np.log(self.clean)
        off = np.log1p(-self.toxic) - np.log1p(-self.clean)
        z = np.log(self.prior) - np.log1p(-self.prior) + (v * (on * self.share)).sum(1) + ((1 - v) * (off * self.share)).sum(1)
        return sigmoid(z)


def corpus_sums(voted: DataFrame, model: LabelModel, second: bool) -> np.ndarray:
    """Sums over all documents of q, 1-q, their products with the votes, and with vote pairs if second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            v = unpack(batch.column(0).to_numpy().view(_U))
            q = model.posterior(v)
            parts = [[q.sum(), (1 - q).sum()], q @ v, (1 - q) @ v]
            if second:
                parts += [((v * q[:, None]).T @ v).ravel(), ((v * (1 - q)[:, None]).T @ v).ravel()]
            parts = np.concatenate(parts)
            total = parts if total is None else total + parts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    n = 2 + 2 * N_VOTERS + (2 * N_VOTERS**2 if second else 0)
    out = np.zeros(n)
    for r in voted.select("votes").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


def fit_label_model(voted: DataFrame, start: LabelModel, rounds: int = 4) -> LabelModel:
    model = start
    for k in range(rounds):
        s = corpus_sums(voted, model, k == rounds - 1)
        n1, n0 = s[0] + 1e-9, s[1] + 1e-9
        f1, f0 = s[2 : 2 + N_VOTERS], s[2 + N_VOTERS : 2 + 2 * N_VOTERS]
        rate = lambda f, n: np.clip((f + 0.5) / (n + 1), 1e-5, 1 - 1e-5)
        model = LabelModel(float(np.clip(n1 / (n1 + n0), 1e-4, 0.5)), rate(f1, n1), rate(f0, n0), start.share)
    joint = s[2 + 2 * N_VOTERS :].reshape(2, N_VOTERS, N_VOTERS)
    excess = np.zeros((N_VOTERS, N_VOTERS))
    for m, n, p in ((joint[0], n1, f1 / n1), (joint[1], n0, f0 / n0)):
        cov = m / n - np.outer(p, p)
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-6))
        excess = np.maximum(excess, cov / np.outer(sd, sd))
    excess = np.clip(np.where(excess > 0.1, excess, 0), 0, 1)
    np.fill_diagonal(excess, 1)
    model.share = 1 / excess.sum(1)
    return model


@dataclass
class Classifier:
    terms: Terms | None
    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float = 0.0

    def logits(self, block: Block) -> np.ndarray:
        row, _, k, _, _ = self.terms.hits(block)
        pair = np.unique(row * len(self.terms.keys) + k)
        z = np.bincount(pair // len(self.terms.keys), self.weight[pair % len(self.terms.keys)], block.n)
        return z + self.bias

    def score(self, block: Block) -> np.ndarray:
        if self.terms is None:
            return np.full(block.n, self.constant)
        return sigmoid(self.scale * self.logits(block) + self.shift)


def mine(sample: DataFrame, n1: int, n0: int, share: float = 0.01, ratio: float = 8.0) -> Terms | None:
    """Terms that three toxic sample documents and `share` of them hold, at `ratio` times the clean rate; the
    MAX_TERMS strongest. sample has y and the distinct terms of each document."""
    counts = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    lift = (F.col("c1") + 0.5) / (n1 + 1) * (n0 + 1) / (F.col("c0") + 0.5)
    good = counts.where(F.col("c1") >= max(3, share * n1)).withColumn("lift", lift).where(F.col("lift") >= ratio)
    best = good.select("term", (F.col("c1") * F.log("lift")).alias("strength")).orderBy(F.desc("strength"), "term").limit(MAX_TERMS).collect()
    if not best:
        return None
    keys = np.array([r["term"] for r in best], np.int64).view(_U)
    by = np.argsort(keys)
    return Terms(keys[by], np.argsort(by))  # and the position in key order of the strongest, the next, ...


def distinct_sample(minima: np.ndarray, least: float = 0.5, width: int = 4) -> np.ndarray:
    """Positions of sample documents without earlier near copies, so that one copied text counts once.

    Candidates share a band of minima; two are near copies when `least` of all their minima agree.
    """
    first: dict[tuple, int] = {}
    keep = []
    for i, x in enumerate(minima):
        keys = [(b, *x[b : b + width].tolist()) for b in range(0, minima.shape[1], width)]
        if any((x == minima[j]).mean() >= least for j in {first[k] for k in keys if k in first}):
            continue
        keep.append(i)
        for k in keys:
            first.setdefault(k, i)
    return np.array(keep, np.int64)


MINIMA = 32


def sampled(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """row, y, text, distinct terms and minima of the sample's documents that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in blocks(batch.column(1)):
                row, _, h, _ = terms(block)
                by = np.lexsort((h, row))
                row, h = row[by], h[by]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                row, h = row[new], h[new]
                cut = np.searchsorted(row, np.arange(block.n + 1))
                own = np.flatnonzero(np.diff(cut))
                least = [np.minimum.reduceat(mix(h ^ _U(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))), cut[own]) if len(own) else h[:0] for j in range(MINIMA)]
                least = np.stack(least, 1)
                part = batch.slice(block.lo, block.n).take(pa.array(own))
                offsets = np.append(cut[own], cut[own[-1] + 1] if len(own) else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + own), part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64))), pa.array([x.tobytes() for x in least], pa.binary())],
                    names=["row", "y", "text", "terms", "minima"],
                )
                at += block.n

    # The sample has toxic_docs + clean_docs rows of two numbers at most.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("y", "text")
    return joined.mapInArrow(run, "row long, y int, text string, terms array<long>, minima binary")


def feature_rows(docs: DataFrame, found: Terms) -> DataFrame:
    """votes and terms (numbers of mined terms, two bytes each) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                row, _, k, _, _ = found.hits(block)
                pair = np.unique(row * len(found.keys) + k)
                cut = np.searchsorted(pair // len(found.keys), np.arange(block.n + 1))
                k = (pair % len(found.keys)).astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array(votes(found, block).view(np.int64)), pa.array([k[cut[i] : cut[i + 1]].tobytes() for i in range(block.n)], pa.binary())], names=["votes", "terms"])

    return docs.select("text").mapInArrow(run, "votes long, terms binary")


def fit_classifier(voted: DataFrame, model: LabelModel, n_terms: int, work: Scratch, rounds: int = 8, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic regression on the posteriors of all documents, by damped Newton steps.

    A round brings the sums of a gradient of n_terms + 1 numbers and of the pairs of terms that occur together.
    """
    size = n_terms + 1

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = model.posterior(unpack(batch.column(0).to_numpy().view(_U)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(q)], names=["terms", "q"])

    rows = voted.select("votes", "terms").mapInArrow(judge, "terms binary, q double")
    rows = work.stash(rows.groupBy("terms").agg(F.sum("q").alias("q"), F.count("*").alias("n")), "features")
    prior = np.clip(model.prior, 1e-4, 1 - 1e-4)
    w = np.zeros(size)
    w[-1] = np.log(prior / (1 - prior))
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            gradient, hessian = np.zeros(size), np.zeros((size, size))
            for batch in batches:
                q, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
                own = [np.frombuffer(t.as_buffer(), "<u2").astype(np.int64) for t in batch.column(0)]
                for a in range(0, len(own), 2000):
                    x = np.zeros((len(own[a : a + 2000]), size))
                    x[:, -1] = 1
                    for i, k in enumerate(own[a : a + 2000]):
                        x[i, k] = 1
                    p = sigmoid(x @ w)
                    gradient += x.T @ (n[a : a + 2000] * p - q[a : a + 2000])
                    hessian += x.T @ (x * (n[a : a + 2000] * np.maximum(p * (1 - p), 1e-6))[:, None])
            every = np.concatenate((gradient, np.triu(hessian).ravel()))
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at])], names=["i", "x"])

        every = np.zeros(size + size * size)
        for r in rows.mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            every[r["i"]] = r["x"]
        hessian = every[size:].reshape(size, size)
        hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty)
        step = np.clip(np.linalg.solve(hessian, every[:size] + penalty * w), -1.5, 1.5)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1500, clean_docs: int = 3000) -> Classifier:
    """From at most toxic_docs and clean_docs labelled training rows, and the votes of all documents."""
    work = Scratch(docs.sparkSession)
    sample, size = label_sample(labels, "toxic", MOD, REST, {1: toxic_docs, 0: clean_docs})
    prior = (size.get(1, 0) + 1) / (sum(size.values()) + 2)
    none = Classifier(None, np.zeros(0), 0.0, constant=prior)
    rows = work.stash(sampled(docs, sample), "toxic-sample")
    seen = sorted(rows.select("y", "minima", "row").collect())
    kept = [seen[i] for i in distinct_sample(np.array([np.frombuffer(r["minima"], _U) for r in seen], _U).reshape(-1, MINIMA))]
    n1 = sum(r["y"] for r in kept)
    if not 0 < n1 < len(kept):
        work.close()
        return none
    chosen = docs.sparkSession.createDataFrame([(r["row"],) for r in kept], "row long")
    rows_kept = rows.join(F.broadcast(chosen), "row", "left_semi")  # toxic_docs + clean_docs numbers at most
    found = mine(rows_kept, n1, len(kept) - n1)
    if found is None:
        work.close()
        return none

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(votes(found, block).view(np.int64))], names=["y", "votes"])

    told = rows_kept.select("y", "text").mapInArrow(vote, "y int, votes long").collect()
    y, v = np.array([r["y"] for r in told]), unpack(np.array([r["votes"] for r in told], np.int64).view(_U))
    rate = lambda c: np.clip((v[y == c].sum(0) + 0.5) / ((y == c).sum() + 1), 1e-4, 1 - 1e-4)
    voted = work.stash(feature_rows(docs, found), "votes")
    model = fit_label_model(voted, LabelModel(prior, rate(1), rate(0), np.full(N_VOTERS, 0.3)))
    out = Classifier(found, *fit_classifier(voted, model, len(found.keys), work))

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(out.logits(block))], names=["y", "z"])

    told = rows_kept.select("y", "text").mapInArrow(logits, "y int, z double").collect()
    out.scale, out.shift = calibrate(np.array([r["z"] for r in told]), np.array([r["y"] for r in told], float), size)
    work.close()
    return out


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(model.score(block))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: Classifier, name: str) -> DataFrame:
    """docs with the score of its text as a further column."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.float64()), *(pa.array(model.score(block)) for block in blocks(texts))])

    return docs.withColumn(name, scored("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id"), MOD, REST).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
