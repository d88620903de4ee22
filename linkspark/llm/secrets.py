"""Secret scan: fixed patterns, and a character convolutional network over every further candidate.

The patterns give base findings, which always stay. Every candidate that no base finding touches is scored, with
the characters around it, by a small convolutional network in numpy. Candidates are runs of [A-Za-z0-9+/_-], with
their padding, that hold a digit and a letter in 8 characters or more, or that follow a colon or equals sign in
6 or more. A value longer than a window is read in overlapping windows from end to end; its score is
the largest. The network is trained on labelled findings: base findings, whose keyword or shape is hidden at
random so that the value and looser contexts must carry the decision, against candidates and ordinary words
beside no finding. The threshold is set on a holdout after Platt calibration, under the constraint that it
keeps the wanted recall there: the highest such threshold, or, where that lies above all negatives, the middle between it and
the highest negative.

The training sample is bounded: the `train_docs` documents with findings, and as many without, of smallest
hash over all documents, with at most `per_doc` findings each; whole texts are read. Every document is scanned
as a whole. Null and empty texts have no findings; repeated rows are scanned alike; an empty table, or one
without findings, adds no span to the base ones. Further columns are ignored, and kept by redact().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of finding and their patterns.
KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
NUMBERED = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}={0,2}")
ASSIGNED = re.compile(r"(?<=[:=])\x20*[\"']?([A-Za-z0-9+/_-]{6,}={0,2})")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")

#: Characters of context on either side, and of the value.
SIDE, VALUE = 24, 48
WIDTH = 2 * SIDE + VALUE


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings of the fixed patterns, by start and then kind. Long enough runs of a kind are its maximal
    runs, so only `assign` needs its short matches dropped afterwards."""
    out = []
    if KEYWORD.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of candidate shape that touch no base finding."""
    found = {m.span(1) for m in ASSIGNED.finditer(text)} if ":" in text or "=" in text else set()
    if DIGIT.search(text):
        found |= {m.span() for m in NUMBERED.finditer(text) if LETTER.search(m.group())}
    return [(a, b) for a, b in sorted(found) if all(b <= x or y <= a for _, x, y in base)]


def classes(s: str) -> np.ndarray:
    """Characters as small ids: ASCII as it is, everything else one id; 0 is padding."""
    x = np.frombuffer(s.encode("utf-32-le"), "<u4")
    return np.where((x > 0) & (x < 127), x, 127).astype(np.uint8)


def window(text: str, a: int, b: int) -> np.ndarray:
    """Left context, the value (VALUE characters at most), right context."""
    out = np.zeros(WIDTH, np.uint8)
    left = classes(text[max(0, a - SIDE) : a])
    out[SIDE - len(left) : SIDE] = left
    v = classes(text[a:b])
    out[SIDE : SIDE + len(v)] = v
    right = classes(text[b : b + SIDE])
    out[SIDE + VALUE : SIDE + VALUE + len(right)] = right
    return out


def windows(text: str, a: int, b: int) -> list[np.ndarray]:
    """Windows over the whole value; those of a long one overlap by half, and the last ends with it."""
    if b - a <= VALUE:
        return [window(text, a, b)]
    return [window(text, x, x + VALUE) for x in (*range(a, b - VALUE, VALUE // 2), b - VALUE)]


def platt(z: np.ndarray, target: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """(scale, shift) of the logistic calibration of logits z, by damped Newton steps."""
    x, w = np.stack((z, np.ones_like(z)), 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])), -1, 1)
    return float(w[0]), float(w[1])


class CharNet:
    """Embedding, one convolution over three regions, max pooling in each, a logistic output."""

    def __init__(self, seed: int = 7, dim: int = 8, filters: int = 16, width: int = 5):
        r = np.random.default_rng(seed)
        self.width, self.filters = width, filters
        self.p = {"E": r.normal(0, 0.3, (128, dim)), "W": r.normal(0, 0.2, (width * dim, filters)), "b": np.zeros(filters), "v": r.normal(0, 0.2, 6 * filters), "c": np.zeros(1)}
        self.p["E"][0] = 0
        n = WIDTH - width + 1
        mid = np.arange(n) + width // 2
        self.region = [np.flatnonzero(mid < SIDE), np.flatnonzero((mid >= SIDE) & (mid < SIDE + VALUE)), np.flatnonzero(mid >= SIDE + VALUE)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def forward(self, x: np.ndarray):
        e = self.p["E"][x]
        u = np.concatenate([e[:, i : WIDTH - self.width + 1 + i] for i in range(self.width)], axis=2)
        h = np.maximum(u @ self.p["W"] + self.p["b"], 0)
        peak = [h[:, g].argmax(1) for g in self.region]
        top = [np.take_along_axis(h[:, g], k[:, None], 1)[:, 0] for g, k in zip(self.region, peak, strict=True)]
        z = np.concatenate(top + [h[:, g].mean(1) for g in self.region], axis=1)
        return u, h, peak, z, z @ self.p["v"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[4] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        u, h, peak, z, s = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y) / len(y)
        dz = d[:, None] * self.p["v"]
        dh, k = np.zeros_like(h), self.filters
        for r, (g, at) in enumerate(zip(self.region, peak, strict=True)):
            dh[:, g] += dz[:, None, (3 + r) * k : (4 + r) * k] / len(g)
            rows = np.arange(len(x))[:, None]
            dh[rows, g[at], np.arange(k)[None]] += dz[:, r * k : (r + 1) * k]
        dh *= h > 0
        flat = dh.reshape(-1, k)
        du = (flat @ self.p["W"].T).reshape(u.shape)
        de = np.zeros((*x.shape, self.p["E"].shape[1]))
        for i in range(self.width):
            de[:, i : WIDTH - self.width + 1 + i] += du[:, :, i * de.shape[2] : (i + 1) * de.shape[2]]
        dE = np.zeros_like(self.p["E"])
        np.add.at(dE, x, de)
        dE[0] = 0
        return {"E": dE, "W": u.reshape(-1, u.shape[2]).T @ flat, "b": flat.sum(0), "v": z.T @ d, "c": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, y: np.ndarray, recall: float, steps: int = 300, seed: int = 11) -> CharNet:
        """Adam on three quarters; calibration and threshold on the rest."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        cut = len(x) * 3 // 4
        tr, ho = order[:cut], order[cut:]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = r.choice(tr, min(96, len(tr)), replace=False)
            for k, g in self.gradient(x[pick], y[pick]).items():
                g = g + 1e-4 * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        z, t = self.logits(x[ho]), y[ho]
        if t.min(initial=1) < t.max(initial=0):
            target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
            self.scale, self.shift = platt(z, target)
            found = np.sort(self.score(x[ho][t > 0]))
            other = np.sort(self.score(x[ho][t == 0]))
            most = float(found[int((1 - recall) * len(found))])  # a higher threshold would lose recall
            self.threshold = min(most, (most + float(other[-1])) / 2) if other[-1] < most else most
        return self


def hidden(text: str, kind: str, a: int, b: int, r: np.random.Generator) -> np.ndarray:
    """A base finding as a training example: an assigned value alone, its keyword blanked half the time."""
    if kind == "assign":
        m = ASSIGN.match(text, a)
        va = m.start(2)
        if r.random() < 0.5:
            text = text[:a] + "x" * len(m.group(1)) + text[a + len(m.group(1)) :]
        a = va
    return r.choice(windows(text, a, b))


def examples(text: str, per_doc: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, labels): findings, and candidates and words that lie in the document's ordinary parts."""
    r = np.random.default_rng(seed)
    base = base_spans(text)
    x = [hidden(text, *base[i], r) for i in sorted(r.permutation(len(base))[:per_doc])]
    y = [1.0] * len(x)
    free = lambda a, b: all(b <= p or q <= a for _, p, q in base)
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]{4,}", text) if free(*m.span())]
    numbered = [s for s in words if DIGIT.search(text, *s)]
    for spans, most in ((words, 4), (numbered, 6), (candidates(text, base), 6)):
        for a, b in [spans[i] for i in r.permutation(len(spans))[:most]]:
            x.append(r.choice(windows(text, a, b)))
            y.append(0.0)
    return np.array(x, np.uint8).reshape(-1, WIDTH), np.array(y)


def likely() -> Column:
    """Whether a text may hold a base finding."""
    return F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")


def smallest(texts: DataFrame, n: int) -> list[int]:
    """The n smallest hashes of different texts (columns text and h); no text travels."""
    return [x["h"] for x in texts.select("h").distinct().orderBy("h").limit(n).collect()]


def train(docs: DataFrame, train_docs: int = 300, recall: float = 0.95, per_doc: int = 32) -> CharNet | None:
    """The network, or None where there are no findings. Copies of one text count once."""
    texts = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    chosen = smallest(texts.where(likely()), train_docs) + smallest(texts.where(~likely()), train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [examples(t, per_doc, h & 0xFFFFFFFF) for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x, _ in made], pa.binary()), pa.array([y.tobytes() for _, y in made], pa.binary())], names=["h", "x", "y"])

    # 2 * train_docs rows of some 50 windows at most.
    rows = texts.where(F.col("h").isin(chosen)).mapInArrow(run, "h long, x binary, y binary").dropDuplicates(["h"]).collect() if chosen else []
    rows = sorted(rows, key=lambda r: r["h"])
    x = np.concatenate([np.zeros((0, WIDTH), np.uint8), *(np.frombuffer(r["x"], np.uint8).reshape(-1, WIDTH) for r in rows)])
    y = np.concatenate([np.zeros(0), *(np.frombuffer(r["y"]) for r in rows)])
    if y.sum() < 8 or y.sum() > len(y) - 8:
        return None
    return CharNet().fit(x, y, recall)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(texts: list[str], net: CharNet | None) -> list[tuple[list, list]]:
    """(base findings, all findings) of each text."""
    base = [base_spans(t) for t in texts]
    extra: list[list] = [[] for _ in texts]
    if net is not None:
        where = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t, base[i])]
        seen = [windows(texts[i], a, b) for i, a, b in where]
        if where:
            score = net.score(np.array([w for own in seen for w in own], np.uint8))
            score = np.maximum.reduceat(score, np.cumsum([0, *map(len, seen[:-1])]))
            for (i, a, b), s in zip(where, score, strict=True):
                if s >= net.threshold:
                    extra[i].append(("network", a, b))
    return [(x, sorted(x + e, key=lambda s: (s[1], KINDS.index(s[0])))) for x, e in zip(base, extra, strict=True)]


def scan(docs: DataFrame, net: CharNet | None) -> DataFrame:
    """SCHEMA: counts, digest and spans (code points, end exclusive) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                rows = []
                for base, spans in find([t or "" for t in part.column(1).to_pylist()], net):
                    kinds = [k for k, _, _ in base]
                    rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in cols)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, net: CharNet | None, mark: str = "[secret]") -> DataFrame:
    """docs with every finding replaced by `mark`; n_chars follows. No row is dropped."""

    def clean(texts: pd.Series) -> pd.Series:
        known = [t if isinstance(t, str) else None for t in texts]
        out = []
        for t, (_, spans) in zip(known, find([t or "" for t in known], net), strict=True):
            if t is None or not spans:
                out.append(t)
                continue
            parts, end = [], 0
            for _, a, b in spans:
                if a >= end:
                    parts += [t[end:a], mark]
                end = max(end, b)
            out.append("".join(parts) + t[end:])
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(clean, "string")
    made = docs.withColumn("text", udf("text"))
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
