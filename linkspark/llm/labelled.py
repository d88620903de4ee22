"""Bounded samples of labelled training documents, and small numpy training helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Rows whose labels are never learned from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod)) == rest, F.lit(True))


def label_sample(labels: DataFrame, label: str, mod: int, rest: int, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most most[y] training rows of each class, those of smallest hash; and how many
    training rows each class has in all. Several labels of one document count as the larger."""
    rows = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    rows = rows.where(~held_out(F.col("doc_id"), mod, rest))
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionByName(p)
    return sample, size


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(z: np.ndarray, y: np.ndarray, size: dict[int, int], steps: int = 40) -> tuple[float, float]:
    """(scale, shift) of a logistic calibration of z, with each class weighted by its true size."""
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    w = np.where(y == 1, size.get(1, 0) / n[1], size.get(0, 0) / n[0])
    w = w / w.mean()
    t = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x, a = np.stack((z, np.ones_like(z)), 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ a)
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        a = a - np.clip(np.linalg.solve(hess, x.T @ (w * (p - t)) + 1e-3 * (a - [1.0, 0.0])), -1, 1)
    return float(max(a[0], 1e-3)), float(a[1])


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.999 * self.s[k] + 0.001 * g * g
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)
