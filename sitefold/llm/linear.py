"""Logistic regression on sparse rows, with calibrated probabilities, and the sample it is fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_labels(labels: DataFrame, label: str, allowed: Column | None = None) -> DataFrame:
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(allowed if allowed is not None else F.lit(True))
    return rows.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))


def class_sizes(rows: DataFrame) -> dict[int, int]:
    """Two numbers: the labelled documents of each class."""
    return {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, allowed: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of about ``bound`` labelled documents, half of each class where there are as many.

    Which ones follows from a hash of doc_id. Rows without an id or a label don't count; of several
    labels the largest counts. Only the ids of the sample, at most about ``bound``, are broadcast.
    """
    rows = known_labels(labels, label, allowed)
    counts = class_sizes(rows)
    each = {c: min(n, max(bound // 2, bound - counts.get(1 - c, 0))) for c, n in counts.items()}
    of_all = 1 << 30
    share = F.when(F.col("label") == 1, F.lit(int(of_all * each.get(1, 0) / max(1, counts.get(1, 0))))).otherwise(F.lit(int(of_all * each.get(0, 0) / max(1, counts.get(0, 0)))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(of_all)) < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(index: np.ndarray, value: np.ndarray, row: np.ndarray, label: np.ndarray, size: int, steps: int = 150, ridge: float = 1e-4, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept by full gradients with Adam; ``row`` must be sorted. Classes weigh alike."""
    n = len(label)
    w, b = np.zeros(size), 0.0
    balance = np.where(label > 0, 0.5 / max(1, label.sum()), 0.5 / max(1, n - label.sum()))
    edges = np.unique(np.append(np.searchsorted(row, row[:: 1 << 20]), len(row)))  # whole rows, about a million entries each
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = ridge * w, 0.0
        z = np.full(n, b)
        for i, j in zip(edges, edges[1:]):  # noqa: B905
            z += np.bincount(row[i:j], w[index[i:j]] * value[i:j], n)
        r = (sigmoid(z) - label) * balance
        gb = r.sum()
        for i, j in zip(edges, edges[1:]):  # noqa: B905
            g += np.bincount(index[i:j], value[i:j] * r[row[i:j]], size)
        m, mb, v, vb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb, 0.99 * v + 0.01 * g * g, 0.99 * vb + 0.01 * gb * gb
        step = rate * min(1, 4 * (1 - t / (steps + 1)))
        up, down = 1 - 0.9**t, 1 - 0.99**t
        w -= step * (m / up) / (np.sqrt(v / down) + 1e-9)
        b -= step * (mb / up) / (np.sqrt(vb / down) + 1e-9)
    return w, b


def calibrate(z: np.ndarray, label: np.ndarray, prior: float | None = None) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities (Platt), with smoothed targets."""
    pos, neg = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1) if len(z) else np.zeros((0, 2))
    for _ in range(50):
        p = sigmoid(a * z + c)
        h = x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-3 * np.eye(2)
        da, dc = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * np.array([a - 1, c]))
        a, c = a - float(np.clip(da, -2, 2)), c - float(np.clip(dc, -2, 2))
    return max(a, 1e-3), c
