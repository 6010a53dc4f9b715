"""Shared by the two learned scorers: a bounded labelled sample, Adam, and calibration of document scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.shared import in_one_task, written

SAMPLE = 1500
CHARS = 12_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = SAMPLE, chars: int = CHARS) -> tuple[DataFrame, tuple[int, int]]:
    """A bounded sample (o, text, y) of the documents that `learn` (over doc_id) admits, and how many labelled documents each class has in all.

    Bound: per_class documents of each class and `chars` characters of them, taken whole in the order of their ids' hashes. A
    document that the rest of `chars` can't hold is passed over for learning and the next is looked at, so length by itself rules
    out a text of over `chars` only. Ids with labels of both kinds count as 1; other labels and labels of ids that docs lacks are
    passed over; rows that repeat an id and a text count once.
    """
    labelled = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    there = docs.select("doc_id").where(F.col("doc_id").isNotNull()).where(learn).distinct()
    known = written(labelled.join(there, "doc_id", "left_semi"), "known")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # per_class rows of each class at most, so the broadcast is bounded
    met = written(texts.join(F.broadcast(picked), "doc_id").select("doc_id", F.xxhash64("text").alias("t"), F.length("text").alias("n"), "y", order.alias("o")).distinct(), "labelled")
    admitted = []
    for y in (0, 1):
        left = chars
        # numbers only, per_class rows
        for r in met.where(F.col("y") == y).orderBy("o", "doc_id", "t").limit(per_class).collect():
            if r["n"] <= left:
                admitted.append((r["doc_id"], r["t"], int(y)))
                left -= r["n"]
    admitted = docs.sparkSession.createDataFrame(admitted, f"doc_id {dict(docs.dtypes)['doc_id']}, t long, y int")
    chosen = texts.withColumn("t", F.xxhash64("text")).join(F.broadcast(admitted), ["doc_id", "t"]).groupBy("doc_id", "t", "y").agg(F.first("text").alias("text"))
    return chosen.select(order.alias("o"), "text", "y"), (sizes.get(0, 0), sizes.get(1, 0))


def fitted(sample: DataFrame, totals: tuple[int, int], train: Callable):
    """train(texts, y, totals) over a bounded sample (o, text, y), in one task of the cluster; only the model, of fixed size, comes to the driver."""
    return in_one_task(sample, lambda rows: train([t for _, t, _ in rows], np.array([y for *_, y in rows], np.float32), totals))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.params[k] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrated(features: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression with a bias in the last place, by Newton's method with a small ridge."""
    x = np.hstack([features, np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + 1e-2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w
