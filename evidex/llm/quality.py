"""Quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of PASSAGE words (words are [^\\x20\\x09-\\x0D]+; a wordless text is one empty passage). Every
passage is encoded: shares of its byte values, word lengths, repeated neighbours and distinct words go through a layer of tanh
units. Gated attention, tanh(V h) times the logistic of U h, weighs the passages of a document, and the weighted mean of their
codes is scored by a logistic unit. All weights, attention included, are learned from document labels alone.

Training takes a bounded sample of labelled documents (learning.labelled_sample) in one task; a fifth of it is held back for calibration, with
weights that restore the share of each class. Whole texts are scored, whatever their length.

Odd input: null counts as empty, and empty texts get the score of an empty passage; labels other than 0 and 1 are passed over;
with no labelled document of one class all scores are the share of label 1 (0 without labels); rows that repeat give
repeated rows; an empty table gives none; columns other than doc_id and text are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidex.llm.arrays import BASE, LOWER, mix, slices, word_hashes, words
from evidex.llm.learning import Adam, calibrated, fitted, labelled_sample, sigmoid
from evidex.llm.shared import crc_remainder, table

PASSAGE = 64
CODE = 24
GATE = 12
EPOCHS = 30
BATCH = 64
SEED = 4
THRESHOLD = 0.7

#: Byte classes: 0 to 127 by themselves, the others by their high bits.
CLASS = np.minimum(np.arange(256), 128 + (np.arange(256) - 128) // 16).astype(np.int64)
CLASSES = 136
EXTRA = 9
FEATURES = CLASSES + EXTRA


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each text's first passage (one more at the end)."""
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE))
    bag = np.concatenate(([0], np.cumsum(count)))
    total = int(bag[-1])
    doc = np.repeat(np.arange(len(n)), n)
    passage = bag[:-1][doc] + (np.arange(len(starts)) - first[:-1][doc]) // PASSAGE
    held = np.bincount(passage, minlength=total).astype(np.float64)
    some = np.maximum(held, 1)
    sizes = ends - starts
    # a byte between words belongs to the word before it, or to the text's first passage
    if len(data):
        word = np.searchsorted(starts, np.arange(len(data)), side="right") - 1
        text = np.repeat(np.arange(len(n)), np.diff(offsets))
        own = np.where((word >= first[:-1][text]) if len(starts) else False, passage[np.maximum(word, 0)] if len(starts) else 0, bag[:-1][text])
        shares = np.bincount(own * CLASSES + CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float32)
    else:
        shares = np.zeros((total, CLASSES), np.float32)
    length = shares.sum(axis=1, keepdims=True)
    shares = np.sqrt(shares / np.maximum(length, 1))
    hashes = word_hashes(LOWER[data], starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    mean = np.bincount(passage, sizes, total) / some
    extra = np.stack(
        [
            np.log1p(held) / 4,
            mean / 8,
            np.sqrt(np.maximum(np.bincount(passage, sizes.astype(float) ** 2, total) / some - mean**2, 0)) / 8,
            np.bincount(passage, sizes <= 3, total) / some,
            np.bincount(passage, sizes >= 12, total) / some,
            np.bincount(passage, same, total) / some,
            _distinct(passage, hashes, total) / some,
            np.log1p(np.bincount(passage, sizes, total)) / 6,
            held > 0,
        ],
        axis=1,
    )
    return np.hstack([shares, extra.astype(np.float32)]), bag


def _distinct(passage: np.ndarray, hashes: np.ndarray, total: int) -> np.ndarray:
    """Number of distinct words of every passage."""
    if not len(hashes):
        return np.zeros(total)
    key = mix(passage.astype(np.uint64) * BASE) ^ hashes
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(passage[order[fresh]], minlength=total)


class Bags:
    """The model: encoder, gated attention and the scorer of the weighted code."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        f = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.p = {"e": f(FEATURES, CODE), "eb": np.zeros(CODE, np.float32), "v": f(CODE, GATE), "u": f(CODE, GATE), "w": f(GATE), "o": f(CODE), "b": np.zeros(1, np.float32)}

    def logits(self, x: np.ndarray, bag: np.ndarray, trace: dict | None = None) -> np.ndarray:
        p, at = self.p, bag[:-1]
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["e"] + p["eb"])
        a, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (a * g) @ p["w"]
        of = np.repeat(np.arange(len(at)), np.diff(bag))
        w = np.exp(e - np.maximum.reduceat(e, at)[of])
        w /= np.add.reduceat(w, at)[of]
        z = np.add.reduceat(w[:, None] * h, at, axis=0)
        if trace is not None:
            trace |= {"x": x, "h": h, "a": a, "g": g, "w": w, "z": z, "of": of}
        return z @ p["o"] + p["b"][0]

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, t = self.p, {}
        q = sigmoid(self.logits(x, bag, t))
        d = (q - y) * weight / len(y)
        dz = d[:, None] * p["o"]
        h, w, of = t["h"], t["w"], t["of"]
        dw = (dz[of] * h).sum(axis=1)
        de = w * (dw - np.add.reduceat(w * dw, bag[:-1])[of])
        ag = de[:, None] * p["w"]
        da, dg = ag * t["g"] * (1 - t["a"] ** 2), ag * t["a"] * t["g"] * (1 - t["g"])
        dh = (w[:, None] * dz[of] + da @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        grads = {"o": t["z"].T @ d, "b": d.sum(keepdims=True), "w": ((t["a"] * t["g"]) * de[:, None]).sum(axis=0), "v": h.T @ da, "u": h.T @ dg, "e": t["x"].T @ dh, "eb": dh.sum(axis=0)}
        return {k: g + 1e-4 * p[k] for k, g in grads.items()}


class Model:
    def __init__(self, bags: Bags | None, weights: np.ndarray | None, constant: float):
        self.bags, self.weights, self.constant = bags, weights, constant

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.bags is None:
            return np.full(len(offsets) - 1, self.constant)
        return sigmoid(self.bags.logits(*passages(data, offsets)) * self.weights[0] + self.weights[1])


def _some(x: np.ndarray, bag: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bag)[which]
    rows = np.repeat(bag[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return x[rows], np.concatenate(([0], np.cumsum(n)))


def train(texts: list[str], y: np.ndarray, totals: tuple[int, int], epochs: int = EPOCHS) -> Model:
    """From texts and labels 0 or 1; totals: how many labelled documents of each kind the sample stands for."""
    share = totals[1] / max(1, sum(totals))
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(None, None, share)
    rng = np.random.default_rng(SEED)
    parts = [passages(data, offsets) for _, _, data, offsets in slices(pa.array(texts, pa.string()))]
    x, bag = np.vstack([x for x, _ in parts]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))))
    del parts
    hold = np.zeros(len(y), bool)
    for c in (0, 1):
        members = rng.permutation(np.flatnonzero(y == c))
        hold[members[: max(1, len(members) // 5)]] = True
    bags = Bags(x.mean(axis=0), 1 / np.maximum(x.std(axis=0), 0.05), rng)
    adam = Adam(bags.p, 0.005)
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y == 0).sum()))
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~hold))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            adam.step(bags.gradients(*_some(x, bag, part), y[part], balance[part]))
        adam.rate *= 0.93
    weight = np.where(y > 0, totals[1] / (y > 0).sum(), totals[0] / (y == 0).sum())
    w = calibrated(bags.logits(x, bag)[hold, None].astype(float), y[hold], (weight / weight.mean())[hold])
    return Model(bags, w, share)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column(1)):
                score = held.value.documents(data, offsets).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, predicted int")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fitted(*labelled_sample(docs, labels, "quality", crc_remainder("doc_id", 4) != 2), train)
    return scored(docs, model).select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
