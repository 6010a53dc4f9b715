"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Words are runs of ASCII letters and digits (lower-cased) and of bytes from 0x80. A word's input joins a learned vector of the
word (one for all words not in the vocabulary) and the mean of learned vectors of its hashed character 4-grams. Windows of
LENGTH words, each overlapping the next by LENGTH - STRIDE, cover the whole text; a gated recurrent unit runs over a window in
either direction, attention pools the states, and a logistic unit scores the pool. A document's score is a calibrated logistic
function of its highest window logit and of the log of its number of windows.

Training takes a bounded sample of labelled documents (learning.labelled_sample) in one task. A document's label holds for its most
suspicious windows: those with the largest log-odds of words at first, then those that the network itself scores highest.
A fifth of the sample is held back to calibrate, with weights that restore the share of each class.

Odd input: null, empty and wordless texts are scored as a window without words; labels other than 0 and 1 are passed over; with
no labelled document of one class all scores are the share of label 1 (0 without labels); rows that repeat give repeated
rows; an empty table gives none; columns other than doc_id and text are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.arrays import BASE, LOWER, mix, slices, word_hashes, words
from evidex.llm.learning import Adam, calibrated, fitted, labelled_sample, sigmoid
from evidex.llm.shared import crc_remainder, table

LENGTH = 32
STRIDE = 24
WORD_DIM = 8
CHAR_DIM = 8
HIDDEN = 8
GRAMS = 1 << 14
VOCABULARY = 20_000
EPOCHS = 6
BATCH = 256
SEED = 3

#: Bytes that stand in words, lower-cased; the others are spaces.
PLAIN = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]:
    PLAIN[_b] = LOWER[_b]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, buckets of all character grams, where each word's grams begin, and each text's first word."""
    data = PLAIN[data]
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    if not len(starts):
        return hashes, np.zeros(0, np.int64), starts, first
    sizes = ends - starts
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.repeat(starts - begin, sizes) + np.arange(sizes.sum())
    left = np.repeat(starts, sizes)
    stop = np.repeat(ends, sizes)
    code = np.zeros(len(at), np.uint64)
    for k in (-1, 0, 1, 2):
        inside = (at + k >= left) & (at + k < stop)
        byte = np.where(inside, data[np.clip(at + k, 0, len(data) - 1)], 0)
        code = code << np.uint64(8) | byte.astype(np.uint64)
    return hashes, (mix(code * BASE) % np.uint64(GRAMS)).astype(np.int64), begin, first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and number of words of every window; a text without words has one window of none."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - (LENGTH - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    begin = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, first[:-1][text] + begin, np.minimum(LENGTH, n[text] - begin)


class Network:
    """Parameters and passes. Arrays of a window batch run over (place, window, dimension)."""

    def __init__(self, vocabulary: np.ndarray, rng: np.random.Generator):
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary  # sorted hashes
        f = lambda *shape, s=0.2: rng.normal(0, s, shape).astype(np.float32)
        self.p = {"word": f(len(vocabulary) + 1, WORD_DIM, s=0.05), "gram": f(GRAMS, CHAR_DIM, s=0.05)}
        for side in "fb":
            self.p |= {f"x{side}": f(d, 3 * h), f"h{side}": f(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": f(2 * h, h), "v": f(h), "o": f(2 * h), "b": np.zeros(1, np.float32)}

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word's vector; 0 for words not in the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, index: np.ndarray, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Input vectors of words. index: rows of their vectors; grams: buckets; begin: where each word's buckets begin."""
        out = np.empty((len(index), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][index]
        if len(index):
            count = np.diff(np.append(begin, len(grams)))
            out[:, WORD_DIM:] = np.add.reduceat(self.p["gram"][grams], begin, axis=0) / count[:, None].astype(np.float32)
        return out

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, trace: list | None) -> np.ndarray:
        """States of one direction; x: gate inputs (place, window, 3 x hidden)."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            g = h @ self.p["h" + side]
            zr = 1 / (1 + np.exp(-(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            if trace is not None:
                trace.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
            h = h + mask[t] * (1 - z) * (n - h)
            out[t] = h
        return out

    def logits(self, gates: tuple[np.ndarray, np.ndarray], mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        tf, tb = ([], []) if trace is not None else (None, None)
        s = np.concatenate([self._run(gates[0], mask, "f", tf), self._run(gates[1], mask, "b", tb)], axis=2)
        u = np.tanh(s @ self.p["a"])
        e = np.where(mask[:, :, 0] > 0, u @ self.p["v"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pool = np.einsum("tn,tnd->nd", w, s)
        if trace is not None:
            trace |= {"f": tf, "b": tb, "s": s, "u": u, "w": w, "pool": pool}
        return pool @ self.p["o"] + self.p["b"][0]

    def score(self, inputs: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 4096) -> np.ndarray:
        """Logit of every window over the words' inputs."""
        padded = np.vstack([inputs, np.zeros((1, inputs.shape[1]), np.float32)])
        full = [padded @ self.p["x" + s] + self.p["c" + s] for s in "fb"]
        out = np.empty(len(start), np.float32)
        for i in range(0, len(start), most):
            at, mask = self._places(start[i : i + most], size[i : i + most], len(inputs))
            out[i : i + most] = self.logits((full[0][at], full[1][at]), mask)
        return out

    @staticmethod
    def _places(start: np.ndarray, size: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(LENGTH)[:, None]
        inside = k < size[None, :]
        return np.where(inside, start[None, :] + k, none), inside[:, :, None].astype(np.float32)

    def gradients(self, index: np.ndarray, flat: np.ndarray, count: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Of the weighted log loss over a batch. index: word rows (place, window); flat, count: the words' buckets, in that order, and how many each has."""
        p, shape = self.p, index.shape
        begin = np.cumsum(count) - count
        chars = np.add.reduceat(p["gram"][flat], begin, axis=0) / count[:, None].astype(np.float32)
        x = np.concatenate([p["word"][index], chars.reshape(*shape, CHAR_DIM)], axis=2)
        tr: dict = {}
        q = sigmoid(self.logits(tuple(x @ p["x" + s] + p["c" + s] for s in "fb"), mask, tr))
        dlogit = ((q - y) * weight / len(y)).astype(np.float32)
        g = {"o": tr["pool"].T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["o"]
        s, u, w = tr["s"], tr["u"], tr["w"]
        ds = w[:, :, None] * dpool[None]
        dw = np.einsum("nd,tnd->tn", dpool, s)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tn,tnd->d", de, u)
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["a"] = np.einsum("tni,tnj->ij", s, du)
        ds = ds + du @ p["a"].T
        dx = np.zeros_like(x)
        for side, part in (("f", ds[:, :, :HIDDEN]), ("b", ds[:, :, HIDDEN:])):
            dh, gu = np.zeros((shape[1], HIDDEN), np.float32), np.zeros_like(p["h" + side])
            dgate = np.empty((*shape, 3 * HIDDEN), np.float32)
            for t, h, z, r, n, gn in reversed(tr[side]):
                dh = dh + part[t]
                dm = dh * mask[t]
                dn, dz = dm * (1 - z) * (1 - n * n), dm * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dgate[t] = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                gu += h.T @ dg
                dh = dh - dm * (1 - z) + dg @ p["h" + side].T
            g |= {"h" + side: gu, "x" + side: np.einsum("tni,tnj->ij", x, dgate), "c" + side: dgate.sum(axis=(0, 1))}
            dx += dgate @ p["x" + side].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], index.ravel(), dx[:, :, :WORD_DIM].reshape(-1, WORD_DIM))
        g["gram"] = np.zeros_like(p["gram"])
        np.add.at(g["gram"], flat, np.repeat(dx[:, :, WORD_DIM:].reshape(-1, CHAR_DIM) / count[:, None].astype(np.float32), count, axis=0))
        return g, float(-np.mean(weight * np.log(np.where(y > 0, q, 1 - q) + 1e-9)))


class Model:
    """A trained network with its calibration, or a constant."""

    def __init__(self, network: Network | None, weights: np.ndarray | None, constant: float):
        self.network, self.weights, self.constant = network, weights, constant

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.constant)
        features = self.features(data, offsets)
        return sigmoid(np.hstack([features, np.ones((len(features), 1))]) @ self.weights)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, grams, begin, first = tokens(data, offsets)
        text, start, size = windows(first)
        logit = self.network.score(self.network.inputs(self.network.index(hashes), grams, begin), start, size)
        top = np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(offsets) - 1))) if len(offsets) > 1 else np.zeros(0)
        return np.stack([top, np.log(np.bincount(text, minlength=len(offsets) - 1))], axis=1)


def train(texts: list[str], y: np.ndarray, totals: tuple[int, int], epochs: int = EPOCHS) -> Model:
    """From texts and labels 0 or 1; totals: how many labelled documents of each kind the sample stands for."""
    share = totals[1] / max(1, sum(totals))
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(None, None, share)
    rng = np.random.default_rng(SEED)
    parts = [tokens(data, offsets) for _, _, data, offsets in slices(pa.array(texts, pa.string()))]
    parts = [(h, g.astype(np.uint16), b, f) for h, g, b, f in parts]
    hashes, grams = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    ends = np.cumsum([[0, 0]] + [[len(g), len(h)] for h, g, _, _ in parts], axis=0)
    gram_end = np.append(np.concatenate([x[2] + e for x, e in zip(parts, ends[:, 0])]), len(grams))
    first = np.append(np.concatenate([x[3][:-1] + e for x, e in zip(parts, ends[:, 1])]), len(hashes))
    del parts
    hold = np.zeros(len(y), bool)
    for c in (0, 1):
        members = rng.permutation(np.flatnonzero(y == c))
        hold[members[: max(1, len(members) // 5)]] = True

    gram_seen = np.zeros((2, GRAMS))
    held: tuple[list, list] = ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)])
    for d in np.flatnonzero(~hold):
        held[int(y[d])].append(np.unique(hashes[first[d] : first[d + 1]]))
        gram_seen[int(y[d])][np.unique(grams[gram_end[first[d]] : gram_end[first[d + 1]]])] += 1
    n = [max(1, int(((y == c) & ~hold).sum())) for c in (0, 1)]
    found = [np.unique(np.concatenate(h), return_counts=True) for h in held]
    del held
    lexicon = np.union1d(found[0][0], found[1][0])
    seen = np.zeros((2, len(lexicon)))
    for c in (0, 1):
        seen[c, np.searchsorted(lexicon, found[c][0])] = found[c][1]
    odds = np.log((seen[1] + 0.3) / (n[1] + 1)) - np.log((seen[0] + 0.3) / (n[0] + 1))
    weight = np.where(seen.sum(axis=0) >= 3, np.abs(odds) * np.sqrt(seen.sum(axis=0)), 0)
    chosen = np.lexsort((lexicon, -weight))[:VOCABULARY]
    chosen = np.sort(chosen[weight[chosen] > 0])
    network = Network(lexicon[chosen], rng)
    # the first dimension of either vector begins as log-odds
    network.p["word"][1:, 0] = np.clip(odds[chosen], -4, 8) / 4
    network.p["word"][0, 0] = 0
    network.p["gram"][:, 0] = np.clip(np.log((gram_seen[1] + 0.5) / (n[1] + 1)) - np.log((gram_seen[0] + 0.5) / (n[0] + 1)), -2, 4) * (gram_seen.sum(axis=0) >= 3) / 4

    text, start, size = windows(first)
    index = np.append(network.index(hashes), 0)

    def over_windows(of, step: int = 2048) -> np.ndarray:
        """of(inputs of the words from a on, starts less a, sizes) for some windows at a time."""
        out = np.zeros(len(start), np.float32)
        for i in range(0, len(start), step):
            a, b = int(start[i]), int((start[i : i + step] + size[i : i + step]).max())
            inputs = network.inputs(index[a:b], grams[gram_end[a] : gram_end[b]], gram_end[a:b] - gram_end[a])
            out[i : i + step] = of(inputs, start[i : i + step] - a, size[i : i + step])
        return out

    def evidence(inputs: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(np.maximum(inputs[:, 0], 0) ** 2 + np.maximum(inputs[:, WORD_DIM], 0) ** 2)))
        return total[begin + n] - total[begin]

    heat = over_windows(evidence)
    count = np.append(np.diff(gram_end), 1)
    bucket_at = np.append(gram_end[:-1], len(grams))
    grams = np.append(grams, np.uint16(0))
    adam = Adam(network.p, 0.01)
    fit = ~hold[text]
    for epoch in range(epochs):
        order = np.lexsort((-heat, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        inner = fit[order]
        positive = order[inner & (y[text[order]] > 0) & (rank < (2 if epoch < 2 else 1))]
        negative = order[inner & (y[text[order]] == 0) & ((rank < 2) | (rng.random(len(order)) < 0.15))]
        batch = rng.permutation(np.concatenate([positive, negative]))
        lift = min(4.0, len(negative) / max(1, len(positive)))
        for i in range(0, len(batch), BATCH):
            b = batch[i : i + BATCH]
            at, mask = Network._places(start[b], size[b], len(hashes))
            target = y[text[b]]
            word = at.ravel()
            n_of = count[word]
            buckets = grams[np.repeat(bucket_at[word] - (np.cumsum(n_of) - n_of), n_of) + np.arange(n_of.sum())].astype(np.int64)
            grads, _ = network.gradients(index[at], buckets, n_of, mask, target, np.where(target > 0, lift, 1).astype(np.float32))
            adam.step(grads)
        heat = over_windows(network.score)
        adam.rate *= 0.8
    model = Model(network, None, share)
    features = np.stack([np.maximum.reduceat(heat, np.searchsorted(text, np.arange(len(y)))), np.log(np.bincount(text, minlength=len(y)))], axis=1)
    weight = np.where(y > 0, totals[1] / max(1, (y > 0).sum()), totals[0] / max(1, (y == 0).sum()))
    model.weights = calibrated(features[hold].astype(float), y[hold], (weight / weight.mean())[hold])
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by VOCABULARY, GRAMS and the dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column(1)):
                score = held.value.documents(data, offsets).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, predicted int")


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return fitted(*labelled_sample(docs, labels, "toxic", crc_remainder("doc_id", 5) != 0), train)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects, by every row's own text: rows that repeat an id are judged one by one, null is the empty text, and an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [model.value.documents(data, offsets) < 0.5 for _, _, data, offsets in slices(b.column(columns.index("text")))]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
