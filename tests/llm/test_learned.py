"""The learned scorers: held-out accuracy, gradients, and odd input."""

import math
import random
import re

import numpy as np
import pytest

from evidex.llm import quality as Q
from evidex.llm import toxicity as T
from evidex.llm.shared import crc_remainder

DOCS = "doc_id long, text string, lang string, score string, y string"
SYLLABLES = ["ba", "ko", "ri", "ten", "lu", "été", "öd", "sa"]
BAD = ["scoundrel", "vermin", "wretch"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4))) for _ in range(n)]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        w = words(rng, rng.choice((5, 40, 300)))
        y = int(rng.random() < 0.3)
        for _ in range(y * rng.randrange(2, 5)):
            w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ",", "s"]))
        out.append((d, " ".join(w), y))
    return out


def quality_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        w, y = words(rng, rng.choice((8, 60, 500))), int(rng.random() < 0.7)
        if not y:
            w = [x + rng.choice(["$$$", "###", "%%"]) for x in w] if rng.random() < 0.5 else [w[0]] * len(w)
        out.append((d, " ".join(w), y))
    return out


def numeric(f, x, i, eps=1e-3):
    old = x.flat[i]
    x.flat[i] = old + eps
    up = f()
    x.flat[i] = old - eps
    down = f()
    x.flat[i] = old
    return (up - down) / (2 * eps)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = T.Network(np.arange(1, 9, dtype=np.uint64), rng)
    net.p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in net.p.items()}
    index, mask = rng.integers(0, 9, (T.LENGTH, 3)), np.ones((T.LENGTH, 3, 1))
    mask[20:, 1] = 0
    count = np.full(index.size, 2)
    flat = rng.integers(0, 30, count.sum())
    y, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    loss = lambda: net.gradients(index, flat, count, mask, y, weight)[1]
    grads = net.gradients(index, flat, count, mask, y, weight)[0]
    for k in ("word", "gram", "xf", "hf", "cf", "xb", "hb", "a", "v", "o", "b"):
        for i in rng.integers(0, net.p[k].size if k != "gram" else 30 * T.CHAR_DIM, 3):
            assert grads[k].flat[i] == pytest.approx(numeric(loss, net.p[k], i), abs=2e-3)


def test_quality_gradients():
    rng = np.random.default_rng(0)
    bags = Q.Bags(np.zeros(Q.FEATURES), np.ones(Q.FEATURES), rng)
    bags.p = {k: v.astype(np.float64) for k, v in bags.p.items()}
    x, bag, y, weight = rng.normal(size=(7, Q.FEATURES)), np.array([0, 1, 4, 7]), np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        q = Q.sigmoid(bags.logits(x, bag))
        return float(-np.mean(np.log(np.where(y > 0, q, 1 - q)))) + 5e-5 * sum(float((v * v).sum()) for v in bags.p.values())

    grads = bags.gradients(x, bag, y, weight)
    for k, v in bags.p.items():
        for i in rng.integers(0, v.size, 3):
            assert grads[k].flat[i] == pytest.approx(numeric(loss, v, i), abs=2e-3)


@pytest.mark.parametrize("module, rows, at", [(T, toxic_rows, 0.5), (Q, quality_rows, 0.7)])
def test_held_out_accuracy(module, rows, at):
    train, test = rows(700, 1), rows(300, 2)
    totals = tuple(sum(y == c for *_, y in train) for c in (0, 1))
    model = module.train([t for _, t, _ in train], np.array([y for *_, y in train], np.float32), totals)
    raw = [t.encode() for _, t, _ in test]
    score = model.documents(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))))
    assert np.mean((score >= at) == np.array([y for *_, y in test])) >= 0.93
    one = model.documents(np.frombuffer(raw[7], np.uint8), np.array([0, len(raw[7])]))
    assert one[0] == pytest.approx(score[7], abs=1e-4)


@pytest.mark.parametrize("module, rows, label, learn", [(T, toxic_rows, "toxic", (5, 0)), (Q, quality_rows, "quality", (4, 2))])
def test_tables(spark, module, rows, label, learn):
    from evidex.llm.learning import fitted, labelled_sample

    learn = crc_remainder("doc_id", learn[0]) != learn[1]
    data = rows(200, 3)
    odd = [(1000, None), (1001, ""), (1002, "$$$"), (1003, "word " * 60000), (None, "a b"), (5, data[5][1])]
    docs = spark.createDataFrame([(d, t, "x", "y", "z") for d, t, *_ in [*data, *odd]], DOCS)
    labels = spark.createDataFrame([(d, y, "x") for d, _, y in data] + [(3, None, ""), (4, 7, ""), (None, 1, ""), (5, data[5][2], "")], f"doc_id long, {label} int, text string")
    sample, totals = labelled_sample(docs, labels, label, learn, 40)
    y = [r.y for r in sample.collect()]
    assert y.count(0) <= 40 and y.count(1) <= 40 and sum(totals) <= 200
    model = fitted(sample, totals, lambda *a: module.train(*a, epochs=1))
    got = module.scored(docs, model).collect()
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 for r in got)
    again = module.scored(docs, fitted(labelled_sample(docs.repartition(5), labels, label, learn, 40)[0], totals, lambda *a: module.train(*a, epochs=1)))
    assert sorted(map(repr, got)) == sorted(map(repr, again.collect()))
    none = fitted(*labelled_sample(docs, labels.limit(0), label, learn), module.train)
    assert {r.score for r in module.scored(docs, none).collect()} == {0.0}
    assert module.scored(docs.limit(0), none).count() == 0


def test_sample_is_bounded_by_characters_not_by_length(spark):
    from evidex.llm.learning import labelled_sample

    rows = [(d, "long word " * 30_000 if d % 2 else "short", "", "", "") for d in range(20)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(d, int(d >= 10)) for d in range(20)], "doc_id long, toxic int")
    every = labelled_sample(docs, labels, "toxic", crc_remainder("doc_id", 5) >= 0)[0].collect()
    assert sum(len(r.text) > 100_000 for r in every) == 10 and len(every) == 20
    some = labelled_sample(docs, labels, "toxic", crc_remainder("doc_id", 5) >= 0, chars=700_000)[0].collect()
    assert sum(len(r.text) > 100_000 for r in some) == 4 and len(some) == 14


def test_labels_without_a_document_take_no_place_in_the_sample(spark):
    from evidex.llm.learning import labelled_sample

    docs = spark.createDataFrame([(d, f"text {d}", "", "", "") for d in range(1000, 1010)] + [(1000, "text 1000", "", "", "")], DOCS)
    labels = spark.createDataFrame([(d, d % 2) for d in range(1010)], "doc_id long, toxic int")
    sample, totals = labelled_sample(docs, labels, "toxic", crc_remainder("doc_id", 5) >= 0, per_class=5)
    assert sorted(r.text for r in sample.collect()) == [f"text {d}" for d in range(1000, 1010)] and totals == (5, 5)


def softmax(values):
    top = max(values)
    e = [math.exp(v - top) for v in values]
    return [x / sum(e) for x in e]


def logistic(x):
    return 1 / (1 + math.exp(-x))


def plain_quality(model, text):
    """The score by a loop over passages of the text's words."""
    bags, p = model.bags, model.bags.p
    x, _ = Q.passages(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    codes, energy = [], []
    for row in x:
        row = (row - bags.mean) * bags.scale
        h = [math.tanh(sum(row * p["e"][:, k]) + p["eb"][k]) for k in range(Q.CODE)]
        gate = [math.tanh(sum(h[i] * p["v"][i, k] for i in range(Q.CODE))) * logistic(sum(h[i] * p["u"][i, k] for i in range(Q.CODE))) for k in range(Q.GATE)]
        codes.append(h)
        energy.append(sum(g * w for g, w in zip(gate, p["w"])))
    weights = softmax(energy)
    pooled = [sum(w * h[k] for w, h in zip(weights, codes)) for k in range(Q.CODE)]
    logit = sum(z * o for z, o in zip(pooled, p["o"])) + p["b"][0]
    return logistic(logit * model.weights[0] + model.weights[1])


def plain_toxicity(model, text):
    """The score by a loop over windows and over time. Words and their grams are cut by hand."""
    net, p, n = model.network, model.network.p, T.HIDDEN
    found = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    vectors = []
    for w in found:
        hashes, grams, _, _ = T.tokens(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
        chars = np.mean([p["gram"][g] for g in grams], axis=0)
        row = {int(h): i + 1 for i, h in enumerate(net.vocabulary)}.get(int(hashes[0]), 0)
        vectors.append(np.concatenate([p["word"][row], chars]))
    best, at, windows = -math.inf, 0, 0
    while True:
        part = vectors[at : at + T.LENGTH]
        states = {}
        for side in "fb":
            h, states[side] = np.zeros(n), []
            for x in part if side == "f" else part[::-1]:
                gx, gh = x @ p["x" + side] + p["c" + side], h @ p["h" + side]
                z, r = (np.array([logistic(v) for v in (gx + gh)[k * n : (k + 1) * n]]) for k in (0, 1))
                new = np.tanh(gx[2 * n :] + r * gh[2 * n :])
                h = z * h + (1 - z) * new
                states[side].append(h)
        both = [np.concatenate(pair) for pair in zip(states["f"], states["b"][::-1])]
        weights = softmax([float(np.tanh(s @ p["a"]) @ p["v"]) for s in both]) if both else []
        pooled = sum((w * s for w, s in zip(weights, both)), np.zeros(2 * n))
        best, windows = max(best, float(pooled @ p["o"] + p["b"][0])), windows + 1
        if at + T.LENGTH >= len(vectors):
            break
        at += T.STRIDE
    return logistic(best * model.weights[0] + math.log(windows) * model.weights[1] + model.weights[2])


@pytest.mark.parametrize("module, rows, plain", [(T, toxic_rows, plain_toxicity), (Q, quality_rows, plain_quality)])
def test_scores_against_plain_loops(module, rows, plain):
    train, test = rows(200, 5), [t for _, t, _ in rows(12, 6)] + ["one", "vermin! vermin?", "été " * 70]
    model = module.train([t for _, t, _ in train], np.array([y for *_, y in train], np.float32), (150, 50), epochs=1)
    for text in test:
        raw = text.encode()
        got = model.documents(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert got == pytest.approx(plain(model, text), abs=2e-4)
