"""The Kneser-Ney model against a plain version over dictionaries."""

import math
import os
import random
import re
import resource
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidex.llm import kneser_ney as K
from evidex.llm.shared import crc_remainder

SHAPE = "doc_id long, text string, score string, n_tokens string"


def discounts(values):
    n = Counter(min(v, 5) for v in values)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
    raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
    return [min(max(d, 0.05), c - 0.05) for d, c in zip(raw, (1, 2, 3))]


def plain(rows):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]
    train = [cut(t) for d, t, *_ in rows if zlib.crc32(str("" if d is None else d).encode()) % 5 != 1]
    uni, bi = Counter(), Counter()
    for t in train:
        uni.update(t)
        bi.update(zip(["<s>", *t], t))
    total, follow, cont = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (u, w), c in bi.items():
        total[u] += c
        follow[u][min(c, 3) - 1] += 1
        cont[w] += 1
    d, low = discounts(bi.values()), discounts(cont.values())
    n, v = sum(uni.values()), len(uni)

    def lower(w):
        mass = sum(low[min(c, 3) - 1] for c in cont.values()) / len(bi)
        return max(cont[w] - (low[min(cont[w], 3) - 1] if cont[w] else 0), 0) / len(bi) + mass / (v + 1)

    def prob(u, w):
        if not total[u]:
            return lower(w)
        c = bi[u, w]
        return max(c - (d[min(c, 3) - 1] if c else 0), 0) / total[u] + sum(a * b for a, b in zip(d, follow[u])) / total[u] * lower(w)

    out = []
    for d_, t, *_ in rows:
        t = cut(t)
        out.append((d_, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), sum(math.log10(prob(u, w)) for u, w in zip(["<s>", *t], t))))
    return out, prob, uni


def compare(spark, rows, per_bucket):
    docs = spark.createDataFrame(rows, SHAPE)
    held = crc_remainder("doc_id", 5) == 1
    got = sorted((tuple(r) for r in K.scored(docs, K.count(docs, ~held, per_bucket)).collect()), key=repr)
    want, prob, uni = plain(rows)
    want = sorted(want, key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)
    return prob, uni


def test_against_dictionaries(spark):
    rng = random.Random(1)
    lexicon = ["The", "of", "straße", "été", "x" * 300, "word,"] + ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(rng.choices(lexicon, [40, 20, 9, 9, 1, 1] + [1 / (1 + i) for i in range(400)], k=rng.randrange(60))), "s", "n") for i in range(80)]
    rows += [(90, None, None, None), (91, "", "", ""), (92, "the " * 3000, "", ""), (None, "The of \t\n THE", "", ""), rows[5], rows[5]]
    prob, uni = compare(spark, rows, 300)
    for u in ("the", "<s>", "w1"):
        assert sum(prob(u, w) for w in [*uni, "never seen"]) == pytest.approx(1)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "", ""), (2, None, "", "")], SHAPE)
    got = sorted(tuple(r) for r in K.scored(docs, K.count(docs, F.lit(False))).collect())
    assert [g[:4] for g in got] == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert K.scored(docs.limit(0), K.count(docs, F.lit(True))).count() == 0


def test_more_buckets_than_open_files(spark, monkeypatch):
    """Buckets shuffled in groups, files mapped a few at a time: the scores of the model in four buckets."""
    rng = random.Random(2)
    lexicon = ["w%d" % i for i in range(3000)] + ["the"]
    rows = [(i, " ".join(rng.choices(lexicon, [1] * 3000 + [600], k=400)), "", "") for i in range(60)]
    docs = spark.createDataFrame(rows, SHAPE).repartition(2)
    held = crc_remainder("doc_id", 5) == 1
    want = sorted(tuple(r) for r in K.scored(docs, K.count(docs, ~held)).collect())
    monkeypatch.setattr(K, "PARTS", 3)
    monkeypatch.setattr(K, "OPEN", 5)
    counts = K.count(docs, ~held, 3)
    assert counts.buckets > 5000 and counts.together > 1700
    some = docs.where("doc_id < 6")  # every bucket is looked up
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    got = sorted(tuple(r) for r in K.scored(some, counts).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want[:6]]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)
    model = K.Model(counts)
    before = len(os.listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (before + 40, hard))
    try:
        for bucket in range(counts.buckets):
            model._arrays(f"pair-{bucket}")
            assert len(model.open) <= 5
        assert len(os.listdir("/proc/self/fd")) <= before + 6
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
