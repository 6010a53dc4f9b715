"""Batches of like length: each text once, little padding, vectors in the rows' order."""

import random

import numpy as np

from evidex.functions import embedders as E


def test_batches_by_length():
    rng = np.random.default_rng(2)
    for lengths in (np.zeros(0, int), np.zeros(5, int), rng.integers(0, 2000, 500), np.array([10**6, 3, 3, 10**6]), np.full(400, 700)):
        batches = list(E.by_length(lengths, 20_000, 1.25))
        assert sorted(np.concatenate(batches or [np.zeros(0, int)]).tolist()) == list(range(len(lengths)))
        for b in batches:
            longest = lengths[b].max()
            assert len(b) == 1 or longest * len(b) <= 20_000
            assert longest <= E.SHORT or longest <= 1.25 * lengths[b].min()


def test_vectors_in_order(spark):
    class Counting(E.ModularEmbedder):
        """Puts the size of its batch in place of the last dimension."""

        def passages(self, texts):
            assert max(map(len, texts)) <= max(64, 1.25 * min(map(len, texts)))
            out = super().passages(texts)
            out[:, 7] = len(texts)
            return out

    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab漢 ") for _ in range(rng.choice([0, 3, 80, 500, 5000])))) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "i int, text string").repartition(3)
    plain = E.ModularEmbedder()
    got = {r.i: r for r in E.with_embedding(df, plain).collect()}
    assert len(got) == 201
    for i, t in rows:
        assert got[i].text == t and np.allclose(got[i].embedding, plain.passages([t or ""])[0])
    assert max(r.embedding[7] for r in E.with_embedding(df, Counting(), cells=10_000).collect()) > 1
    assert E.with_embedding(df.limit(0), plain).columns == ["i", "text", "embedding"]
