"""The pipeline's near-copies against exact Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline as P
from evidex.llm import simhash_dedup as S

SHAPE = "doc_id long, text string, keys string, size string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def brute(rows):
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((r[0], least.get(root(i))) for i, r in enumerate(rows)), key=repr)


def corpus(seed, n=60, copies=4):
    """Every text and copies of it with 1 to 4 % of its words replaced; a shared passage in many."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    passage, rows = [word() for _ in range(30)], []
    for _ in range(n):
        base = [word() for _ in range(rng.choice((4, 7, 12, 40, 100, 300, 1000)))] + passage * rng.randrange(2)
        rows.append(base)
        for _ in range(copies):
            rows.append([word() if rng.random() < rng.choice((0.005, 0.01, 0.02, 0.04)) else w for w in base])
    rng.shuffle(rows)
    texts = [" ".join(r) for r in rows] + [None, "", " \n", rows[0] and " ".join(rows[0]).upper()]
    out = [(d, t, "", "") for d, t in enumerate(texts)]
    return out + [(None, texts[1], None, None), out[2], out[2]]


@pytest.mark.parametrize("hot, chunk", [(S.HOT, S.SET_CHUNK), (3, 500)])
def test_against_all_pairs(spark, hot, chunk):
    rows = corpus(4)
    got = S.near_copy_components(spark.createDataFrame(rows, SHAPE), hot=hot, chunk=chunk)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == brute(rows)


def test_stage_drops_planted_near_copies(spark):
    rng = random.Random(2)
    rows = []
    for d in range(80):
        w = ["w%d" % rng.randrange(9000) for _ in range(200)]
        other = list(w)
        for i in range(d % 4 + 1):
            other[20 + 40 * i] = "changed%d" % d
        rows += [(d, " ".join(w), "", ""), (1000 + d, " ".join(other), "", "")]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        assert 0.8 <= len(a & b) / len(a | b) < 0.96
    kept = {r.doc_id for r in P.drop_near_copies(spark, spark.createDataFrame(rows, SHAPE), "").collect()}
    assert kept == set(range(80))


def test_bound_of_bits_is_wide_enough():
    rng, worst = np.random.default_rng(5), 0
    for n in [*range(5, 30), 50, 100, 400]:
        for extra in {(0, n // 4), (n // 9, n // 9)}:
            for _ in range(60):
                s = rng.integers(0, 1 << 63, n + sum(extra)).astype(np.uint64)
                a, b = np.sort(s[: n + extra[0]]), np.sort(np.concatenate([s[:n], s[n + extra[0] :]]))
                worst = max(worst, int(np.bitwise_count(S.sketch(a).view(np.uint64) ^ S.sketch(b).view(np.uint64)).sum()))
    assert worst < S.NEAR_BITS - 10


def test_rows_that_share_an_id(spark):
    rng = random.Random(9)
    a, b = (" ".join("w%d" % rng.randrange(9000) for _ in range(100)) for _ in range(2))
    near = a + " more"
    rows = [(3, a, "x", ""), (5, a, "y", ""), (5, b, "y", ""), (5, b, "z", ""), (5, near, "", ""), (None, near, "", ""), (None, "apart", "", ""), (None, "apart", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, gone_id string")
    got = sorted(((r.doc_id, r.text, r.t) for r in S.drop_near_copies(docs).collect()), key=repr)
    assert got == sorted([(3, a, "x"), (5, b, "y"), (5, b, "z"), (None, "apart", ""), (None, "apart", "")], key=repr)


def test_small_tables(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert S.near_copy_components(empty).count() == 0 and S.drop_near_copies(empty).columns == empty.columns


def test_pivots_lose_no_link():
    rng = np.random.default_rng(3)
    sets = []
    for n in [0, *range(1, 60), 100, 300, 1000, 30_000]:
        s = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        # pairs at exactly 0.8 where n allows it: shared, and a ninth of it on either side or a quarter on one
        sets += [np.sort(s[:n]), np.sort(s[: n + n // 4]), np.sort(s[: n + n // 9]), np.sort(np.concatenate([s[:n], s[n + n // 9 : n + n // 9 * 2]]))]
    at, size = np.arange(0, len(sets), 4), np.array([len(s) for s in sets])
    table = S.pivot_distances(sets).astype(np.int16)
    for a, b in [(0, 0), (0, 1), (0, 2), (2, 3)]:
        assert len(S.undiscarded(table, size, at + a, at + b)) == len(at)
    for i in (5, 50, 100):
        h = sets[4 * i % len(sets)]
        part = h[h % np.uint64(24) == 7]
        unset = int((part >> np.uint64(32) & np.uint64(1) == 0).sum())
        assert table[4 * i % len(sets), 7] == len(part) - 2 * unset


def test_pivots_discard_before_sets_are_looked_at(spark, monkeypatch):
    rng, rows, kept = random.Random(6), [], {}
    for d in range(60):
        w = ["w%d" % rng.randrange(90_000) for _ in range(54)]
        other = list(w)
        for i in (2, 27, 51):
            other[i] = "changed%d" % d
        rows += [(d, " ".join(w), "", ""), (1000 + d, " ".join(other), "", "")]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        assert 0.55 < len(a & b) / len(a | b) < 0.7
    write = S.written
    monkeypatch.setattr(S, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    got = S.near_copy_components(spark.createDataFrame(rows, SHAPE))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(r[0], r[0]) for r in rows}
    # all these pairs share shingles and have like sketches; without pivots most would be read again as whole sets
    assert kept["near-clusters"].count() < 40
