"""Mixing: targets, amounts, and that the drawn mix is what it says."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidex.llm import mixing as M

SHAPE = "doc_id long, text string, source string, target string, size string"


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def rows(seed=2, n=300):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        source = rng.choice(["a", "a", "a", "b", "ü", "B", None, "tiny"] if d % 40 else ["tiny"])
        source = source if source != "tiny" or d % 60 == 0 else "a"
        out.append((d, " ".join(f"d{d}w{i}" for i in range(rng.choice((1, 5, 60, 700)))), source, "", ""))
    return out + [(1000, None, "a", "", ""), (1001, " \n ", "zero", "", ""), (None, "x y", "b", "", ""), out[7], out[7]]


@pytest.mark.parametrize("block", [16, M.BLOCK])
def test_amounts(spark, block):
    data = rows()
    docs = spark.createDataFrame(data, SHAPE)
    got = M.mix_amounts(docs, block).collect()
    assert len(got) == len(data)
    size = Counter()
    for _, t, s, *_ in data:
        size[s] += len((t or "").split())
    want = plain_targets(size)
    by = {d: s for d, _, s, *_ in data}
    taken = Counter()
    for r in got:
        assert r.source_size == size[by[r.doc_id]] and r.target == pytest.approx(want[by[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[by[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, M.mix_amounts(docs.repartition(5), block).collect()))


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 97):
        df = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


SOURCES = [(0, "a", 1000, 2500.0), (1, "b", 50, 150.0), (2, "c", 7000, 3000.4)]


def test_slots_fill_shards_and_reach_targets(spark):
    got = M.slots(spark.createDataFrame(SOURCES, "rank int, source string, source_size long, target double"), 100, 10).collect()
    words = Counter()
    for r in got:
        words[r["rank"]] += r.words
    # the block of b is of 50 words
    assert words == {0: 2500, 1: 150, 2: 3000}
    assert max(Counter((r["rank"], r.epoch, r.block) for r in got).values()) == 1
    assert max(Counter((r["rank"], r.slot) for r in got).values()) == 1
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) <= 10 and len(sizes) >= 6
    # a source's slots are numbered through, shard after shard
    for rank in (0, 1, 2):
        shards = [r["shard"] for r in sorted((r for r in got if r["rank"] == rank), key=lambda r: r.slot)]
        assert shards == sorted(shards)


def test_counts_of_a_shard_are_multinomial(spark):
    sources = spark.createDataFrame([(0, "a", 400_000, 400_000.0), (1, "b", 100_000, 100_000.0), (2, "c", 300_000, 300_000.0)], "rank int, source string, source_size long, target double")
    plan = M.planned(sources, 10)
    draw = M.drawn(plan, 50).collect()
    counts = {r["rank"]: {} for r in draw}
    for r in draw:
        counts[r["rank"]][r["shard"]] = r.n
    assert all(sum(c.get(k, 0) for c in counts.values()) == 50 for k in range(1600))
    for rank, p in ((0, 0.5), (1, 0.125), (2, 0.375)):
        n = [counts[rank].get(k, 0) for k in range(1600)]
        mean = sum(n) / 1600
        variance = sum((x - mean) ** 2 for x in n) / 1599
        assert mean == pytest.approx(50 * p, abs=5 * math.sqrt(50 * p * (1 - p) / 1600))
        assert variance == pytest.approx(50 * p * (1 - p), rel=5 * math.sqrt(2 / 1600))
    both = sum((counts[0].get(k, 0) - 25) * (counts[2].get(k, 0) - 18.75) for k in range(1600)) / 1600
    assert both == pytest.approx(-50 * 0.5 * 0.375, abs=1.5)


def test_draw_reaches_the_result(spark):
    docs = spark.createDataFrame(rows(), SHAPE)
    out = M.mix_amounts(docs, 16)
    assert all(sum(s.words for s in r.shards) == r.taken for r in out.collect())
    assert "shard" in out._jdf.queryExecution().optimizedPlan().toString()
    # M.slots stands on the counts drawn
    assert "slot" in M.mix(docs, 16)[1].columns and "shard" in M.mix(docs, 16)[1].columns


def test_documents(spark):
    data = rows(4, 80)
    docs = spark.createDataFrame(data, SHAPE)
    out = M.mixed_documents(docs, 16)
    assert out.columns == docs.columns
    words, got = Counter(), out.collect()
    texts = {d: t for d, t, *_ in data}
    for r in got:
        words[r.doc_id] += len((r.text or "").split())
        assert set((r.text or "").split()) <= set((texts[r.doc_id] or "").split())
    want = Counter()
    for r in M.mix_amounts(docs, 16).collect():
        want[r.doc_id] += r.taken
    assert +words == +want
    assert sorted(map(repr, got)) == sorted(map(repr, M.mixed_documents(docs, 16).collect()))


def test_rows_that_share_an_id_keep_their_texts(spark):
    data = [(7, "one " * 100, "a", "x", "y"), (7, "two " * 90, "b", "x", "y"), (7, "three " * 80, "a", "p", "q"), (7, "three " * 80, "a", "p", "q"), (None, "four " * 70, None, None, None), (8, None, "a", "", ""), (9, "five " * 60000, "b", "", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, row string, `a.b` string")
    words = Counter()
    for r in M.mixed_documents(docs).collect():
        assert (r["row"], r["a.b"]) in {(x[3], x[4]) for x in data if x[0] == r.doc_id and (not r.text or set(r.text.split()) == set(x[1].split()))}
        words.update((r.text or "").split())
    taken = {(r.doc_id, r["size"]): r.taken for r in M.mix_amounts(docs).collect()}
    both = [r.taken for r in M.mix_amounts(docs).collect() if r["size"] == 80]
    assert words == Counter({"one": taken[7, 100], "two": taken[7, 90], "three": sum(both), "four": taken[None, 70], "five": taken[9, 60000]})


def test_empty(spark):
    docs = spark.createDataFrame([], SHAPE)
    assert M.mix_amounts(docs).count() == 0
    assert M.mixed_documents(docs).count() == 0
