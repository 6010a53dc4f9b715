"""SimHash components against all pairs."""

import random

import pytest
import xxhash

from evidex.llm import simhash_dedup as S

SHAPE = "text string, doc_id long, fp string, n string"


def print_of(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> k & 1 for g in grams) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(grams))


def brute(rows):
    prints = [print_of(t) for t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (_, d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{p:016x}", least.get(root(i))) for i, ((_, d, *_), p) in enumerate(zip(rows, prints))), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(50)] + ["Été", "STRASSE", "x y"]
    rows = []
    for d in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[0].split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((" ".join(w), d, "", ""))
        else:
            rows.append((" ".join(rng.choices(words, k=rng.choice((1, 2, 3, 40, 200)))), d, "", ""))
    return rows + [(None, n, None, None), ("", n + 1, "", ""), (" \t\n\v", n + 2, "", ""), (rows[0][0], None, "", ""), rows[1], rows[1], ("z " * 30000, n + 3, "", "")]


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(S.links, "__defaults__", (S.BITS, hot))
    rows = corpus(120, 3)
    docs = spark.createDataFrame(rows, SHAPE)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()), key=repr)
    assert got == brute(rows)


def test_search_finds_every_component(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")

    def classes(pairs):
        parent = {p: p for p in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {p: root(p) for p in signed}

    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    for hot in (S.HOT, 3):
        assert classes([(r.a, r.b) for r in S.links(fps, hot=hot).collect()]) == classes(close)


def test_kept_and_empty(spark):
    docs = spark.createDataFrame([("a b c d", 5, "", ""), ("a b c d", 3, "", ""), ("other text here now", 9, "", "")], SHAPE)
    assert sorted(r.doc_id for r in S.drop_near_copies(docs).collect()) == [3, 9]
    assert S.drop_near_copies(docs).columns == docs.columns
    assert S.simhash_components(docs.limit(0)).count() == 0
