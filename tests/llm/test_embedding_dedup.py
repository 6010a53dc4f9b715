"""Vector deduplication against all pairs, and recall."""

import numpy as np
import pytest

from evidex.llm import embedding_dedup as E

SHAPE = "vec_id long, embedding array<float>, k long, n string"


def brute(rows, least=0.9):
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = {i: i for i in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fine:
        for b in fine:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], np.float32).astype(float) for i in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    least_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least_id[root(i)] = min(d, least_id.get(root(i), d))
    return sorted(((d, links[i], d if i not in fine else least_id.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def vectors(n=400, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.01, 0.2, 0.4, 3.0], (n, 1))
    x[5:30] = x[5]
    return [(int(i), [float(v) for v in row.astype(np.float32)]) for i, row in enumerate(x)]


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [E.CHUNK, 9])
def test_exact_with_all_safe_probes(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    rows = vectors()
    v = rows[5][1]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [None] + v[1:]), (1004, [float("nan")] + v[1:]), (1005, [float("inf")] + v[1:]), (1006, [2 * x for x in v]), (1007, v[:3]), (1008, v[:3]), (None, v), rows[7], rows[7]]
    df = spark.createDataFrame([(d, v, 0, "") for d, v in rows], SHAPE)
    assert got(E.embedding_components(df, sigmas=1e9)) == brute(rows)


def test_recall_of_production_probes(spark):
    rows = vectors(900, 64, 2)
    df = spark.createDataFrame([(d, v, 0, "") for d, v in rows], SHAPE)
    mine, want = got(E.embedding_components(df)), brute(rows)
    assert sum(m[1] for m in mine) >= 0.98 * sum(w[1] for w in want)
    assert all(m[1] <= w[1] for m, w in zip(mine, want))


def edges(n, dim, spread, seed):
    """Vectors and a near-copy of each with a cosine of 0.9 to 0.92, over dimensions of unlike weight."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(n, dim)) * spread)
    away = rng.normal(size=(n, dim)) * spread
    away = unit(away - (away * base).sum(axis=1, keepdims=True) * base)
    cosine = rng.uniform(0.9005, 0.92, (n, 1))
    return [(i, [float(v) for v in row.astype(np.float32)]) for i, row in enumerate(np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away]))]


@pytest.mark.parametrize("spread", [np.ones(64), np.geomspace(1, 0.1, 64), np.geomspace(1, 0.01, 64)])
def test_recall_just_above_the_threshold(spark, spread):
    rows = edges(450, 64, spread, 3)
    df = spark.createDataFrame([(d, v, 0, "") for d, v in rows], SHAPE)
    mine, want = got(E.embedding_components(df)), brute(rows)
    assert sum(w[1] for w in want) >= 900 and sum(m[1] for m in mine) >= 0.99 * sum(w[1] for w in want)
    assert all(m[1] <= w[1] for m, w in zip(mine, want))


def test_small_tables(spark):
    assert E.embedding_components(spark.createDataFrame([], SHAPE)).count() == 0
    df = spark.createDataFrame([(4, [1.0, 0.0], 0, ""), (2, [0.99, 0.01], 0, "")], SHAPE)
    assert got(E.embedding_components(df)) == [(2, 1, 2), (4, 1, 2)]


def test_probes_reach_neighbours_towards_another_centre():
    """Two vectors just above the threshold whose offset lies mostly along the line between two centres: one probes the other's list."""
    dim, apart = 64, np.sqrt(2 - 2 * 0.9)
    share = 0.95 * 2 * E.SIGMAS / np.sqrt(dim)  # of the offset along that line
    a, b = np.eye(dim)[0], np.eye(dim)[1]
    index = E.Index(np.stack([a, b]), 1, 0.9)
    index.centres = np.stack([a, b]).astype(np.float32)
    index.norm = (index.centres**2).sum(axis=1)
    line = (b - a) / np.sqrt(2)
    half = apart * share / 2
    side = apart * np.sqrt(1 - share**2) / 2
    middle = (a + b) / np.sqrt(2) * np.sqrt(1 - half**2 - side**2)
    pair = np.stack([middle - half * line - side * np.eye(dim)[2], middle + half * line + side * np.eye(dim)[2]])
    assert pair[0] @ pair[1] >= 0.9 - 1e-9
    own, *_, probes = index.place(pair.astype(np.float32))
    assert own.tolist() == [0, 1] and (probes[0, 1] or probes[1, 0])


def test_tiny_and_huge_vectors(spark):
    """Components whose squares vanish or overflow change no other vector's links, and link by their direction themselves."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(50, 16)), 4, axis=0) + rng.normal(size=(200, 16)) * 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = got(E.embedding_components(df))
    assert sum(n for _, n, _ in want) == 600
    odd = [(300, [1e-200] * 16), (301, [5e-324] * 16), (302, [1e300, -1e300] * 8), (303, (x[0] * 1e-170).tolist()), (304, (x[0] * 1e290).tolist())]
    both = got(E.embedding_components(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")))
    assert [r for r in both if r[0] > 3 and r[0] < 300] == [r for r in want if r[0] > 3]
    assert {r[0]: r[1:] for r in both if r[0] >= 300} == {300: (1, 300), 301: (1, 300), 302: (0, 302), 303: (5, 0), 304: (5, 0)}


@pytest.mark.parametrize("shelf", [E.SHELF if hasattr(E, "SHELF") else 0, 600])
def test_a_low_threshold_does_not_write_a_vector_for_every_list(spark, monkeypatch, shelf):
    """Where all lists are probed: links and components of all pairs, while vectors are written a bounded number of times."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24))
    x[:90] = x[0] + rng.normal(size=(90, 24)) * 0.01
    rows = [(i, [float(v) for v in row.astype(np.float32)]) for i, row in enumerate(x)]
    rows += [(2000 + i, rows[i][1]) for i in range(5)] + [(3000, None), (3001, [0.0] * 24), (None, rows[9][1])]
    df = spark.createDataFrame([(d, v, 0, "") for d, v in rows], SHAPE)
    sent, packed = spark.sparkContext.accumulator(0), E._rows

    def counted(*given):
        inner = packed(*given)

        def run(batches):
            for b in inner(batches):
                sent.add(sum(len(k) // 8 for k in b.column("k").to_pylist()))
                yield b

        return run

    monkeypatch.setattr(E, "_rows", counted)
    monkeypatch.setattr(E, "SHELF", shelf, raising=False)
    assert got(E.embedding_components(df, 0.4, float("inf"))) == brute(rows, 0.4)
    shelves = max(17, -(-700 * 24 // shelf)) | 1 if shelf else 17
    assert 700 < sent.value <= 700 * ((shelves + 1) // 2 + max(4, shelves // 4))
