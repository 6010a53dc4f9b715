"""The Merkle manifest against a tree built leaf by leaf with hashlib."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from evidex.llm import merkle as M
from evidex.llm.merkle_sql import OP13_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    d, text, lang, source, n = row[:5]
    values = (d, source, lang, n if n is None else n + more, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes, fan):
    """The root, and for each place (proof, path as (runs' other members with the place within the run))."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[k : k + fan]) for k in range(0, len(below), fan)])
    paths = []
    for place in range(len(hashes)):
        path = []
        for below in levels[:-1]:
            run = below[place // fan * fan : place // fan * fan + fan]
            path.append((run, place % fan))
            place //= fan
        paths.append(path)
    return levels[-1][0], paths


def plain(rows, fan=2):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, found = [], {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        found[g] = (members, *climb([leaf(r) for r in members], fan))
        tops.append(found[g][1])
    if not rows:
        return []
    root, upper = climb(tops, fan)
    out = []
    for g, above in zip(order, upper):
        members, subroot, paths = found[g]
        for row, path in zip(members, paths):
            own = leaf(row)
            tampered = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 7 == 0
            folded = leaf(row, 1) if tampered else own
            siblings = []
            for run, k in path + above:
                siblings += run[:k] + run[k + 1 :]
                folded = h(*run[:k], folded, *run[k + 1 :])
            out.append((row[0], own, subroot, root, h(*siblings), folded, folded == root, "".join(siblings)))
    return out


def rows(n=500):
    rng = random.Random(8)
    langs = ["en"] * 6 + ["de", "zh-漢", "", "é", None]
    made = [(i, rng.choice([None, "", "some text\n", "漢字 é" * rng.randrange(9), "x" * rng.randrange(300)]), rng.choice(langs), rng.choice(["web", None, ""]), rng.choice([None, i, -5])) for i in range(n)]
    made += [(7, "again", "en", "web", 5)] * 3 + [(7, "again", "en", "web", 6), (None, None, None, None, None), (None, "x", "en", None, 2**63 - 1), (-4, "x" * 2_000_000, "en", "web", 1), (9, "alone", "xx", "w", 9)]
    return [(*r, "a column named leaf", k) for k, r in enumerate(made)]


def got(df, siblings):
    hexed = [x if x in ("id", "verified") else f"lower(hex({x}))" for x in ("id", "leaf", "subroot", "root", "proof", "folded")]
    return [tuple(r) for r in df.selectExpr(*hexed, "folded = root", *["lower(hex(siblings))"] * siblings).collect()]


@pytest.mark.parametrize("fan, subtree", [(2, 4096), (2, 8), (3, 9), (5, 5)])
def test_rows(spark, monkeypatch, fan, subtree):
    monkeypatch.setattr(M, "SUBTREE", subtree)
    monkeypatch.setattr(M, "HELD", 50)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = got(M.manifest(M.document_leaves(docs), fan, siblings=True), True)
    assert sorted(found, key=repr) == sorted(plain(rows(), fan), key=repr)


@pytest.mark.parametrize("some", [[], rows(500)[:1], [(1, None, None, None, None, "", 0)] * 40])
def test_few_rows(spark, some):
    found = got(M.manifest(M.document_leaves(spark.createDataFrame(some, SCHEMA)), 2), False)
    assert sorted(found, key=repr) == sorted((r[:-1] for r in plain(some)), key=repr)


def test_query_against_sql(spark, tmp_path):
    some = [r for r in rows(200) if r[4] is None or r[4] < 2**62]
    spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    query = M.op13_merkle_manifest(spark, str(tmp_path))
    con = duckdb.connect()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    con.register("documents", pa.Table.from_pylist([dict(zip(names, r)) for r in some], pa.schema([(c, pa.int64() if c in ("doc_id", "n_chars") else pa.string()) for c in names])))
    want = con.sql(OP13_SQL)
    assert query.columns == want.columns
    found = sorted(map(tuple, query.collect()), key=repr)
    assert found == sorted(want.fetchall(), key=repr) == sorted((r[:-1] for r in plain(some)), key=repr)
    assert not all(r[-1] for r in found) and any(r[-1] for r in found)


def test_midstates_are_sha256():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(9)]
    state = np.repeat(M.START, 1, axis=1)
    for n, digest in enumerate(digests):
        assert M.as_bytes(M.ended(state, np.array([n])))[0].tobytes() == hashlib.sha256("".join(d.hex() for d in digests[:n]).encode()).digest()
        state = M.fed(state, M.words(pa.array([digest])))


def test_folding_resumes_the_state_before_the_slot():
    """Siblings on the left of a replaced child are not looked at."""
    digests = M.words(pa.array([hashlib.sha256(bytes([i])).digest() for i in range(6)]))
    level = M.Level.over(np.zeros(6, int), np.arange(6), digests, 3)[0]
    level.digest[:, [0, 1, 3]] = 0
    other = hashlib.sha256(b"other").digest()
    folded = M.as_bytes(level.folded(np.array([2, 4]), M.words(pa.array([other, other]))))
    text = lambda i: hashlib.sha256(bytes([i])).hexdigest()
    assert folded[0].tobytes().hex() == h(text(0), text(1), other.hex())
    assert folded[1].tobytes().hex() == h(text(3), other.hex(), text(5))
