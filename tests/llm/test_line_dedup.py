"""Line deduplication against a brute-force version."""

import random

from evidex.llm import line_dedup as L

SHAPE = "text string, doc_id long, lang string, h1 string, first string"


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, fuzzy=L.FUZZY):
    places = sorted(
        {(d is None, d or 0, i, line) for text, d, *_ in rows for i, line in enumerate((text or "").split("\n")) if line.strip(" \t\n\v\f\r")},
    )
    gone, seen = set(), []
    for none, d, i, line in places:
        if any(line == x or (min(len(line), len(x)) >= fuzzy and near(line, x)) for x in seen):
            gone.add((none, d, i, line))
        seen.append(line)
    out = []
    for text, d, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for i, x in enumerate(lines) if (d is None, d or 0, i, x) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else text))
    return sorted(out, key=repr)


def edited(rng, line):
    i = rng.randrange(len(line) + 1)
    kind = rng.randrange(3)
    return line[:i] + ("é" if kind else "") + line[i + (kind < 2) :]


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.choice((3, 9, 10, 11, 17, 33, 64)))) for _ in range(30)] + ["aaaaaaaaaaaa", "日本語のとても長い行です", "x" * 500, "long " * 4000]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(base)
            lines.append(line if rng.random() < 0.3 else edited(rng, line) if rng.random() < 0.7 else edited(rng, edited(rng, line)))
        rows.append(("\n".join(lines), d, "en", "x", "y"))
    rows += [(None, 100, None, None, None), ("", 101, "", "", ""), (base[0], None, "", "", ""), (" \n\t\n" + base[1] + "\n", 102, "", "", ""), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, SHAPE)
    got = L.without_repeated_lines(docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == brute(rows)
    kept = L.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {100, 101, 0}


def test_bound_of_short_lines(spark):
    rows = [(f"{'x' * (n - 1)}{c}\nonly {n}{c} here", 10 * n + i, "", "", "") for n in (8, 9, 10, 11) for i, c in enumerate("abc")]
    docs = spark.createDataFrame(rows, SHAPE)
    for fuzzy in (9, 10, 11):
        got = L.without_repeated_lines(docs, fuzzy)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == brute(rows, fuzzy)
    nine = {r.doc_id: r.n_dropped for r in L.without_repeated_lines(docs, 10).collect()}
    assert nine[91] == nine[92] == 0 + 1 and nine[101] == 2 and nine[81] == 1


def test_common_lines_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT", 4)
    rows = [(f"the common line\nline {d} of its own kind {'abcdefghij'[d % 10] * 9}", d, "en", d, "f") for d in range(60)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, n_lines string, n_dropped long, flags string")
    got = L.without_repeated_lines(docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == brute(rows)
    kept = L.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r.n_lines, r.n_dropped) for r in kept.collect()} <= {(r[1], r[2], r[3]) for r in rows}


def test_shuffled_branch(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", -1)
    docs = spark.createDataFrame([("one long line here\nother", 1, "", "", ""), ("one long line herf\nelse", 2, "", "", "")], SHAPE)
    assert sorted((r.doc_id, r.text) for r in L.without_repeated_lines(docs).collect()) == [(1, "one long line here\nother"), (2, "else")]


def test_empty(spark):
    assert L.without_repeated_lines(spark.createDataFrame([], SHAPE)).count() == 0
