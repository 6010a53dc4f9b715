"""Fill-in-middle cuts against plain slicing, ranks and selects against counting."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from evidex.llm import fill_in_middle as M

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "char": r"(?s:.)"}


def plain(doc_id, text, unit="line", seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text), text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if h[3] % 100 < spm else "psm", len(prefix), len(middle), sha(out), sha(text), out


def rows():
    rng = random.Random(5)
    fixed = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "\r\n \x0b", "has <P> in it\nx", "ends <\n> S>\n<P", "x" * 100_000, "é漢😀\n" * 40_000, " lead", "trail \t "]
    texts = fixed + ["".join(rng.choice("ab \n\té漢😀<P>SM") for _ in range(rng.randrange(200))) for _ in range(300)]
    return [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id\nat all\n", None, None), (4, "a", "x", 1), (4, "a\nb", "x", 1), (-3, "minus\n1", "", 0)]


@pytest.mark.parametrize("unit, percent, spm", [("line", 100, 50), ("word", 70, 30), ("char", 50, 100)])
def test_rows(spark, unit, percent, spm):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, output string, n long").repartition(3)
    got = [tuple(r) for r in M.transformed(docs, unit, percent=percent, spm_percent=spm, chars=1000).collect()]
    want = [plain(d, t, unit, 7, percent, spm) for d, t, *_ in rows()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert M.transformed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.transformed(docs, "page")


def test_query_against_sql(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op12_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(("doc_id", "text"), r)) for r in rows()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())])))
    want = con.sql(M.OP12_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_units_of_two_classes():
    texts = ["one two\n\nthree\n", "", "x", "  \n", "a b c"] * 3
    draws = np.array([[k % 7, k % 5] for k in range(len(texts))], np.int64)
    units, first, second = M.cuts(texts, draws, "word_or_line")
    for text, draw, n, a, b in zip(texts, draws.tolist(), units, first, second):
        cut = re.findall(r"[ ]*[^\s]+|[ ]*\n|[ ]+$", text)
        assert "".join(cut) == text and n == len(cut)
        low, high = sorted(d % (n + 1) for d in draw)
        assert (a, b) == (len("".join(cut[:low])), len("".join(cut[:high])))


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    for size in (0, 1, 63, 64, 65, 1000):
        classes = rng.integers(0, 4, size).astype(np.uint8)
        matrix = M.WaveletMatrix(classes)
        at = np.arange(size + 1)
        for c in range(4):
            assert matrix.rank(c, at).tolist() == np.append(0, np.cumsum(classes == c)).tolist()
            places = np.flatnonzero(classes == c)
            assert matrix.select(c, np.arange(len(places))).tolist() == places.tolist()
