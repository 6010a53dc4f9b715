"""Exact deduplication: groups, collisions of a weak digest, and state that outlives a call."""

import contextlib
import os
import re
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidex.llm import exact_dedup as E

SHAPE = "text string, doc_id long, digest string, n string, keep_id string"
ROWS = [("a b", 7), ("a  b", 3), ("a\tb", 9), ("a b ", 4), (None, 5), ("", 6), ("A b", 1), ("é " * 9000, 11), ("é\n" * 9000, 10), ("a b", None), (None, None), ("only null id", None), ("twice", 20), ("twice", 20)]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for t, d in rows:
        groups.setdefault(norm(t), []).append(d)
    keep = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted(((d, keep[norm(t)], len(groups[norm(t)]), d == keep[norm(t)]) for t, d in rows), key=repr)


def frame(spark, rows, path):
    spark.createDataFrame([(t, d, "", "", "") for t, d in rows], SHAPE).repartition(3).write.mode("append").parquet(path)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


def test_against_groups(spark, tmp_path):
    path = f"{tmp_path}/docs"
    frame(spark, ROWS, path)
    assert got(E.exact_dedup(spark, path)) == brute(ROWS)
    assert got(E.exact_dedup(spark, path, salt=2)) == brute(ROWS)


def test_colliding_digests_are_settled_by_bytes(spark, tmp_path):
    path = f"{tmp_path}/docs"
    frame(spark, ROWS, path)
    weak = lambda t: F.substring(F.sha2(t, 256), 1, 1)
    assert got(E.exact_dedup(spark, path, digest=weak)) == brute(ROWS)
    assert got(E.exact_dedup(spark, path, digest=lambda t: F.lit("same"))) == brute(ROWS)


def test_all_texts_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST_ROWS", -1)
    path = f"{tmp_path}/docs"
    frame(spark, ROWS, path)
    assert got(E.exact_dedup(spark, path)) == brute(ROWS)


def test_state_goes_on(spark, tmp_path):
    path, state = f"{tmp_path}/docs", f"{tmp_path}/state"
    frame(spark, ROWS[:6], path)
    assert got(E.exact_dedup(spark, path, state=state)) == brute(ROWS[:6])
    frame(spark, ROWS[6:], path)
    assert got(E.exact_dedup(spark, path, state=state)) == brute(ROWS)


def test_files_written_anew(spark, tmp_path):
    """The keeper's file is gone: another row of its digest stands in, and no row is lost."""
    path, state = f"{tmp_path}/docs", f"{tmp_path}/state"
    frame(spark, ROWS, path)
    assert got(E.exact_dedup(spark, path, state=state)) == brute(ROWS)
    shutil.rmtree(path)
    frame(spark, ROWS, path)
    assert got(E.exact_dedup(spark, path, state=state)) == brute(ROWS)
    # keepers of some groups leave the table
    shutil.rmtree(path)
    some = [r for r in ROWS if r[1] not in (3, 20, 5)]
    frame(spark, some, path)
    assert got(E.exact_dedup(spark, path, state=state)) == brute(some)
    weak = lambda t: F.lit("same")
    other = f"{tmp_path}/weak"
    assert got(E.exact_dedup(spark, path, weak, other)) == brute(some)
    shutil.rmtree(path)
    frame(spark, some[2:], path)
    assert got(E.exact_dedup(spark, path, weak, other)) == brute(some[2:])


def test_files_changed_in_place(spark, tmp_path):
    path, state = f"{tmp_path}/docs", f"{tmp_path}/state"
    frame(spark, ROWS, path)
    E.exact_dedup(spark, path, state=state)
    name = next(n for n in os.listdir(path) if n.endswith(".parquet"))
    pq.write_table(pa.table({"text": ["never seen"], "doc_id": [99], "digest": [""], "n": [""], "keep_id": [""]}), f"{path}/{name}")
    with contextlib.suppress(FileNotFoundError):
        os.remove(f"{path}/.{name}.crc")
    with pytest.raises(ValueError, match="1 rows"):
        E.exact_dedup(spark, path, state=state)


def test_empty(spark, tmp_path):
    path = f"{tmp_path}/docs"
    spark.createDataFrame([], SHAPE).write.parquet(path)
    assert E.exact_dedup(spark, path).count() == 0
