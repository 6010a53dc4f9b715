"""Files read by ranges, large and odd ones, and artifacts that break rules."""

import hashlib
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidex.functions.embedders import ModularEmbedder
from evidex.operators import search, validation
from evidex.sources import checked, folders, paged, readers, tables, writers

CHUNK = {"document_id": "d", "chunk_id": "d::0", "section_id": "s", "section_type": "article", "section_title": "t", "parent_section_id": None, "policy_unit_id": None, "policy_unit_name": None, "variant_name": None, "chunk_index": 0, "text": "x", "page_start": 1, "page_end": 1, "char_start": 0, "char_end": 1, "char_count": 1, "token_estimate": 1, "chunking_strategy": "c", "source_section_char_start": 0, "source_section_char_end": 1}


def got(df):
    return sorted((os.path.basename(r.document_id), r.page_number, r.text, r.char_count) for r in df.collect())


def test_pages_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "BLOCK", 5)
    rng = random.Random(3)
    bodies = {f"{k}.txt": "".join(rng.choice("ab\f\f漢\n") for _ in range(rng.randrange(80))).encode() for k in range(12)} | {"empty.txt": b"", "one.txt": b"no break", "odd.txt": b"\xff\f\xe6\xbc", "breaks.txt": b"\f\f"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    files = paged.listed(spark, str(tmp_path), "*.txt")
    every = sorted((n, i, t.decode("utf-8", "replace"), len(t.decode("utf-8", "replace"))) for n, b in bodies.items() for i, t in enumerate(b.split(b"\f"), 1))
    for size in (1, 7, 1 << 20):
        assert got(paged.pages(files, size=size)) == every
        assert got(paged.pages(files, 3, 4, size)) == [r for r in every if 3 <= r[1] <= 4]
        assert got(paged.pages(files, 5, size=size)) == [r for r in every if r[1] >= 5]
    assert got(paged.pages(files, last=2)) == [r for r in every if r[1] <= 2]
    hashes = {r.filename: r.content_hash for r in paged.with_digests(files).collect()}
    assert hashes == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}
    assert paged.pages(files.limit(0)).count() == 0


def test_many_files_are_neither_broadcast_nor_listed_at_once(spark, tmp_path, monkeypatch):
    """Neither the ranges of all files nor a folder's names stand in one place: driver and listing task hold few at a time."""
    monkeypatch.setattr(paged, "LISTED", 7, raising=False)
    monkeypatch.setattr(folders, "LISTED", 7, raising=False)
    named = spark.range(30).select(F.concat("id", F.lit(".txt")).alias("name"), F.concat(F.lit("a\f"), "id", F.lit("\f")).alias("body"))
    assert folders.write_files(named, str(tmp_path)) == 30
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "sub.txt").mkdir()
    files = paged.listed(spark, str(tmp_path), "*.txt")
    assert sorted((r.path, r.filename, r.length) for r in files.collect()) == sorted((f"file:{tmp_path}/{k}.txt", f"{k}.txt", 3 + len(str(k))) for k in range(30))
    found = paged.pages(files, size=2)
    assert got(found) == sorted((f"{k}.txt", i, t, len(t)) for k in range(30) for i, t in enumerate(("a", str(k), ""), 1))
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    (tmp_path / "long.md").write_text("\f" * 400)
    shared = paged.pages(paged.listed(spark, str(tmp_path), "*.md"), size=2).groupBy(F.spark_partition_id()).count().collect()
    assert len(shared) == 4 and sum(r["count"] for r in shared) == 401


def test_a_file_of_two_documents(spark, tmp_path):
    """A file that is listed under two keys has all its pages, with their own numbers, under each."""
    (tmp_path / "a.txt").write_text("one\ftwo\fthree")
    files = paged.listed(spark, str(tmp_path), "*.txt").withColumn("key", F.explode(F.array(F.lit("x"), F.lit("y"))))
    want = [(k, i, t) for k in "xy" for i, t in enumerate(("one", "two", "three"), 1)]
    assert sorted((r.key, r.page_number, r.text) for r in paged.pages(files, size=3, keep=("key",)).collect()) == want


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """Most of it is a hole: one page of 2.2 GB that nobody asks for is passed over, and the pages around it are read."""
    path, size = tmp_path / "large.pdf", 2_200_000_000
    with open(path, "wb") as f:
        f.write("하나\f둘\f".encode())
        f.seek(size)
        f.write(b"\flast page")
    files = paged.listed(spark, str(tmp_path))
    assert files.first().length == size + 10
    assert [r[1:3] for r in got(paged.pages(files, last=2))] == [(1, "하나"), (2, "둘")]
    assert [r[1:3] for r in got(paged.pages(files, first=4, size=256 << 20))] == [(4, "last page")]
    assert paged.ranges(files, 256 << 20).agg(F.sum("breaks")).first()[0] == 3
    with open(path, "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    assert paged.with_digests(files).first().content_hash == want


def test_copies_in_blocks(tmp_path):
    source, out = tmp_path / "a", tmp_path / "out"
    source.write_bytes(b"x" * 100)
    assert folders.copy(str(source), str(out), "b", step=7) and (out / "b").read_bytes() == b"x" * 100
    assert not writers.stage_file(str(source), str(out / "b"))
    source.write_bytes(b"y")
    with pytest.raises(FileExistsError):
        writers.stage_file(str(source), str(out / "b"))
    assert sorted(os.listdir(out)) == ["b"]


def chunk_file(folder, name, *rows, body=None):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.chunks.json", "w", encoding="utf-8") as f:
        f.write(json.dumps({"document_id": name, "chunks": [CHUNK | r for r in rows]}) if body is None else body)


def test_artifacts_that_are_not_valid(spark, tmp_path):
    at = f"{tmp_path}/c"
    chunk_file(at, "good", {}, {"chunk_index": "3", "char_count": 4.0}, {"text": ""})
    assert sorted(r.chunk_index for r in readers.artifacts(spark, at, "chunks", required=True).collect()) == [0, 0, 3]
    chunk_file(at, "cut", body='{"document_id": "cut", "chunks": [{"docu')
    with pytest.raises(checked.InvalidArtifacts, match="cut.chunks.json.*not_json"):
        readers.artifacts(spark, at, "chunks", required=True)
    chunk_file(at, "odd", {}, {"char_count": "abc", "page_start": -4, "section_type": "chapter", "text": None})
    chunk_file(at, "none", body='{"document_id": "none"}')
    chunk_file(at, "empty")
    aside = f"{tmp_path}/aside"
    rows = readers.artifacts(spark, at, "chunks", quarantine=aside).collect()
    assert len(rows) == 3 and {r.char_count for r in rows} == {1, 4}
    told = {(r.file, r.position): list(r.violations) for r in spark.read.parquet(aside).collect()}
    assert told == {("cut.chunks.json", None): ["file:not_json"], ("none.chunks.json", None): ["chunks:missing"], ("odd.chunks.json", 1): ["text:missing", "page_start:below_1", "char_count:not_an_integer", "section_type:not_one_of"]}


def test_documents_that_are_not_valid(spark, tmp_path):
    page = {"document_id": "a", "page_number": 1, "text": "x", "char_count": 1, "extraction_method": "m"}
    whole = {"document_id": "a", "page_count": 1, "total_char_count": 1, "created_at": "now", "pages": [page]}
    for name, body in (("a", whole), ("b", whole | {"page_count": -1, "pages": [page, page | {"page_number": 0}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    with pytest.raises(ValueError, match=r"b.json.*page_count:below_0, pages\[1\].page_number:below_1"):
        readers.documents(spark, str(tmp_path))
    (found,) = readers.documents(spark, str(tmp_path), f"{tmp_path}-aside").collect()
    assert found.document_id == "a" and found.pages[0].page_number == 1


def test_numbers_in_text(spark):
    texts = ["1", " 7 ", "007", "2.0", "2.5", "-3", "1e3", "", "abc", "9007199254740993", "99999999999999999999", "NaN", "Infinity", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(validation.whole_number(F.col("t"))).collect()
    assert [r[0] for r in rows] == [1, 7, 7, 2, None, -3, 1000, None, None, 9007199254740993, None, None, None, None]


def test_a_write_that_ends_half_way(spark, tmp_path, monkeypatch):
    """Before the log the old files stay; after it the next reader finishes the write."""
    folder = str(tmp_path / "out")
    named = lambda body: spark.createDataFrame([(f"{k}.txt", f"{body} {k}") for k in range(5)], "name string, body string")
    held = lambda: {n: (tmp_path / "out" / n).read_text() for n in os.listdir(folder) if n.endswith(".txt")}
    assert folders.write_files(named("old"), folder) == 5 and sorted(os.listdir(folder)) == [f"{k}.txt" for k in range(5)]
    bad = named("new").withColumn("name", F.when(F.col("name") == "3.txt", "a/3.txt").otherwise(F.col("name")))
    with pytest.raises(Exception, match="not a file name"):
        folders.write_files(bad, folder)
    assert held() == {f"{k}.txt": f"old {k}" for k in range(5)}
    with monkeypatch.context() as m:
        m.setattr(folders, "settle", lambda *a: None)
        folders.write_files(named("new"), folder)
    # the log is there, no file has moved yet, and one moves before the run ends
    stage = (tmp_path / "out" / folders.LOG).read_text()
    os.rename(f"{folder}/{stage}/2.txt", f"{folder}/2.txt")
    folders.settle(spark, folder)
    assert held() == {f"{k}.txt": f"new {k}" for k in range(5)} and folders.LOG not in os.listdir(folder) and stage not in os.listdir(folder)
    folders.settle(spark, folder)


def test_an_index_build_that_ends_half_way(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "index")
    rows = spark.createDataFrame([CHUNK | {"chunk_id": f"d::{k}", "char_start": k, "char_end": k + 1} for k in range(4)], readers.CHUNK)
    writers.build_index(rows, folder, ModularEmbedder())
    before = writers.read_index(spark, folder)[0].count()
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(writers, "replace", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        writers.build_index(rows.limit(1), folder, ModularEmbedder())
    assert before == 4 == writers.read_index(spark, folder)[0].count()
    writers.build_index(rows.limit(3), folder, ModularEmbedder())
    assert writers.read_index(spark, folder)[0].count() == 3


def test_rows_handed_on_are_few(spark):
    """At most top_k rows of a query leave a task, also where many rows tie."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    x[:500] = x[0]
    index = spark.createDataFrame([(i, f"s{i % 40}", "article", None, None, None, [float(v) for v in row]) for i, row in enumerate(x)], "row_idx long, section_id string, section_type string, insurer string, product_type string, variant_name string, embedding array<double>").repartition(3)
    asked = [(f"q{i}", [float(v) for v in (x[0] if i % 3 == 0 else rng.normal(size=6))], (1, 4, 50)[i % 3], i % 2 == 0) for i in range(30)]
    queries = spark.createDataFrame([(*q, None, None, None) for q in asked], "id string, vector array<double>, top_k int, dedupe_section boolean, insurer string, product_type string, variant_name string")
    plain = search._best_of_part

    def counted(folder):
        run = plain(folder)
        return lambda batches: (pa.RecordBatch.from_arrays([pa.array([str(len(b)) for b in [b]]), pa.array([0])], ["query_id", "row_idx"]) for b in run(batches))

    folder = tables.shared_path(spark, "queries")
    queries.selectExpr("id query_id", "vector", "top_k", "dedupe_section", "insurer", "product_type", "variant_name").coalesce(1).write.parquet(folder)
    rows = index.select("row_idx", "section_id", "insurer", "product_type", "variant_name", "embedding")
    seen = [int(r.query_id) for r in rows.mapInArrow(counted(folders.uri(folder)), "query_id string, row_idx long").collect()]
    assert len(seen) == 3 and all(n <= sum(q[2] for q in asked) for n in seen)
    hits = {}
    for r in search.search_many(index, queries, 7).orderBy("rank").collect():
        hits.setdefault(r.query_id, []).append(r.row_idx)
    for q, v, k, dedupe in asked:
        want, sections = [], set()
        for i in sorted(range(len(x)), key=lambda i: (-sum(a * b for a, b in zip(x[i].tolist(), v)), i)):
            if not (dedupe and i % 40 in sections):
                sections.add(i % 40)
                want.append(i)
        assert hits[q] == want[:k]
