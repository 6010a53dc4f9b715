"""Artifacts, documents, indexes and manifests written and read again; reports, staging and long lines."""

import json
import os
import time

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from evidex.__main__ import main
from evidex.functions import text as T
from evidex.functions.embedders import ModularEmbedder
from evidex.operators import chunking, layout, regions, search, sections, staging, units
from evidex.plans import reports, service, staging_run
from evidex.sources import readers, writers

PAGES = "document_id string, page_number int, text string, char_count int, extraction_method string"
PROSE = "회사는 보험금을 지급합니다. " * 12


def pages(spark, *texts, document="a_b"):
    return spark.createDataFrame([(document, i, t, len(t), "x") for i, t in enumerate(texts, 1)], PAGES)


def plain(rows):
    return sorted((r.asDict(recursive=True) for r in rows), key=repr)


def test_artifacts_round_trip(spark, tmp_path):
    p = pages(spark, "무배당 연금(적립형) 약관\n제1조 (목적)\n" + PROSE, "제2조 (정의)\n" + PROSE).unionByName(pages(spark, "제1조 (목적)\n" + PROSE, document="c"))
    found = sections.detect(p)
    config = chunking.ChunkingConfig(120, 20)
    chunks = chunking.chunks(found, config)
    folder = f"{tmp_path}/out"
    assert writers.write_artifacts(found, folder, "sections") == 2
    assert writers.write_artifacts(chunks, folder, "chunks", documents=p.select("document_id").unionByName(spark.createDataFrame([("none",)], "document_id string")), config=config) == 3
    assert sorted(os.listdir(folder)) == ["a_b.chunks.json", "a_b.sections.json", "c.chunks.json", "c.sections.json", "none.chunks.json"]
    assert plain(readers.artifacts(spark, folder, "sections").collect()) == plain(found.select(*readers.artifacts(spark, folder, "sections").columns).collect())
    again = readers.artifacts(spark, folder, "chunks", required=True)
    assert plain(again.collect()) == plain(chunks.select(*again.columns).collect()) and json.load(open(f"{folder}/none.chunks.json"))["chunks"] == []
    limits = readers.chunk_limits(spark, folder)
    assert {r.document_id: r.max_chars for r in limits.collect()} == {"a_b": 120, "c": 120, "none": 120}
    # written again, files are replaced
    assert writers.write_artifacts(found, folder, "sections") == 2
    assert chunking.inspection(again, limits=limits).first().over_max == 0 and chunking.inspection(again, 50).first().over_max > 0
    short = limits.where("document_id = 'c'").withColumn("max_chars", F.lit(10))
    assert chunking.inspection(again, limits=short).first().over_max == again.where("document_id = 'c' and char_count > 10").count()
    totals = chunking.run_totals(limits, again)
    said = reports.run_summary_text(totals, chunking.run_summary(limits, again))
    assert "documents_processed: 3" in said and "- none: 0" in said and f"total_chunks: {again.count()}" in said
    assert "… (+1 more)" in reports.run_summary_text(totals, chunking.run_summary(limits, again), most=2)
    none = chunking.run_totals(limits.limit(0), again.limit(0)).first()
    assert tuple(none) == (0, 0, 0.0, 0)
    with pytest.raises(ValueError, match="blank"):
        writers.write_artifacts(found.withColumn("document_id", F.lit(" ")), folder, "sections")


def test_folders_that_are_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.documents(spark, f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        readers.artifacts(spark, f"{tmp_path}/none", "chunks", required=True)
    with pytest.raises(ValueError, match="no \\*.chunks.json"):
        readers.artifacts(spark, str(tmp_path), "chunks", required=True)
    with pytest.raises(FileNotFoundError):
        readers.inbox(spark, f"{tmp_path}/none")
    assert readers.artifacts(spark, f"{tmp_path}/none", "sections").count() == 0
    assert readers.inbox(spark, str(tmp_path)).count() == 0


def test_documents_round_trip(spark, tmp_path):
    p = pages(spark, "하나\n둘", "", "셋").unionByName(pages(spark, "x", document="b"))
    meta = spark.createDataFrame([("a_b", "i", ["t"])], "document_id string, insurer string, tags array<string>")
    assert writers.write_documents(p, f"{tmp_path}/d", meta, "2026-01-01T00:00:00Z") == 2
    body = json.load(open(f"{tmp_path}/d/a_b.json"))
    assert body["metadata"] == {"document_id": "a_b", "insurer": "i", "tags": ["t"]} and body["page_count"] == 3 and body["total_char_count"] == 5
    got = readers.documents(spark, f"{tmp_path}/d").collect()
    assert [r.document_id for r in got] == ["a_b", "b"]
    back = readers.documents(spark, f"{tmp_path}/d").select(F.explode("pages").alias("p")).select("p.*")
    assert plain(back.collect()) == plain(p.collect())


def test_index_export_and_import(spark, tmp_path):
    folder = f"{tmp_path}/i"
    service.build(pages(spark, "제1조 (목적)\n" + PROSE, "제2조 (정의)\n" + PROSE), folder, ModularEmbedder(), chunking.ChunkingConfig(60, 5))
    index, _ = writers.read_index(spark, folder)
    writers.export_index(index, f"{tmp_path}/e")
    back = writers.import_index(spark, f"{tmp_path}/e/metadata.jsonl", f"{tmp_path}/e/embeddings.npy", block=3)
    names = ["row_idx", "chunk_id", "text", "embedding"]
    assert plain(back.select(*names).collect()) == plain(index.select(*names).collect())
    rows = index.orderBy("row_idx").select("chunk_id", "embedding").collect()
    with open(tmp_path / "m.jsonl", "w") as f:
        f.write("\n".join(json.dumps({"chunk_id": r.chunk_id}) + "\n" for r in rows))
    np.save(tmp_path / "e.npy", np.array([r.embedding for r in rows], np.float64))
    one = writers.import_index(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "e.npy"), block=4)
    assert [(r.chunk_id, list(r.embedding)) for r in one.orderBy("row_idx").collect()] == [(r.chunk_id, list(r.embedding)) for r in rows]
    np.save(tmp_path / "short.npy", np.zeros((2, 8), np.float32))
    with pytest.raises(ValueError, match="!= embedding rows"):
        writers.import_index(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "short.npy"))


def test_staging_run(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "교보생명 20240115.pdf").write_text("교보생명 보험약관\n무배당 연금보험\f둘째 쪽", encoding="utf-8")
    (inbox / "b.pdf").write_text("nothing", encoding="utf-8")
    root = f"{tmp_path}/root"
    seen = staging_run.stage(spark, str(inbox), root)
    assert seen.count() == 2 and not os.path.exists(root)
    done = staging_run.stage(spark, str(inbox), root, apply=True).where("reason = ''").first()
    assert os.listdir(f"{root}/data/raw/manual") == [f"{done.entry_document_id}.pdf"]
    listed = yaml.safe_load(open(f"{root}/data/manifests/manual.yaml", encoding="utf-8"))
    assert [d["document_id"] for d in listed["documents"]] == [done.entry_document_id] and listed["documents"][0]["tags"] == []
    assert readers.manifest(spark, f"{root}/data/manifests/manual.yaml").first().insurer == "kyobolife"
    # once more: the same bytes stand there
    assert staging_run.stage(spark, str(inbox), root, apply=True).count() == 2
    open(f"{root}/data/raw/manual/{done.entry_document_id}.pdf", "w").write("other")
    with pytest.raises(Exception, match="other bytes"):
        staging_run.stage(spark, str(inbox), root, apply=True)
    assert readers.source_path("a/b.pdf", "/r") == "/r/a/b.pdf" and readers.source_path("/x/../y.pdf", "/r") == "/y.pdf"
    checked = readers.verified(spark.createDataFrame([("p", "00")], "path string, content_hash string"), spark.createDataFrame([], "path string, content_hash string"))
    with pytest.raises(FileNotFoundError):
        readers.require_verified(checked)
    odd = spark.createDataFrame([("0" * 64, "2026-01-31"), ("G" * 64, "2026-1-31"), ("abc", "x")], "h string, d string").select(T.hash8("h"), T.date_segment("d")).collect()
    assert list(map(tuple, odd)) == [("00000000", "20260131"), (None, None), (None, None)]
    bad = staging.entries(spark.createDataFrame([("교보생명 20240115.pdf", "교보생명 보험약관\n무배당 연금보험", "nohash")], "filename string, head_text string, content_hash string")).first()
    assert bad.reason == "content_hash_not_sha256"


@pytest.mark.parametrize("tail, cleaned", [("." * 100_000, False), ("." * 100_000 + " 12", True), ("...1" * 25_000, True), ("...1" * 25_000 + "x", False), (" " * 100_000 + "x", False), (" ... 1 .. 2", True), ("..... 123456", False)])
def test_long_leaders_end_in_time(spark, tail, cleaned):
    began = time.time()
    r = staging.inferred(spark.createDataFrame([("x.pdf", "무배당 연금보험 상품" + tail)], "filename string, head_text string")).select("product_name.value").first()
    assert (r.value == "무배당 연금보험 상품") == cleaned and time.time() - began < 30


def test_a_long_document_takes_linear_time(spark):
    def seconds(n):
        text = "\n".join(f"제{i}조 (목적)" if i % 20 == 0 else "회사는 보험금을 지급합니다." for i in range(n))
        p = pages(spark, *[text[i : i + 2000] for i in range(0, len(text), 2000)])
        began = time.time()
        sections.detect(p).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(500)
    assert seconds(60_000) < 30 + 20 * seconds(6_000)


def test_columns_can_be_read_alone(spark):
    """Nested columns are pruned apart for each choice of columns."""
    files = spark.createDataFrame([("교보생명 20240115.pdf", "교보생명 보험약관\n무배당 연금보험 ..... 3", "0" * 64), ("x", "", "1" * 64)], "filename string, head_text string, content_hash string")
    for df in (staging.inferred(files), staging.entries(files), staging.date_candidates(files)):
        every = df.collect()
        nested = [f"{f.name}.value" for f in df.schema if f.dataType.typeName() == "struct"]
        for name in df.columns + nested:
            want = [r[name] if name in df.columns else r[name.split(".")[0]][name.split(".")[1]] for r in every]
            assert [r[0] for r in df.select(name).collect()] == want
    p = pages(spark, "제1조 (목적)\n" + PROSE, "별표 1 지급기준표\n" + PROSE)
    texts = layout.full_text(p)
    verdicts = sections.judged(sections.candidates(p), regions.classify(p), texts, units.markers(texts))
    every = verdicts.orderBy("start_char_offset").collect()
    for name in ("emit", "trace", "assembly_confidence", "next_mark", "title"):
        assert [r[0] for r in verdicts.orderBy("start_char_offset").select(name).collect()] == [r[name] for r in every]


def test_pages_as_of_offsets(spark):
    p = pages(spark, "ab\ncd", "", "e\n")
    texts = layout.full_text(p)
    asked = spark.createDataFrame([("a_b", o) for o in (-5, 0, 5, 6, 7, 8, 9, 50)], "document_id string, o long")
    got = {r.o: r.page for r in layout.with_page(asked, texts, F.col("o"), "page").collect()}
    assert got == {-5: 1, 0: 1, 5: 1, 6: 2, 7: 3, 8: 3, 9: 3, 50: 3}


def test_search_many_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{i // 3}", "article", ["kyobolife", "samsunglife", None][i % 3], "annuity", [None, "적립형"][i % 2], [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(200 + i, "dup", "article", "kyobolife", "annuity", None, [1.0] + [0.0] * 7) for i in range(30)]
    index = spark.createDataFrame(rows, "row_idx long, section_id string, section_type string, insurer string, product_type string, variant_name string, embedding array<float>").repartition(5)
    specs = [(f"q{i}", [float(x) for x in (rng.normal(size=8) if i % 4 else [1.0] + [0.0] * 7)], (3, 70, 0)[i % 3], i % 2 == 0, [None, "KyoboLife"][i % 2], None, [None, None, "적립"][i % 3]) for i in range(12)]
    queries = spark.createDataFrame(specs, "id string, vector array<double>, top_k int, dedupe_section boolean, insurer string, product_type string, variant_name string")
    for block in (4, 1000):
        hits = {}
        for r in search.search_many(index, queries, block).orderBy("rank").collect():
            hits.setdefault(r.query_id, []).append(r.row_idx)
        for q, vector, k, dedupe, insurer, _, variant in specs:
            best, seen = [], set()
            for row in sorted(rows, key=lambda r: (-sum(float(np.float32(a)) * b for a, b in zip(r[6], vector)), r[0])):
                if insurer and row[3] != "kyobolife" or variant and variant not in (row[5] or ""):
                    continue
                if dedupe and row[1] in seen:
                    continue
                seen.add(row[1])
                best.append(row[0])
            assert hits.get(q, []) == best[: max(k, 1)]
    assert search.search_many(index, queries.limit(0)).count() == 0


def test_command_line(spark, tmp_path, capsys):
    at = lambda name: f"{tmp_path}/{name}"
    writers.write_documents(pages(spark, "무배당 연금(적립형) 약관\n제1조 (목적)\n" + PROSE, "제2조 (정의)\n" + PROSE), at("docs"))
    run = lambda *a: (main(list(a)), capsys.readouterr())
    assert run("sections", at("docs"), at("sections"))[0] == 0
    code, said = run("chunks", at("sections"), at("chunks"), "--max-chars", "120", "--overlap-chars", "20")
    assert code == 0 and "documents_processed: 1" in said.out
    assert "| over_max | 0 |" in run("inspect", at("chunks"))[1].out and "# Ingestion quality report" in run("quality", at("docs"))[1].out
    assert run("index", at("chunks"), at("index"))[0] == 0
    code, said = run("search", at("index"), "보험금", "--top-k", "2")
    assert code == 0 and [c["citation_id"] for c in json.loads(said.out)["citations"]] == ["C1", "C2"]
    assert run("search", at("index"), "보험금", "--insurer", "nobody")[0] == 1
    assert run("sections", at("none"), at("x"))[0] == 2 and run("stage", at("none"), at("root"))[0] == 2
    os.makedirs(at("inbox"))
    open(at("inbox/b.pdf"), "w").write("nothing")
    code, said = run("stage", at("inbox"), at("root"))
    assert code == 3 and "preview only" in said.out and "insurer_not_inferred" in said.out
