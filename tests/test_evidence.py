"""The evidence operators on small Korean documents: what headings, regions, units, chunks, searches and rules give."""

import json

import pytest
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.functions.embedders import ModularEmbedder
from evidex.operators import chunking, evaluation, identity, layout, quality, regions, search, sections, staging, units
from evidex.plans import reports, service
from evidex.sources import readers, writers
from evidex.streaming.inbox import watch_inbox

PAGE = readers.PAGE
PROSE = "회사는 보험기간 중 피보험자에게 약관에서 정한 사유가 생긴 때에 보험수익자에게 약정한 보험금을 지급합니다. " * 3


def pages(spark, *texts, doc="kyobolife_annuity_plan_policy_terms_20260101_0123abcd"):
    return spark.createDataFrame([(doc, i, t, len(t), "test") for i, t in enumerate(texts, 1)], PAGE)


def found(spark, *texts):
    return [(r.section_type, r.title, r.start_page) for r in sections.detect(pages(spark, *texts)).orderBy("section_id").collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_helpers(spark):
    assert one(spark, T.strip(F.lit("\u00a0 a\u3000b \x1c\n"))) == "a\u3000b"
    assert one(spark, T.compact(F.lit(" 제 1\u00a0조 "))) == "제1조"
    assert one(spark, T.split_lines(F.lit("a\r\nb\x0bc\n"))) == ["a", "b", "c"] and one(spark, T.split_lines(F.lit(""))) == []
    assert one(spark, T.casefold(F.lit("Straße"))) == "strasse"
    assert one(spark, T.prefixed(F.lit(" QUERY: x "), "query")) == "QUERY: x" and one(spark, T.prefixed(F.lit("x"), "query")) == "query: x"
    assert one(spark, T.clip(F.lit("a" * 501), 500)) == "a" * 497 + "..."
    assert one(spark, T.csv_list(F.lit(" a, ,b "))) == ["a", "b"] and one(spark, T.csv_list(F.lit(" , "))) is None
    assert one(spark, T.key_segment(F.lit(" Ab--c! "))) == "ab_c" and one(spark, T.key_segment(F.lit("가"))) is None


def test_toc_parts_and_articles(spark):
    got = sections.detect(pages(spark, "목 차\n", "제1관 목적\n제1조 (목적)\n" + PROSE, "", "제2조(정의)\n" + PROSE, "제 2 관  지급\n제3조 (지급)\n" + PROSE)).orderBy("section_id").collect()
    assert [(r.section_type, r.title) for r in got] == [("toc", "목 차"), ("part", "제1관 목적"), ("article", "제1조 (목적)"), ("article", "제2조 (정의)"), ("part", "제2관 지급"), ("article", "제3조 (지급)")]
    parents = {r.title: r.parent_section_id for r in got}
    ids = {r.title: r.section_id for r in got}
    assert parents["제1조 (목적)"] == parents["제2조 (정의)"] == ids["제1관 목적"] and parents["제3조 (지급)"] == ids["제2관 지급"]
    assert got[0].section_id.endswith("::sec::0000") and got[2].end_char_offset == got[3].start_char_offset


def test_blank_documents(spark):
    assert found(spark, "", " \n\u3000") == []
    assert [r.region_type for r in regions.classify(pages(spark, "", " ")).collect()] == ["unknown", "unknown"]


@pytest.mark.parametrize("pointer", ["제1조 (목적) . 39", "제1조 (목적)\n25p", "제1조 (목적)\n. 48", "제1조 (목적)\n168"])
def test_pointer_rows_are_no_headings(spark, pointer):
    assert found(spark, pointer) == []


def test_legal_headings(spark):
    law = "약관에서 인용된 법령\n「민법」 제1조 이 법은 " + PROSE
    assert [s[0] for s in found(spark, law)] == ["legal_reference"]
    assert found(spark, "관련법규 168p\n" + PROSE) == [] and found(spark, "관련 법규\n보험약관 가이드\n" + PROSE + "민법") == []
    assert found(spark, "관련 법규\n짧다") == []


def test_appendix_rows(spark):
    body = "( 별표 1 ) 지급기준표\n" + "가" * 120 + "\n제5조(보험금)\n제6조제1항에 관한 표\n제7조 (보험금\n" + "나" * 30
    assert [s[:2] for s in found(spark, body)] == [("appendix", "( 별표 1 ) 지급기준표")]
    assert found(spark, "별표 2 기준표\n짧다") == []
    assert found(spark, "별표 2 기준표 ... 12p") == []


def test_inline_reference_stays_in_its_article(spark):
    got = sections.detect(pages(spark, "제1조 (목적)\n" + PROSE + "\n제3조 (지급사유) 에 따른 보험금은 이렇다\n" + PROSE)).collect()
    assert len(got) == 1 and "제3조" in got[0].text


def test_units(spark):
    text = ["무배당 연금(적립형) 약관\n제1조 (목적)\n" + PROSE, "무배당 연금(적립형) 약관\n제2조 (정의)\n" + PROSE, "무배당 연금(거치형)\n약 관\n제1조 (목적)\n" + PROSE, "보험용어 해설\n" + PROSE]
    p = pages(spark, *text)
    texts = layout.full_text(p)
    marked = units.markers(texts)
    assert [(r.name, r.variant) for r in marked.orderBy("offset").collect()] == [("무배당 연금", "적립형"), ("무배당 연금", "거치형")]
    got = units.units(texts, marked).orderBy("policy_unit_id").collect()
    whole = "\n".join(text)
    assert got[0].end_char_offset == whole.index("무배당 연금(거치형)") - 1 and got[1].end_char_offset == whole.index("보험용어") - 1
    assert (got[0].start_page, got[0].end_page, got[1].end_page) == (1, 2, 3)
    by = {(r.title, r.start_page): r.variant_name for r in sections.detect(p).collect()}
    assert by[("제2조 (정의)", 2)] == "적립형" and by[("제1조 (목적)", 3)] == "거치형" and by[("보험용어 해설", 4)] is None


def test_regions(spark):
    label = lambda *t: [r.region_type for r in regions.classify(pages(spark, *t)).orderBy("page_number").collect()]
    assert label("보험약관 공시", "목차\n제1조 목적 .... 3\n제2조 정의 .... 4", "고객권리안내문", "주요내용", "제1관 목적\n" + PROSE) == ["cover", "toc", "guide", "summary", "policy_body"]
    assert label("본문에서 별표 1 을 참고한다", "(별표1) 표", "보험용어 해설", "관련 법규: 민법") == ["unknown", "appendix", "glossary", "legal_reference"]
    outline = "\n".join(f"제{i}조 목적 . {i}" for i in range(1, 31)) + "\n별표 1 표 . 9"
    assert label(outline) == ["toc"]


def test_offsets(spark):
    p = pages(spark, "ab\ncd", "", "e\n")
    t = layout.full_text(p).first()
    assert t.full_text == "ab\ncd\n\ne\n" and [(s.page_number, s.start) for s in t.starts] == [(1, 0), (2, 6), (3, 7)]
    at = lambda o: layout.full_text(p).select(layout.page_at(F.lit(o).cast("long"), F.col("starts"), F.col("total_len"))).first()[0]
    assert [at(o) for o in (-5, 0, 5, 6, 7, 99)] == [1, 1, 1, 2, 3, 3]
    assert [(r.page_number, r.offset, r.line) for r in layout.lines(p).orderBy("offset").collect()] == [(1, 0, "ab"), (1, 3, "cd"), (3, 7, "e"), (3, 9, "")]


def test_quality(spark):
    p = pages(spark, "", "a" * 10, "b" * 100, "c" * 49, "d" * 50)
    docs = spark.createDataFrame([(p.first().document_id,), ("none",)], "document_id string")
    got = {r.document_id: r for r in quality.document_quality(docs, p).collect()}
    full, none = got[p.first().document_id], got["none"]
    assert (full.page_count, full.total_chars, full.empty_pages, full.low_pages, full.first_page) == (5, 209, 1, 3, 2)
    assert (none.page_count, none.avg_chars, none.min_chars) == (0, 0.0, None)
    assert [r.reason for r in quality.suspicious_pages(p).orderBy("page_number").collect()] == ["empty", "low_text", "low_text"]
    total = quality.corpus_quality(quality.document_quality(docs, p)).first()
    assert (total.documents, total.documents_with_empty) == (2, 1)
    assert "p1(empty)" in reports.ingestion_report(quality.document_quality(docs, p), quality.corpus_quality(quality.document_quality(docs, p)), quality.suspicious_pages(p))


def test_chunk_spans():
    cut = lambda t, m, o, **k: chunking.span_bounds(t, chunking.ChunkingConfig(m, o, **k))
    assert cut("", 10, 2) == [] and cut("abc", 10, 2) == [(0, 3)]
    assert cut("a" * 120, 30, 5)[:2] == [(0, 30), (25, 55)] and len(cut("a" * 120, 30, 5)) == 5
    assert len(cut("a" * 120, 30, 0)) == 4 and len(cut("a" * 120, 30, 0, compat=True)) == 91
    text = "title\nfirst line\n\nsecond line here\nthird line here\n"
    spans = cut(text, 25, 5)
    assert spans[0] == (0, 18) and spans[-1][1] == len(text)
    assert all(b - a <= 25 for a, b in spans) and all(y[0] <= x[1] for x, y in zip(spans, spans[1:]))
    with pytest.raises(ValueError):
        chunking.ChunkingConfig(0, 0)


def test_chunks(spark):
    s = sections.detect(pages(spark, "제1조 (목적)\n" + PROSE + "\n" + PROSE, "제2조 (정의)\n" + PROSE))
    got = chunking.chunks(s, chunking.ChunkingConfig(120, 20))
    rows = got.orderBy("chunk_id").collect()
    assert rows[0].chunk_id.endswith("::chunk::0000::000") and rows[0].token_estimate == (rows[0].char_count + 3) // 4
    assert {r.section_title for r in rows} == {"제1조 (목적)", "제2조 (정의)"}
    total = chunking.inspection(got, 100).first()
    assert total.chunks == len(rows) and total.over_max == sum(r.char_count > 100 for r in rows) and total.duplicate_ids == 0
    assert chunking.inspection(got.unionByName(got)).first().duplicate_ids == len(rows)
    assert "## Largest" in reports.chunk_report(chunking.inspection(got), chunking.inspection_groups(got), chunking.largest(got))


def test_document_keys(spark):
    key = lambda k: one(spark, identity.parsed(F.lit(k)))
    assert tuple(key(" kyobolife_variable_annuity_my_plan_policy_terms_20260101_0123abcd "))[:4] == ("kyobolife", "variable_annuity", "my_plan", "my plan")
    assert tuple(key("x_dental_p_policy_terms_20260101_0123abcd"))[:3] == ("x", "dental", "p")
    for bad in ("kyobolife_annuity_policy_terms_20260101_0123abcd", "x_dental_policy_terms_20260101_0123abcd", "x_policy_terms_20260101_0123abcd", "x_a_b_terms_20260101_0123abcd", "x_a_b_policy_terms_20260101_0123ABCD"):
        assert key(bad) is None
    row = identity.enriched(spark.createDataFrame([("kyobolife_annuity_p_policy_terms_20260101_0123abcd", None, "own")], "document_id string, insurer string, product_type string")).first()
    assert (row.insurer, row.product_type, row.insurer_display_name, row.product_type_display_name, row.product_display_name) == ("kyobolife", "own", "교보생명", "own", "p")


def index(spark):
    rows = [(i, f"c{i}", f"s{i // 2}", "제1조 (목적)", kind, "kyobolife_annuity_p_policy_terms_20260101_0123abcd", unit, variant, 1, 1, 0, 9, "본문", [1.0 - i / 10, i / 10]) for i, (kind, unit, variant) in enumerate([("article", None, None), ("toc", "u", "적립형"), ("part", "Straße", "거치형"), ("article", "u", "적립형"), ("cover", None, None)])]
    return identity.enriched(spark.createDataFrame(rows, "row_idx long, chunk_id string, section_id string, section_title string, section_type string, document_id string, policy_unit_name string, variant_name string, page_start int, page_end int, char_start long, char_end long, text string, embedding array<float>"))


def test_search(spark):
    ids = lambda **k: [r.row_idx for r in search.search(index(spark), [1.0, 0.0], k.pop("top_k", 9), search.SearchFilters(**k.pop("f", {})), **k).orderBy("rank").collect()]
    assert ids() == [0, 2, 3] and ids(top_k=0) == [0] and ids(dedupe_section=True) == [0, 2]
    assert ids(f={"include_section_types": frozenset({"toc"})}) == [1] and ids(f={"include_section_types": frozenset()}) == []
    assert ids(f={"use_default_section_type_excludes": False, "exclude_section_types": frozenset({"article"})}) == [1, 2, 4]
    assert ids(f={"policy_unit_name": "STRASSE"}) == [2] and ids(f={"variant_name": "적립"}) == [3] and ids(f={"insurer": "KYOBOLIFE", "product_name": ""}) == [0, 2, 3]
    assert ids(f={"document_id": "x"}) == []
    assert [r.citation_id for r in search.citations(search.search(index(spark), [1.0, 0.0])).orderBy("citation_id").collect()] == ["C1", "C2", "C3"]


def test_evaluation(spark):
    met = lambda t, k, titles, types: spark.createDataFrame([(t, k, titles, types)], "t string, k string, a array<string>, b array<string>").select(evaluation.expectation_met("t", "k", "a", "b")).first()[0]
    assert met("제 1조  (목적)", "part", ["제1조(목적)"], None) and not met("제1조", "part", [], None)
    assert not met("x", "part", ["x"], ["article"]) and met("x", "part", ["x"], ["part"]) and met("y", "part", [], ["part"])
    specs = spark.createDataFrame([("a", ["x"], None), ("b", ["z"], ["part"]), ("c", ["q"], None)], "id string, expected_titles array<string>, expected_types array<string>")
    hits = spark.createDataFrame([("a", 1, "x", "part", True), ("b", 1, "y", "part", True), ("b", 4, "z", "part", False)], "query_id string, rank int, section_title string, section_type string, filters_matched boolean")
    per = evaluation.evaluate(hits, specs)
    got = {r.id: (r.pass_at_1, r.pass_at_3, r.pass_at_5, r.all_filters_matched) for r in per.collect()}
    assert got == {"a": (True, True, True, True), "b": (False, False, True, False), "c": (False, False, False, True)}
    s = evaluation.summary(per).first()
    assert (s.total_queries, round(s.hit_at_1, 3), round(s.hit_at_5, 3)) == (3, 0.333, 0.667)
    assert evaluation.summary(per.limit(0)).first().hit_at_1 == 0.0
    assert "**hit@1:** 0.333" in reports.evaluation_report(per, evaluation.summary(per))


def inferred(spark, filename, text):
    return staging.inferred(spark.createDataFrame([(filename, text)], "filename string, head_text string")).first()


@pytest.mark.parametrize(
    "filename, text, iso, confidence, review",
    [
        ("a_2026-01-31.pdf", "", "2026-01-31", "high", False),
        ("a.pdf", "시행 2026년 2월 3일", "2026-02-03", "medium", True),
        ("plan (2403).pdf", "", "2024-03-01", "low", True),
        ("plan_240315.pdf", "", "2024-03-15", "medium", True),
        ("plan_20240230.pdf", "", "", "unknown", True),
        ("x.pdf", "2024.05.06 그리고 2023-05-06", "2023-05-06", "high", False),
    ],
)
def test_dates(spark, filename, text, iso, confidence, review):
    d = inferred(spark, filename, text).effective_date
    assert (d.value, d.confidence, d.needs_review) == (iso, confidence, review)


def test_rules(spark):
    r = inferred(spark, "x.pdf", "교보생명 삼성 약관\n목 차\n무배당 교보로연금보험 ..... 12 ...... 3\n")
    assert tuple(r.insurer)[:3] == ("samsunglife", "medium", True) and r.document_type.confidence == "medium"
    assert tuple(r.product_name) == ("무배당 교보로연금보험", "high", False, "pdf_text:keyword:교보로연금보험")
    assert (r.product_type.value, r.product_slug.value, r.language.value) == ("annuity", "kyobo_ro_annuity_insurance", "ko")
    d = inferred(spark, "x.pdf", "본 상품은 보장성보험으로 저축(연금) 목적에는 적합하지 않습니다 연금보험")
    assert (d.product_type.value, d.product_name.evidence) == ("", "filename:stem_fallback")
    e = inferred(spark, "My Plan.v2.pdf", "")
    assert (e.product_name.value, e.product_slug.value, e.product_slug.evidence) == ("My Plan.v2", "my_plan_v2", "slug:ascii_normalized")


def test_manifests_and_files(spark, tmp_path):
    m = tmp_path / "m.yaml"
    m.write_text("documents:\n  - document_id: ' a '\n    source_file: in/a.pdf\n    tags: [x]\n    other: 1\n", encoding="utf-8")
    row = readers.manifest(spark, str(m)).first()
    assert (row.document_id, row.tags, row.notes) == ("a", ["x"], "")
    m.write_text("- 1", encoding="utf-8")
    with pytest.raises(ValueError, match="mapping"):
        readers.manifest(spark, str(m))
    m.write_text("", encoding="utf-8")
    assert readers.manifest(spark, str(m)).count() == 0
    with pytest.raises(ValueError):
        readers.resolved("/etc/x", "/r")
    qs = tmp_path / "q.yaml"
    qs.write_text("queries:\n  - id: a\n    query: ' 보험금 '\n    filters: {insurer: kyobolife}\n    expected_any_section_titles: [t]\n", encoding="utf-8")
    assert readers.retrieval_queries(spark, str(qs)).first()["query"] == "보험금"
    qs.write_text("queries:\n  - id: a\n    query: x\n", encoding="utf-8")
    with pytest.raises(ValueError, match="invalid retrieval queries"):
        readers.retrieval_queries(spark, str(qs))
    assert writers.manifest_snippet({"a": 'x"y\n', "tags": ["t"]}) == '  - a: "x\\"y\\n"\n    tags: ["t"]\n'
    (tmp_path / "s").write_bytes(b"1")
    assert writers.stage_file(str(tmp_path / "s"), str(tmp_path / "d/s")) and not writers.stage_file(str(tmp_path / "s"), str(tmp_path / "d/s"))
    (tmp_path / "s").write_bytes(b"2")
    with pytest.raises(FileExistsError):
        writers.stage_file(str(tmp_path / "s"), str(tmp_path / "d/s"))


def test_inbox(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "교보생명 20240115.pdf").write_text("교보생명 보험약관\n무배당 연금보험\f둘째 쪽", encoding="utf-8")
    (inbox / "b.pdf").write_text("nothing", encoding="utf-8")
    found = readers.files(spark, str(inbox))
    heads = readers.head_texts(found, readers.pages(found))
    got = {r.filename: r for r in staging.entries(heads.select("filename", "head_text", "content_hash")).collect()}
    ok = next(r for r in got.values() if not r.reason)
    assert ok.entry_document_id.startswith("kyobolife_annuity_annuity_insurance_policy_terms_20240115_") and got["b.pdf"].reason == "insurer_not_inferred"
    assert "status: ok" in reports.staging_preview(ok) and "status: skipped" in reports.staging_preview(got["b.pdf"])
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    watch_inbox(spark, str(inbox), out, check).awaitTermination()
    (inbox / "copy.pdf").write_text("nothing", encoding="utf-8")
    (inbox / "c.pdf").write_text("else", encoding="utf-8")
    watch_inbox(spark, str(inbox), out, check).awaitTermination()
    assert sorted(r.reason for r in spark.read.parquet(out).collect()) == ["", "insurer_not_inferred", "insurer_not_inferred"]
    wrong = readers.verified(spark.createDataFrame([("p", "00"), ("q", "00")], "path string, content_hash string"), spark.createDataFrame([("p", "11")], "path string, content_hash string"))
    assert sorted((r.path, r.problem) for r in wrong.collect()) == [("p", "hash_mismatch"), ("q", "missing_file")]


def test_index_and_service(spark, tmp_path):
    folder = f"{tmp_path}/index"
    p = pages(spark, "무배당 연금(적립형) 약관\n제1조 (목적)\n" + PROSE, "제2조 (정의)\n" + PROSE)
    config = service.build(p, folder, ModularEmbedder(), chunking.ChunkingConfig(120, 20))
    assert config["embedding_dim"] == 8 and config["num_chunks"] > 3
    rows = writers.read_index(spark, folder)[0].orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(len(rows))) and [r.chunk_id for r in rows] == sorted(r.chunk_id for r in rows)
    status, body = service.context(spark, {"query": "보험금", "index_dir": folder, "top_k": 2, "filters": {"variant_name": "적립", "include_section_types": []}})
    assert status == 200 and [c["citation_id"] for c in body["citations"]] == ["C1", "C2"] and body["filters"]["include_section_types"] is None
    assert json.loads(reports.bundle_json(body))["query"] == "보험금"
    ask = lambda **k: service.context(spark, {"query": "a", "index_dir": folder} | k)[0]
    assert [ask(query=" "), ask(top_k=0), ask(top_k=101), ask(index_dir=f"{tmp_path}/none"), ask(filters={"insurer": "nobody"}), ask(filters={"odd": 1})] == [422, 422, 422, 404, 400, 400]

    def broken(*_):
        raise RuntimeError

    assert service.context(spark, {"query": "a", "index_dir": "x"}, runner=broken)[0] == 500
    assert service.options(spark, folder)[1]["insurers"] == [{"value": "kyobolife", "label": "교보생명"}] and service.options(spark, " ")[0] == 422
    assert service.health() == (200, {"status": "ok"})
    with pytest.raises(ValueError, match="no chunks"):
        writers.build_index(spark.createDataFrame([], readers.CHUNK), folder, ModularEmbedder())
    writers.write_artifacts(sections.detect(p), f"{tmp_path}/sections", "sections", "2026-01-01T00:00:00Z")
    assert spark.read.text(f"{tmp_path}/sections", wholetext=True).count() == 1
