"""The registered queries of the evidence engine and the DuckDB SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.functions.embedders import ModularEmbedder, with_embedding
from evidex.operators import chunking, evaluation, identity, layout, quality, regions, search, sections, staging, units, validation
from evidex.plans import corpus
from evidex.plans import oracle as O
from evidex.sources import paged
from evidex.sources.folders import write_files
from evidex.sources.tables import shared_path, stored

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.policy_pages(read(spark, sf_dir, "documents"))


# search

#: Over d (vec_id): the metadata of the derived index.
_META = {
    "section_type": "CASE d % 9 WHEN 0 THEN 'article' WHEN 1 THEN 'part' WHEN 2 THEN 'toc' WHEN 3 THEN 'appendix' WHEN 4 THEN 'guide' WHEN 5 THEN 'legal_reference' WHEN 6 THEN 'glossary' WHEN 7 THEN 'summary' ELSE 'article' END",
    "section_title": "'제 ' || (d % 13) || ' 조 (' || CASE d % 3 WHEN 0 THEN '목적' WHEN 1 THEN '보험금  지급' ELSE '용어' END || ')'",
    "policy_unit_name": "CASE WHEN d % 4 < 2 THEN '무배당 연금보험' END",
    "variant_name": "CASE d % 4 WHEN 0 THEN '적립형' WHEN 1 THEN '거치형' END",
}


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived index: a row per vector that has a document, its metadata, and its vector."""
    docs = corpus.policy_documents(read(spark, sf_dir, "documents")).select("doc_id", "document_id")
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = vectors.join(docs, F.col("vec_id") == F.col("doc_id")).withColumn("d", F.col("vec_id")).selectExpr("vec_id row_idx", "d", "document_id", *[f"{v} {k}" for k, v in _META.items()], "embedding")
    more = {"section_id": F.concat(F.lit("sec::"), F.floor(F.col("d") / 4)), "chunk_id": F.concat("document_id", F.lit("::chunk::0000::000")), "page_start": (F.col("d") % 17 + 1).cast("int"), "page_end": (F.col("d") % 17 + 2).cast("int"), "char_start": F.col("d") * 10, "char_end": F.col("d") * 10 + 90, "text": F.concat(F.lit("본문 "), F.col("d"))}
    return identity.enriched(rows.withColumns(more).drop("d"))


_PARSED = """p0 AS (SELECT *, regexp_extract(document_id, '^(.+)_policy_terms_(\\d{8})_([a-f0-9]{8})$', 1) AS lft FROM %s),
p1 AS (SELECT *, split_part(lft, '_', 1) AS insurer, substr(lft, length(split_part(lft, '_', 1)) + 2) AS rest FROM p0),
p2 AS (SELECT *, CASE WHEN starts_with(rest, 'variable_annuity_') THEN 'variable_annuity' WHEN starts_with(rest, 'whole_life_') THEN 'whole_life' ELSE split_part(rest, '_', 1) END AS product_type FROM p1),
p3 AS (SELECT *, replace(substr(rest, length(product_type) + 2), '_', ' ') AS product_name,
  CASE insurer WHEN 'kyobolife' THEN '교보생명' WHEN 'samsunglife' THEN '삼성생명' WHEN 'miraeassetlife' THEN '미래에셋생명' ELSE insurer END AS insurer_display_name,
  CASE product_type WHEN 'annuity' THEN '연금보험' WHEN 'variable_annuity' THEN '변액연금보험' WHEN 'cancer' THEN '암보험' WHEN 'whole_life' THEN '종신보험' ELSE product_type END AS product_type_display_name FROM p2)"""
_INDEX = O.after(
    f"""i0 AS (SELECT vec_id AS row_idx, vec_id AS d, document_id, embedding, {", ".join(f"{v} AS {k}" for k, v in _META.items())} FROM embeddings JOIN (SELECT DISTINCT d AS doc_id, document_id FROM k1) ON vec_id = doc_id),
i1 AS (SELECT *, 'sec::' || (d // 4) AS section_id FROM i0)""",
    _PARSED % "i1",
)
_SCORED = _INDEX + ", sc AS (SELECT p3.*, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM p3)"
_HITS = "SELECT row_number() OVER (ORDER BY score DESC, row_idx) AS rank, row_idx, document_id, section_type, round(score, 6) AS score FROM sc WHERE {} ORDER BY rank LIMIT {}"
_DEFAULT = "section_type NOT IN ('toc', 'cover', 'guide', 'summary')"


def _found(spark, sf_dir, k, filters, **more) -> DataFrame:
    # one row of a fixed number of dimensions
    vector = read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    hits = search.search(index_of(spark, sf_dir), list(vector[0]) if vector else [], k, filters, **more)
    return hits.select(F.col("rank").cast("long").alias("rank"), "row_idx", "document_id", "section_type", F.round("score", 6).alias("score"))


@query(_SCORED + _HITS.format(_DEFAULT, 5))
def q_search_topk(spark, sf_dir):
    return _found(spark, sf_dir, 5, search.SearchFilters())


@query(_SCORED + _HITS.format(_DEFAULT + " AND insurer = 'kyobolife' AND contains(product_name, 'plan') AND variant_name = '적립형'", 20))
def q_search_filtered(spark, sf_dir):
    return _found(spark, sf_dir, 20, search.SearchFilters(insurer="KyoboLife", product_name="PLAN", variant_name="적립"))


@query(_SCORED + _HITS.format("section_type IN ('toc', 'guide', 'part') AND section_type <> 'part'", 10))
def q_search_include_types(spark, sf_dir):
    return _found(spark, sf_dir, 10, search.SearchFilters(include_section_types=frozenset({"toc", "guide", "part"}), exclude_section_types=frozenset({"part"})))


@query(_SCORED + _HITS.format("section_type <> 'article'", 10))
def q_search_exclude_types(spark, sf_dir):
    return _found(spark, sf_dir, 10, search.SearchFilters(exclude_section_types=frozenset({"article"}), use_default_section_type_excludes=False))


@query(_SCORED.replace(", sc AS", ", sc0 AS") + f", sc AS (SELECT * FROM sc0 WHERE {_DEFAULT} QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY score DESC, row_idx) = 1) " + _HITS.format("true", 15))
def q_search_dedupe_section(spark, sf_dir):
    return _found(spark, sf_dir, 15, search.SearchFilters(), dedupe_section=True)


@query(
    _SCORED
    + f""" SELECT 'C' || row_number() OVER (ORDER BY score DESC, row_idx) AS citation_id, document_id || '::chunk::0000::000' AS chunk_id, section_id, section_title, section_type, document_id, insurer, product_type,
    insurer_display_name, product_type_display_name, product_name AS product_display_name, policy_unit_name, variant_name, (d % 17 + 1)::INTEGER AS page_start, (d % 17 + 2)::INTEGER AS page_end, d * 10 AS char_start, d * 10 + 90 AS char_end, round(score, 6) AS score, '본문 ' || d AS text
    FROM sc WHERE {_DEFAULT} ORDER BY score DESC, row_idx LIMIT 5"""
)
def q_citation_context(spark, sf_dir):
    vector = read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    hits = search.search(index_of(spark, sf_dir), list(vector[0]) if vector else [])
    return search.citations(hits).withColumn("score", F.round("score", 6))


def _specs(spark, sf_dir) -> DataFrame:
    """The query set: every vector whose id is divisible by 20, with filters and expectations by its id."""
    e = read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").selectExpr("vec_id d", "embedding vector")
    return e.selectExpr(
        "concat('q', d) id",
        "vector",
        "cast(null as string) insurer",
        "case when d % 40 = 0 then 'annuity' end product_type",
        "case when d % 60 = 0 then '적립형' end variant_name",
        "5 top_k",
        "d % 100 <> 0 dedupe_section",
        "case when d % 3 <> 2 then array(concat('제', d % 13, '조 (목적)'), '제 3조 (보험금 지급)') else array() end expected_titles",
        "case when d % 3 <> 0 then array('article', 'part') end expected_types",
    )


_MANY = (
    _INDEX
    + f""", sp AS (SELECT vec_id AS qd, embedding AS vector, CASE WHEN vec_id % 40 = 0 THEN 'annuity' END AS want_type, CASE WHEN vec_id % 60 = 0 THEN '적립형' END AS want_variant, vec_id % 100 <> 0 AS dedupe FROM embeddings WHERE vec_id % 20 = 0),
mt AS (SELECT qd, dedupe, p3.*, list_dot_product(p3.embedding::DOUBLE[], vector::DOUBLE[]) AS score FROM p3, sp WHERE {_DEFAULT} AND (want_type IS NULL OR want_type = product_type) AND (want_variant IS NULL OR contains(variant_name, want_variant))),
dd AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY qd, CASE WHEN dedupe THEN section_id ELSE row_idx::VARCHAR END ORDER BY score DESC, row_idx) = 1),
ht AS (SELECT *, row_number() OVER (PARTITION BY qd ORDER BY score DESC, row_idx) AS rank FROM dd QUALIFY rank <= 5)"""
)


@query(_MANY + " SELECT 'q' || qd AS query_id, rank, row_idx, section_title, round(score, 6) AS score FROM ht")
def q_multi_query_topk(spark, sf_dir):
    hits = search.search_many(index_of(spark, sf_dir), _specs(spark, sf_dir))
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "row_idx", "section_title", F.round("score", 6).alias("score"))


def _evaluated(spark, sf_dir) -> DataFrame:
    specs = _specs(spark, sf_dir)
    hits = search.search_many(index_of(spark, sf_dir), specs).withColumn("filters_matched", search.SearchFilters().predicate())
    return evaluation.evaluate(hits, specs)


_OK = (
    _MANY
    + f""", ok AS (SELECT ht.*, CASE WHEN qd % 3 <> 2 AND qd % 3 <> 0 THEN tm AND ty WHEN qd % 3 <> 2 THEN tm ELSE ty END AS met FROM (SELECT *,
  ({O.compact("section_title")} IN ({O.compact("'제' || (qd % 13) || '조 (목적)'")}, {O.compact("'제 3조 (보험금 지급)'")})) AS tm, section_type IN ('article', 'part') AS ty FROM ht) ht),
ev AS (SELECT 'q' || sp.qd AS id, coalesce(bool_or(met AND rank <= 1), false) AS pass_at_1, coalesce(bool_or(met AND rank <= 3), false) AS pass_at_3, coalesce(bool_or(met AND rank <= 5), false) AS pass_at_5, coalesce(string_agg(section_type, ',' ORDER BY rank), '') AS top_types
  FROM sp LEFT JOIN ok ON ok.qd = sp.qd GROUP BY sp.qd)"""
)


@query(_OK + " SELECT id, pass_at_1, pass_at_3, pass_at_5, true AS all_filters_matched, top_types FROM ev")
def q_eval_per_query(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("id", "pass_at_1", "pass_at_3", "pass_at_5", "all_filters_matched", F.array_join("top_types", ",").alias("top_types"))


@query(_OK + " SELECT count(*) AS total_queries, round(avg(pass_at_1::INT), 9) AS hit_at_1, round(avg(pass_at_3::INT), 9) AS hit_at_3, round(avg(pass_at_5::INT), 9) AS hit_at_5 FROM ev")
def q_eval_summary(spark, sf_dir):
    out = evaluation.summary(_evaluated(spark, sf_dir))
    return out.select("total_queries", *[F.round(f"hit_at_{k}", 9).alias(f"hit_at_{k}") for k in (1, 3, 5)])


@query(
    _INDEX
    + """ SELECT DISTINCT dimension, value, label FROM (SELECT unnest([{'dimension': 'insurers', 'value': insurer, 'label': insurer_display_name}, {'dimension': 'product_types', 'value': product_type, 'label': product_type_display_name},
  {'dimension': 'product_names', 'value': product_name, 'label': product_name}, {'dimension': 'variant_names', 'value': variant_name, 'label': variant_name}, {'dimension': 'policy_unit_names', 'value': policy_unit_name, 'label': policy_unit_name}], recursive := true) FROM p3) WHERE value <> ''"""
)
def q_filter_options(spark, sf_dir):
    return identity.filter_options(index_of(spark, sf_dir))


@query(O.after(_PARSED % "k1") + " SELECT d AS doc_id, insurer, product_type, product_name, replace(product_name, ' ', '_') AS product_slug, regexp_extract(document_id, '(\\d{8})_([a-f0-9]{8})$', 1) AS effective_date, regexp_extract(document_id, '([a-f0-9]{8})$', 1) AS content_hash FROM p3")
def q_parse_document_id(spark, sf_dir):
    docs = corpus.policy_documents(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", identity.parsed("document_id").alias("k")).select("doc_id", "k.*")


@query(O.after(_PARSED % "k1") + " SELECT d AS doc_id, CASE WHEN d % 3 = 0 THEN 'given' ELSE insurer END AS insurer, product_type, CASE WHEN d % 3 = 0 THEN 'given' ELSE insurer_display_name END AS insurer_display_name, product_type_display_name, product_name AS product_display_name FROM p3")
def q_enrich_labels(spark, sf_dir):
    docs = corpus.policy_documents(read(spark, sf_dir, "documents")).select("doc_id", "document_id", F.expr("case when doc_id % 3 = 0 then 'given' end").alias("insurer"))
    return identity.enriched(docs).select("doc_id", "insurer", "product_type", "insurer_display_name", "product_type_display_name", "product_display_name")


# text and quality


@query(
    f"""WITH p AS (SELECT doc_id, CASE WHEN starts_with(lower({O.strip("coalesce(text, '')")}), 'passage:') THEN {O.strip("coalesce(text, '')")} ELSE 'passage: ' || {O.strip("coalesce(text, '')")} END AS t FROM documents),
s AS (SELECT doc_id, list_sum(list_transform(string_split(t, ''), lambda c: unicode(c)))::BIGINT AS n FROM p),
v AS (SELECT doc_id, list_transform(range(8), lambda i: (n + 31 * i) % 251 / 250) AS x FROM s),
u AS (SELECT doc_id, list_transform(x, lambda y: (y / sqrt(list_sum(list_transform(x, lambda z: z * z))))::FLOAT::DOUBLE) AS e FROM v)
SELECT doc_id, {", ".join(f"e[{i + 1}] AS d{i}" for i in range(8))} FROM u"""
)
def q_passage_vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", T.prefixed(F.coalesce("text", F.lit("")), "passage").alias("passage"))
    out = with_embedding(rows, ModularEmbedder(), "passage")
    return out.select("doc_id", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(8)])


@query(
    O.after()
    + f"""SELECT document_id, page_number, i, CASE WHEN starts_with(lower(s), 'passage:') THEN s ELSE 'passage: ' || s END AS passage, length({O.clip("replace(line, chr(10), ' ')", 240)}) AS preview_chars, {O.compact("line")} = {O.compact(O.spaced("line"))} AS same_title, {O.spaced("line")} AS spaced
  FROM (SELECT *, {O.strip("line")} AS s FROM l)"""
)
def q_line_texts(spark, sf_dir):
    rows = corpus.policy_lines(read(spark, sf_dir, "documents"))
    same = evaluation.title_met(F.col("line"), F.array(T.single_spaced("line")))
    return rows.select("document_id", F.col("page_number").cast("long").alias("page_number"), F.col("i").cast("long").alias("i"), T.prefixed("line", "passage").alias("passage"), F.length(T.hit_preview("line")).cast("long").alias("preview_chars"), same.alias("same_title"), T.single_spaced("line").alias("spaced"))


_QUALITY = f"""dq AS (SELECT document_id, count(*) AS page_count, sum(length(text))::BIGINT AS total_chars, avg(length(text)) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, count_if(text = '')::BIGINT AS empty_pages, count_if(length(text) < 50)::BIGINT AS low_pages,
  min(CASE WHEN {O.strip("text")} <> '' THEN page_number END) AS first_page FROM pg GROUP BY 1)"""


@query(O.after(_QUALITY) + f"SELECT document_id, page_count, total_chars, round(avg_chars, 6) AS avg_chars, min_chars, max_chars, empty_pages, low_pages, first_page, (SELECT {O.clip(O.strip('text'), 200)} FROM pg WHERE pg.document_id = dq.document_id AND page_number = first_page) AS first_preview FROM dq")
def q_doc_quality(spark, sf_dir):
    out = quality.document_quality(corpus.policy_documents(read(spark, sf_dir, "documents")), pages_of(spark, sf_dir))
    return out.withColumns({"avg_chars": F.round("avg_chars", 6), "first_page": F.col("first_page").cast("long")})


@query(O.after(_QUALITY) + "SELECT count(*) AS documents, sum(page_count)::BIGINT AS pages, sum(total_chars)::BIGINT AS chars, count_if(empty_pages > 0)::BIGINT AS documents_with_empty, count_if(low_pages > 0)::BIGINT AS documents_with_low FROM dq")
def q_corpus_quality(spark, sf_dir):
    return quality.corpus_quality(quality.document_quality(corpus.policy_documents(read(spark, sf_dir, "documents")), pages_of(spark, sf_dir)))


@query(O.after() + "SELECT document_id, page_number, length(text) AS char_count, CASE WHEN text = '' THEN 'empty' ELSE 'low_text' END AS reason FROM pg WHERE length(text) < 50")
def q_suspicious_pages(spark, sf_dir):
    return quality.suspicious_pages(pages_of(spark, sf_dir)).withColumn("page_number", F.col("page_number").cast("long"))


@query(O.after() + "SELECT document_id, page_number, page_start FROM ps")
def q_full_text_offsets(spark, sf_dir):
    return layout.with_page_start(pages_of(spark, sf_dir)).select("document_id", F.col("page_number").cast("long").alias("page_number"), "page_start")


@query(O.after() + 'SELECT document_id, page_number, line_no, "offset", line FROM ln')
def q_explode_lines(spark, sf_dir):
    out = layout.lines(pages_of(spark, sf_dir))
    return out.select("document_id", F.col("page_number").cast("long").alias("page_number"), F.col("line_no").cast("long").alias("line_no"), F.col("offset").cast("long").alias("offset"), "line")


@query(O.after() + 'SELECT ln.document_id, ln."offset", max(ps.page_number) AS page FROM ln JOIN ps ON ps.document_id = ln.document_id AND ps.page_start <= ln."offset" GROUP BY 1, 2')
def q_page_for_offset(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    asked = layout.lines(pages).select("document_id", F.col("offset").cast("long").alias("offset"))
    out = layout.with_page(asked, layout.outline(pages), F.col("offset"), "page")
    return out.select("document_id", "offset", F.col("page").cast("long").alias("page")).distinct()


# regions, candidates, sections, units


@query(O.after(O.REGIONS) + 'SELECT document_id, page_number, dots, articles, "rows", heads, legal, substantive FROM r2')
def q_region_signals(spark, sf_dir):
    out = regions.signals(pages_of(spark, sf_dir))
    n = lambda c: c.cast("long")
    return out.select("document_id", n(F.col("page_number")).alias("page_number"), n(F.col("dots")).alias("dots"), n(F.col("articles")).alias("articles"), n(F.col("rows")).alias("rows"), n(F.size("heads")).alias("heads"), "legal", "substantive")


@query(O.after(O.REGIONS) + "SELECT document_id, page_number, region_type, round(confidence, 6) AS confidence FROM rg")
def q_region_scores(spark, sf_dir):
    return regions.classify(pages_of(spark, sf_dir)).select("document_id", F.col("page_number").cast("long").alias("page_number"), "region_type", F.round("confidence", 6).alias("confidence"))


@query(O.after(O.CANDIDATES) + "SELECT document_id, document_id || '::cand::' || lpad(start_char_offset::VARCHAR, 10, '0') AS candidate_id, section_type, title, start_page, start_char_offset, 0.82::DOUBLE AS confidence FROM cd")
def q_line_rules(spark, sf_dir):
    out = sections.candidates(pages_of(spark, sf_dir))
    return out.select("document_id", "candidate_id", "section_type", "title", F.col("start_page").cast("long").alias("start_page"), F.col("start_char_offset").cast("long").alias("start_char_offset"), "confidence")


_FULL = (O.REGIONS, O.CANDIDATES, O.MARKERS, O.VERDICTS)


def _verdicts(spark, sf_dir):
    pages = stored(layout.with_page_start(pages_of(spark, sf_dir)), "pages")
    lines = stored(layout.lines(pages, all_pages=True), "lines")
    texts = layout.outline(pages)
    return sections.judged(stored(sections.candidates(lines), "candidates"), stored(regions.classify(pages.drop("page_start")), "regions"), texts, units.markers(texts, lines), lines)


@query(O.after(*_FULL) + "SELECT document_id, start_char_offset, section_type, blocked IS NULL AS emit, coalesce(blocked, '') AS reason FROM v10")
def q_candidate_verdicts(spark, sf_dir):
    out = _verdicts(spark, sf_dir)
    last = F.regexp_replace(F.element_at(F.filter("trace", lambda x: F.startswith(x, F.lit("filter:"))), -1), "^filter:", "")
    reason = F.when(F.col("emit"), "").otherwise(F.regexp_replace(last, "^(legal_blocked_guide_phrase):.*$", "$1"))
    return out.select("document_id", F.col("start_char_offset").cast("long").alias("start_char_offset"), "section_type", "emit", reason.alias("reason"))


@query(O.after(*_FULL, O.UNITS, O.SECTIONS) + "SELECT document_id, section_id, section_type, title, start_page, end_page, start_char_offset, end_char_offset, parent_section_id, text, round(assembly_confidence, 4)::DOUBLE AS assembly_confidence, policy_unit_id, policy_unit_name, variant_name FROM sc")
def q_sections(spark, sf_dir):
    names = ["document_id", "section_id", "section_type", "title", "start_page", "end_page", "start_char_offset", "end_char_offset", "parent_section_id", "text", "policy_unit_id", "policy_unit_name", "variant_name"]
    out = sections.detect(pages_of(spark, sf_dir)).select(*names, F.round("assembly_confidence", 4).alias("assembly_confidence"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("start_page", "end_page", "start_char_offset", "end_char_offset")})


@query(O.after(O.MARKERS) + 'SELECT document_id, "offset", name, variant FROM mk')
def q_policy_markers(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    return units.markers(layout.outline(pages), layout.lines(pages, all_pages=True))


@query(O.after(O.MARKERS, O.UNITS) + "SELECT document_id, policy_unit_id, policy_unit_name, variant_name, start_char_offset, end_char_offset, coalesce(tail_cutoff, -1) AS tail_cutoff FROM un")
def q_policy_units(spark, sf_dir):
    pages = stored(layout.with_page_start(pages_of(spark, sf_dir)), "pages")
    lines, texts = stored(layout.lines(pages, all_pages=True), "lines"), layout.outline(pages)
    return units.units(texts, stored(units.markers(texts, lines), "markers"), lines).select("document_id", "policy_unit_id", "policy_unit_name", "variant_name", "start_char_offset", "end_char_offset", F.coalesce("tail_cutoff", F.lit(-1)).alias("tail_cutoff"))


@query(O.after(*_FULL, O.UNITS, O.SECTIONS) + "SELECT section_type, variant_name, count(*) AS n, count(policy_unit_id) AS in_unit, count(parent_section_id) AS with_parent FROM sc GROUP BY 1, 2")
def q_unit_assignment(spark, sf_dir):
    out = sections.detect(pages_of(spark, sf_dir))
    return out.groupBy("section_type", "variant_name").agg(F.count(F.lit(1)).alias("n"), F.count("policy_unit_id").alias("in_unit"), F.count("parent_section_id").alias("with_parent"))


# chunks


@query("WITH RECURSIVE src AS (SELECT doc_id, text AS x FROM documents)," + O.chunk_spans("src", "doc_id") + " SELECT doc_id, chunk_index::BIGINT AS chunk_index, a::BIGINT AS span_start, b::BIGINT AS span_end FROM cs")
def q_chunk_spans(spark, sf_dir):
    return chunking.spans(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "span_start", "span_end")])


def _chunks(spark, sf_dir) -> DataFrame:
    return chunking.chunks(stored(sections.detect(pages_of(spark, sf_dir)), "sections"))


_CHUNKS = (
    "WITH RECURSIVE "
    + ",".join((corpus.SQL, O.LAYOUT, *_FULL, O.UNITS, O.SECTIONS, "sx AS MATERIALIZED (SELECT *, text AS x, row_number() OVER (PARTITION BY document_id ORDER BY section_id) - 1 AS position FROM sc)", O.chunk_spans("sx", "section_id")))
    + f""", ch AS (SELECT sx.document_id, sx.document_id || '::chunk::' || lpad(position::VARCHAR, 4, '0') || '::' || lpad(chunk_index::VARCHAR, 3, '0') AS chunk_id, section_id, section_type, variant_name, policy_unit_id, chunk_index, {O.strip("substr(x, a + 1, b - a)")} AS text, start_char_offset + a AS char_start, start_char_offset + b AS char_end, b - a AS char_count, (b - a + 3) // 4 AS token_estimate FROM cs JOIN sx USING (section_id)) """
)


@query(_CHUNKS + "SELECT document_id, chunk_id, section_id, section_type, chunk_index::BIGINT AS chunk_index, text, char_start, char_end, char_count::BIGINT AS char_count, token_estimate::BIGINT AS token_estimate FROM ch")
def q_chunks(spark, sf_dir):
    out = _chunks(spark, sf_dir).select("document_id", "chunk_id", "section_id", "section_type", "chunk_index", "text", "char_start", "char_end", "char_count", "token_estimate")
    return out.withColumns({c: F.col(c).cast("long") for c in ("chunk_index", "char_start", "char_end", "char_count", "token_estimate")})


@query(
    _CHUNKS
    + """SELECT 'document' AS kind, d.document_id AS "key", count(ch.chunk_id) AS n FROM (SELECT DISTINCT document_id FROM k1) d LEFT JOIN ch USING (document_id) GROUP BY 2
UNION ALL SELECT 'section_type', section_type, count(*) FROM ch GROUP BY 2 UNION ALL SELECT 'variant', coalesce(variant_name, '<null>'), count(*) FROM ch GROUP BY 2"""
)
def q_chunk_summary(spark, sf_dir):
    return chunking.run_summary(corpus.policy_documents(read(spark, sf_dir, "documents")), _chunks(spark, sf_dir))


@query(
    _CHUNKS
    + """SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, sum(char_count)::BIGINT AS chars, min(char_count) AS least, max(char_count) AS most, count_if(char_count > 2200)::BIGINT AS over_max, count_if(variant_name IS NULL)::BIGINT AS null_variant,
  0::BIGINT AS blank_section_id, count_if(variant_name IS NOT NULL AND policy_unit_id IS NULL)::BIGINT AS variant_without_unit, count_if(chunk_index > 0)::BIGINT AS later_chunks, 0::BIGINT AS missing_type, count_if(text = '')::BIGINT AS missing_text, 0::BIGINT AS negative_index,
  count_if(length(text) <> char_count)::BIGINT AS length_mismatches, count(*) - count(DISTINCT chunk_id) AS duplicate_ids FROM ch"""
)
def q_chunk_inspection(spark, sf_dir):
    return chunking.inspection(_chunks(spark, sf_dir))


@query(_CHUNKS + """SELECT k."kind", k."key", count(*) AS n FROM (SELECT unnest([{'kind': 'document', 'key': document_id}, {'kind': 'section_type', 'key': section_type}, {'kind': 'variant', 'key': coalesce(variant_name, '<null>')}, {'kind': 'strategy', 'key': 'section_aware_paragraph_v1'}]) AS k FROM ch) GROUP BY 1, 2""")
def q_chunk_groups(spark, sf_dir):
    return chunking.inspection_groups(_chunks(spark, sf_dir))


@query(_CHUNKS + "SELECT document_id, chunk_id, section_type, char_count FROM ch ORDER BY char_count DESC, document_id, chunk_id LIMIT 20")
def q_largest_chunks(spark, sf_dir):
    return chunking.largest(_chunks(spark, sf_dir)).withColumn("char_count", F.col("char_count").cast("long"))


# staging

#: Over d (doc_id) and text: the name and first pages of a staged file.
_FILE = "CASE d % 6 WHEN 0 THEN '삼성생명_연금_20240' || (1 + d % 9) || '15.pdf' WHEN 1 THEN '교보 암보험 (2' || (d % 4) || '0' || (1 + d % 9) || ').pdf' WHEN 2 THEN 'plan_2' || (d % 4) || '0' || (1 + d % 9) || '1' || (d % 10) || '.pdf' WHEN 3 THEN '미래에셋_2023.0' || (1 + d % 9) || '.30.pdf' WHEN 4 THEN 'terms-' || d || '.v2.pdf' ELSE '' END"
_HEAD = """CASE d % 7 WHEN 0 THEN '보험약관' || chr(10) || '무배당 교보로연금보험 ..... 12' || chr(10) || '시행일 2023년 ' || (1 + d % 12) || '월 ' || (1 + d % 31) || '일' WHEN 1 THEN '목 차' || chr(10) || '본 상품은 보장성보험으로 저축(연금) 목적에는 적합하지 않습니다 연금보험' || chr(10) || '약관'
 WHEN 2 THEN '미래에셋생명 변액연금보험' || chr(10) || '2022-0' || (1 + d % 9) || '-3' || (d % 2) || ' 보험약관' WHEN 3 THEN '  Fixed   Plan ' || d || ' (0' || (d % 10) || '13)' || chr(10) || '밸런스종신보험 약관' WHEN 4 THEN '20240231 20240' || (1 + d % 9) || '1999' || chr(10) || '교보생명 통합암보험 약관' ELSE '' END || chr(10) || text"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").selectExpr("doc_id d", "coalesce(text, '') text")
    return docs.selectExpr("d doc_id", f"{_FILE} filename", f"{_HEAD} head_text", "sha2(text, 256) content_hash")


_STAGED = f"WITH f AS (SELECT doc_id, {_FILE} AS filename, {_HEAD} AS head_text, sha256(text) AS content_hash FROM (SELECT doc_id, doc_id AS d, coalesce(text, '') AS text FROM documents))"
_HAY = "(filename || chr(10) || head_text)"


def _case(rules: list[tuple[str, str]], other: str = "''") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in rules) + f" ELSE {other} END"


_INSURER_SQL = _case([(f"contains({_HAY}, '{w}')", f"'{v}|{c}|keyword:{w}'") for w, v, c in staging.INSURERS], "'|unknown|none'")
_DOCTYPE_SQL = _case([(f"contains({_HAY}, '{w}')", f"'{v}|{c}|keyword:{w}'") for w, v, c in staging.DOCUMENT_TYPES], "'|unknown|none'")
_TOC_TRAIL = f"(?:{staging.TOC_LEAD}{{3,}}[0-9]{{1,4}}{T.W}*)+$"
_LINES_SQL = f"list_filter(list_transform({O.lines('head_text')}, lambda x: {O.spaced('x')}), lambda x: x <> '')[1:40]"
_GENERIC_SQL = f"(contains(x, '{staging.DISCLAIMER}') OR x IN ('보험약관', '목 차', '목차', '고객권리안내문') OR contains(x, '고객권리안내문') OR contains(lower(x), '{staging.GUIDE_BOOK}') OR starts_with(x, '본 상품은 보장성보험으로') OR starts_with(x, '목차') OR starts_with(x, '목 차'))"
_NAME_SQL = f"""n0 AS (SELECT *, list_filter({_LINES_SQL}, lambda x: NOT {_GENERIC_SQL}) AS titles FROM f),
n1 AS (SELECT *, {_case([(f"len(list_filter(titles, lambda x: contains(x, '{w}'))) > 0", f"'{w}'") for w in staging.NAME_WORDS], "NULL")} AS word, list_filter(titles, lambda x: length(x) >= 6)[1] AS long_line, regexp_replace(filename, '(.)\\.[^.]+$', '\\1') AS stem FROM n0),
n2 AS (SELECT *, substr({O.strip(f"regexp_replace({O.strip('coalesce(list_filter(titles, lambda x: contains(x, word))[1], long_line, stem)')}, {O.q(_TOC_TRAIL)}, '')")}, 1, 200) AS product_name,
  CASE WHEN word IS NOT NULL THEN 'high|pdf_text:keyword:' || word WHEN long_line IS NOT NULL THEN 'medium|pdf_text:first_non_generic_line' WHEN stem <> '' THEN 'low|filename:stem_fallback' ELSE 'unknown|none' END AS name_how FROM n1)"""


def _type_sql(x: str) -> str:
    return _case([(O.like(x, words), f"'{kind}|{hint}'") for words, kind, hint in staging.TYPE_WORDS], "NULL")


_TYPE_SQL = f"""n3 AS (SELECT *, {_type_sql("concat_ws(chr(10), nullif(" + O.strip("product_name") + ", ''), nullif(filename, ''))")} AS primary_type,
  {_type_sql("concat_ws(chr(10), array_to_string(list_filter(" + O.lines("head_text") + ", lambda z: NOT contains(" + O.spaced("z") + ", '" + staging.DISCLAIMER + "')), chr(10)), filename)")} AS secondary_type FROM n2),
n4 AS (SELECT *, split_part(coalesce(primary_type, secondary_type, ''), '|', 1) AS product_type FROM n3),
n5 AS (SELECT *, {_case([(f"contains({O.spaced('product_name')}, '{w}')", f"'{s}|slug:keyword:{w}'") for w, s in zip(staging.NAME_WORDS, staging.SLUGS)], "CASE WHEN regexp_matches(product_name, '[A-Za-z0-9]') THEN regexp_replace(regexp_replace(lower(product_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '|slug:ascii_normalized' ELSE product_type || '_' || substr(sha256(" + O.spaced("product_name") + "), 1, 8) || '|slug:hash8_fallback' END")} AS slug FROM n4)"""


@query(
    f"{_STAGED}, {_NAME_SQL}, {_TYPE_SQL} SELECT doc_id, {_INSURER_SQL} AS insurer, {_DOCTYPE_SQL} AS document_type, product_name || '|' || name_how AS product_name, "
    "CASE WHEN primary_type IS NOT NULL THEN product_type || '|' || CASE WHEN product_name <> '' THEN 'high' ELSE 'medium' END || '|product_signal:' || split_part(primary_type, '|', 2) || ':primary' WHEN secondary_type IS NOT NULL THEN product_type || '|medium|product_signal:' || split_part(secondary_type, '|', 2) || ':filtered_text' ELSE '|unknown|none' END AS product_type, "
    "slug AS product_slug, CASE WHEN regexp_matches(head_text, '[가-힣]') THEN 'ko' ELSE '' END AS language FROM n5"
)
def q_staging_fields(spark, sf_dir):
    out = staging.inferred(staged(spark, sf_dir))
    said = lambda n: F.concat_ws("|", f"{n}.value", f"{n}.confidence", f"{n}.evidence").alias(n)
    return out.select("doc_id", said("insurer"), said("document_type"), said("product_name"), said("product_type"), F.concat_ws("|", "product_slug.value", "product_slug.evidence").alias("product_slug"), F.col("language.value").alias("language"))


def _dates_sql() -> str:
    def found(source: str, pattern: str, iso: str, tag: str, confidence: str, rank: int, place: str) -> str:
        return f"SELECT doc_id, filename, m, {iso} AS iso, {rank} AS rank, {place} AS named, '{tag}' AS tag, '{confidence}' AS confidence FROM (SELECT doc_id, filename, unnest(regexp_extract_all({source}, {O.q(pattern)})) AS m FROM f)"

    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    iso8 = f"substr({digits}, 1, 4) || '-' || substr({digits}, 5, 2) || '-' || substr({digits}, 7, 2)"
    korean = "regexp_extract(m, '^(\\d{4})', 1) || '-' || lpad(regexp_extract(m, '년\\D*(\\d{1,2})월', 1), 2, '0') || '-' || lpad(regexp_extract(m, '월\\D*(\\d{1,2})일', 1), 2, '0')"
    year = lambda x: f"CASE WHEN {x} <= '69' THEN '20' ELSE '19' END || {x}"
    month = year("substr(m, 2, 2)") + " || '-' || substr(m, 4, 2) || '-01'"
    token = year("substr(m, 1, 2)") + " || '-' || substr(m, 3, 2) || '-' || substr(m, 5, 2)"
    named = "contains(filename, m)"
    parts = [
        found(_HAY, staging.ISO, iso8, "YYYY-MM-DD", "high", 0, named),
        found(_HAY, staging.DOTTED, iso8, "YYYY.MM.DD", "high", 0, named),
        found(_HAY, staging.COMPACT, iso8, "YYYYMMDD", "high", 0, named),
        found("head_text", staging.KOREAN, korean, "korean_yyyymmdd", "medium", 1, "false"),
        found(_HAY, staging.YEAR_MONTH, month, "YYMM_parens_inferred_day_01", "low", 2, named),
        f"SELECT doc_id, filename, m, {token} AS iso, 1, true, 'YYMMDD:filename_token', 'medium' FROM (SELECT doc_id, filename, unnest(string_split_regex(filename, '[^0-9]+')) AS m FROM f) WHERE length(m) = 6",
    ]
    order = "CASE tag WHEN 'YYYY-MM-DD' THEN 0 WHEN 'YYYY.MM.DD' THEN 1 WHEN 'YYYYMMDD' THEN 2 WHEN 'korean_yyyymmdd' THEN 3 WHEN 'YYMM_parens_inferred_day_01' THEN 4 ELSE 5 END"
    return f"""a AS ({" UNION ALL ".join(parts)}), b AS (SELECT *, CASE WHEN tag LIKE 'YYYY%' OR tag LIKE 'YYMM_p%' THEN 'pattern:' || tag || CASE WHEN named THEN ':filename' ELSE ':text' END ELSE 'pattern:' || tag END AS evidence FROM a WHERE try_cast(iso AS DATE) IS NOT NULL),
dt AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, iso ORDER BY rank, NOT named, {order}) = 1)"""


@query(f"{_STAGED}, {_dates_sql()} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank, NOT named, iso) - 1 AS place, iso, evidence, confidence FROM dt")
def q_date_candidates(spark, sf_dir):
    out = staged(spark, sf_dir).select("doc_id", "filename", "head_text")
    out = staging.date_candidates(out).select("doc_id", F.posexplode("dates").alias("place", "c"))
    return out.select("doc_id", F.col("place").cast("long").alias("place"), "c.iso", "c.evidence", "c.confidence")


@query(
    f"""{_STAGED}, {_NAME_SQL}, {_TYPE_SQL}, {_dates_sql()}, best AS (SELECT doc_id, iso, evidence, confidence FROM dt QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, NOT named, iso) = 1),
x AS (SELECT n5.*, best.iso, {_INSURER_SQL} AS ins, {_DOCTYPE_SQL} AS dtp, coalesce(best.confidence, 'unknown') AS date_confidence FROM n5 LEFT JOIN best USING (doc_id)),
y AS (SELECT *, CASE WHEN ins LIKE '|%' THEN 'insurer_not_inferred' WHEN dtp LIKE '|%' THEN 'document_type_not_inferred' WHEN product_type = '' THEN 'product_type_not_inferred' WHEN iso IS NULL THEN 'effective_date_not_inferred' ELSE '' END AS reason FROM x)
SELECT doc_id, reason, CASE WHEN reason = '' THEN split_part(ins, '|', 1) || '_' || product_type || '_' || regexp_replace(split_part(slug, '|', 1), '[^a-z0-9]+', '_', 'g') || '_policy_terms_' || replace(iso, '-', '') || '_' || substr(content_hash, 1, 8) END AS document_id,
  CASE WHEN reason = '' THEN 'rule_extract_needs_review:' || array_to_string(list_sort(list_filter(['dataset_split', 'language', CASE WHEN split_part(dtp, '|', 2) <> 'high' THEN 'document_type' END, CASE WHEN split_part(ins, '|', 2) <> 'high' THEN 'insurer' END, CASE WHEN date_confidence <> 'high' THEN 'effective_date' END,
  CASE WHEN name_how NOT LIKE 'high%' THEN 'product_name' END, CASE WHEN slug NOT LIKE '%slug:keyword%' THEN 'product_slug' END, CASE WHEN primary_type IS NULL OR product_name = '' THEN 'product_type' END], lambda z: z IS NOT NULL)), ',') END AS notes FROM y"""
)
def q_staging_entries(spark, sf_dir):
    out = staging.entries(staged(spark, sf_dir), keep=("doc_id",))
    return out.select("doc_id", "reason", F.col("entry_document_id").alias("document_id"), F.col("entry_notes").alias("notes"))


#: Over d (doc_id): fields of chunk rows as JSON may hold them, some of them wrong.
_FAULTY = {
    "document_id": "CASE WHEN d % 13 <> 0 THEN 'doc_' || d END",
    "section_type": "CASE d % 11 WHEN 0 THEN 'nonsense' WHEN 1 THEN ' part ' ELSE 'article' END",
    "chunk_index": "CASE d % 7 WHEN 0 THEN '2.0' WHEN 1 THEN '2.5' WHEN 2 THEN '-1' WHEN 3 THEN 'abc' WHEN 4 THEN '007' ELSE '' || d END",
    "page_start": "'' || (d % 5 - 1)",
    "char_count": "CASE WHEN d % 17 <> 0 THEN '' || length(text) END",
}
_PLAIN = ("chunk_id", "section_id", "section_title", "text", "chunking_strategy")
_COUNTS = ("page_end", "char_start", "char_end", "token_estimate", "source_section_char_start", "source_section_char_end")


@query(
    f"""WITH f AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in _FAULTY.items())} FROM (SELECT doc_id, doc_id AS d, coalesce(text, '') AS text FROM documents))
SELECT doc_id, concat_ws(',', CASE WHEN document_id IS NULL THEN 'document_id:missing' END, CASE WHEN char_count IS NULL THEN 'char_count:missing' END,
  CASE WHEN try_cast(chunk_index AS DOUBLE) IS NULL OR try_cast(chunk_index AS DOUBLE) <> floor(try_cast(chunk_index AS DOUBLE)) THEN 'chunk_index:not_an_integer' WHEN chunk_index::DOUBLE < 0 THEN 'chunk_index:below_0' END,
  CASE WHEN page_start::INT < 1 THEN 'page_start:below_1' END, CASE WHEN section_type = 'nonsense' THEN 'section_type:not_one_of' END) AS violations FROM f"""
)
def q_artifact_violations(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id d", "coalesce(text, '') text").selectExpr("doc_id", *[f"{v} {k}" for k, v in _FAULTY.items()], *[f"'x' {c}" for c in _PLAIN], *[f"'1' {c}" for c in _COUNTS])
    return validation.validated(rows, "chunks").select("doc_id", F.array_join("violations", ",").alias("violations"))


@query(O.after("t0 AS (SELECT document_id, page_number, replace(text, chr(12), ' ') AS t FROM pg)") + "SELECT document_id, page_number, length(t) AS char_count, sha256(t) AS text_hash, sha256(string_agg(t, chr(12)) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS file_hash FROM t0")
def q_paged_files(spark, sf_dir):
    """A file of pages for each document, written and read again by ranges of bytes that are shorter than most of them."""
    pages = pages_of(spark, sf_dir).withColumn("text", F.translate("text", "\f", " "))
    whole = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    folder = shared_path(spark, "paged-files")
    write_files(whole.select(F.concat("document_id", F.lit(".txt")).alias("name"), F.array_join(F.transform("p", lambda x: x["text"]), "\f").alias("body")), folder)
    found = paged.with_digests(paged.listed(spark, folder, "*.txt"))
    back = paged.pages(found, size=1024, keep=("filename", "content_hash"))
    return back.select(F.regexp_replace("filename", "\\.txt$", "").alias("document_id"), F.col("page_number").cast("long").alias("page_number"), F.col("char_count").cast("long").alias("char_count"), F.sha2("text", 256).alias("text_hash"), F.col("content_hash").alias("file_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash, CASE WHEN doc_id % 10 = 3 THEN 'missing_file' WHEN doc_id % 10 = 7 THEN 'hash_mismatch' END AS problem FROM documents")
def q_hash_verify(spark, sf_dir):
    from evidex.sources.readers import verified

    docs = read(spark, sf_dir, "documents").selectExpr("doc_id", "concat('/in/', doc_id, '.pdf') path", "sha2(text, 256) content_hash")
    listed = docs.selectExpr("doc_id", "path", "case when doc_id % 10 = 7 then sha2('other', 256) else upper(content_hash) end content_hash")
    found = docs.where("doc_id % 10 <> 3").select("path", "content_hash")
    out = verified(listed, found).join(docs.selectExpr("doc_id", "content_hash own"), "doc_id")
    return out.select("doc_id", F.col("own").alias("content_hash"), "problem")
