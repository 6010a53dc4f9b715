"""A corpus of policy documents derived from the table `documents`, one for each row, so that every operator has real volume.

A row's lines become pages of six lines, and lines at fixed places become headings, table rows, law headings or markers, by
page kind (page number + doc_id) mod 5. The expressions are plain SQL that both Spark and DuckDB take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 6

#: Over i (line), p (page from 0), j (line of the page), k (page kind), d (doc_id), raw (the line).
LINE = """CASE
 WHEN k = 0 AND j = 0 THEN '  목 차 '
 WHEN k = 0 AND j = 1 THEN '제' || p || '조 (목적) ........ ' || i
 WHEN k = 0 AND j = 2 THEN '제' || (p + 1) || '관 일반사항'
 WHEN k = 0 AND j = 3 THEN '. ' || i
 WHEN k = 0 AND j = 4 THEN '별표 ' || (p + 1) || ' 지급기준표 ..... ' || i || 'p'
 WHEN k = 1 AND j = 0 THEN '제 ' || (p + 1) || ' 관  계약의 성립'
 WHEN k = 1 AND j = 1 THEN '제' || (p + 1) || '조 (보험계약의  성립)'
 WHEN k = 1 AND j = 3 THEN '  제' || (p + 2) || '조(용어의 정의)'
 WHEN k = 2 AND j = 0 THEN '( 별표 ' || (p + 1) || ' ) 보험금 지급기준표'
 WHEN k = 2 AND j = 2 THEN '제' || (p + 1) || '조(보험금)'
 WHEN k = 2 AND j = 3 THEN '제' || (p + 1) || '조제1항에 관한 표'
 WHEN k = 2 AND j = 4 THEN '제' || (p + 1) || '조 ( 보험금 )에 따른 사항'
 WHEN k = 3 AND j = 0 THEN CASE WHEN d % 3 = 0 THEN '관련 법규' WHEN d % 3 = 1 THEN '약관에서 인용된 법령' ELSE '관련법규 ' || i || 'p' END
 WHEN k = 3 AND j = 1 THEN '「민법」 제' || (p + 1) || '조 ' || raw
 WHEN k = 3 AND j = 3 THEN '보험용어 해설'
 WHEN k = 4 AND j = 0 THEN '무배당 연금보험(' || CASE WHEN p % 2 = 0 THEN '적립형' ELSE '거치형' END || ') ' || CASE WHEN d % 2 = 0 THEN '약관' ELSE '' END
 WHEN k = 4 AND j = 1 THEN CASE WHEN d % 2 = 0 THEN '보험약관 주요내용' ELSE '약 관' END
 WHEN k = 4 AND j = 2 THEN '고객권리안내문'
 WHEN k = 4 AND j = 3 THEN '제' || (p + 1) || '조 (회사의 의무)'
 WHEN k = 4 AND j = 4 THEN '회사는 ' || raw
 ELSE raw END"""

INSURER = "CASE d % 4 WHEN 0 THEN 'kyobolife' WHEN 1 THEN 'samsunglife' WHEN 2 THEN 'miraeassetlife' ELSE 'otherlife' END"
TYPE = "CASE d % 5 WHEN 0 THEN 'annuity' WHEN 1 THEN 'variable_annuity' WHEN 2 THEN 'cancer' WHEN 3 THEN 'whole_life' ELSE 'dental' END"
DATE = "'202' || (d % 7) || '-0' || (1 + d % 9) || '-' || (10 + d % 18)"


def document_key(digest: str) -> str:
    return f"{INSURER} || '_' || {TYPE} || '_plan_' || d || '_policy_terms_' || replace({DATE}, '-', '') || '_' || substr({digest}, 1, 8)"


def policy_lines(documents: DataFrame) -> DataFrame:
    """document_id, page_number, i, line."""
    keyed = documents.where("doc_id is not null").selectExpr("doc_id d", "coalesce(text, '') text").selectExpr("d", f"{document_key('sha2(text, 256)')} document_id", "posexplode(split(text, '\\n')) as (i, raw)")
    placed = keyed.selectExpr("document_id", "d", "i", f"i div {PAGE} p", f"i % {PAGE} j", f"(i div {PAGE} + d) % 5 k", "raw")
    return placed.selectExpr("document_id", "cast(p + 1 as int) page_number", "i", f"{LINE} line")


def policy_pages(documents: DataFrame) -> DataFrame:
    """document_id, page_number, text, char_count, extraction_method: the page rows of the derived corpus."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    pages = policy_lines(documents).groupBy("document_id", "page_number").agg(joined.alias("text"))
    return pages.select("document_id", "page_number", "text", F.length("text").alias("char_count"), F.lit("derived").alias("extraction_method"))


def policy_documents(documents: DataFrame) -> DataFrame:
    """document_id and the metadata of the derived corpus."""
    d = documents.where("doc_id is not null").selectExpr("doc_id d", "coalesce(text, '') text")
    return d.selectExpr("d doc_id", f"{document_key('sha2(text, 256)')} document_id", f"{INSURER} insurer", f"{TYPE} product_type", f"{DATE} effective_date", "sha2(text, 256) content_hash")


#: The same tables in DuckDB: l (document_id, page_number, i, line) and pg (document_id, page_number, text).
SQL = f"""
k0 AS (SELECT doc_id AS d, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
k1 AS (SELECT d, {document_key("sha256(text)")} AS document_id, string_split(text, chr(10)) AS ls FROM k0),
k2 AS (SELECT d, document_id, unnest(range(len(ls))) AS i, unnest(ls) AS raw FROM k1),
k3 AS (SELECT d, document_id, i, i // {PAGE} AS p, i % {PAGE} AS j, (i // {PAGE} + d) % 5 AS k, raw FROM k2),
l AS (SELECT document_id, p + 1 AS page_number, i, {LINE} AS line FROM k3),
pg AS (SELECT document_id, page_number, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY 1, 2)
"""
