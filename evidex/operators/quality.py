"""Ingestion quality: per document, over the corpus, and the pages that look suspicious."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import document_preview, strip

LOW = 50


def document_quality(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per row of documents (document_id): page counts and lengths, empty and low pages, the first page that isn't blank.

    A document without pages has zeros and nulls. low_pages counts pages under 50 characters, empty ones included.
    """
    filled = strip("text") != ""
    n = F.col("char_count")
    per = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum(n).alias("total_chars"),
        F.min(n).alias("min_chars"),
        F.max(n).alias("max_chars"),
        F.count_if(n == 0).alias("empty_pages"),
        F.count_if(n < LOW).alias("low_pages"),
        F.min(F.when(filled, F.struct("page_number", document_preview("text").alias("preview")))).alias("first"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = documents.select("document_id").join(per, "document_id", "left")
    average = F.coalesce(F.col("total_chars") / F.col("page_count"), F.lit(0.0))
    return out.select("document_id", zero("page_count"), zero("total_chars"), average.alias("avg_chars"), F.col("min_chars").cast("long"), F.col("max_chars").cast("long"), zero("empty_pages"), zero("low_pages"), F.col("first.page_number").alias("first_page"), F.col("first.preview").alias("first_preview"))


def corpus_quality(per_document: DataFrame) -> DataFrame:
    return per_document.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"),
        F.coalesce(F.sum("total_chars"), F.lit(0)).alias("chars"),
        F.count_if(F.col("empty_pages") > 0).alias("documents_with_empty"),
        F.count_if(F.col("low_pages") > 0).alias("documents_with_low"),
    )


def suspicious_pages(pages: DataFrame) -> DataFrame:
    """document_id, page_number, char_count, reason of pages under 50 characters."""
    n = F.col("char_count")
    return pages.where(n < LOW).select("document_id", "page_number", n.cast("long").alias("char_count"), F.when(n == 0, "empty").otherwise("low_text").alias("reason"))
