"""Sections cut into overlapping chunks at line breaks, and what there is to report about chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.functions.text import strip

STRATEGY = "section_aware_paragraph_v1"


@dataclass(frozen=True)
class ChunkingConfig:
    """compat: with no overlap, step by one character as older output does; else such chunks are contiguous."""

    max_chars: int = 2200
    overlap_chars: int = 250
    strategy: str = STRATEGY
    compat: bool = False

    def __post_init__(self):
        if not 1 <= self.max_chars <= 200_000:
            raise ValueError("max_chars must be in 1 to 200000")
        if not 0 <= self.overlap_chars <= 50_000:
            raise ValueError("overlap_chars must be in 0 to 50000")


def span_bounds(text: str, config: ChunkingConfig) -> list[tuple[int, int]]:
    """Start and end of every chunk: greedy, ending after the last blank line that fits, else after the last line break, else full."""
    n, width = len(text), config.max_chars
    if n <= width:
        return [(0, n)] if n else []
    spans, start = [], 0
    title = text.find("\n") + 1
    while start + width < n:
        reach = start + width
        floor = title if start == 0 and 0 < title < n and title <= reach else start + 1
        # a break ends at e when it begins at e - len(break), so the search runs over such beginnings
        paragraph = text.rfind("\n\n", max(floor - 2, 0), reach)
        line = text.rfind("\n", floor - 1, reach)
        end = paragraph + 2 if paragraph >= 0 else line + 1 if line >= 0 else reach
        spans.append((start, end))
        if not config.overlap_chars and not config.compat:
            start = end
            continue
        back = end - start - 1
        if back <= 0:
            start = min(start + 1, n - 1)
            continue
        following = max(start + 1, end - min(config.overlap_chars, back))
        if text[following - 1] != "\n":
            stop = text.find("\n", following, end)
            if stop >= 0 and stop + 1 < end:
                following = stop + 1
        start = min(start + 1 if following >= end else following, n - 1)
    spans.append((start, n))
    return spans


def spans(texts: DataFrame, config: ChunkingConfig = ChunkingConfig(), text: str = "text") -> DataFrame:
    """All columns of texts, and chunk_index, span_start, span_end of each chunk of column `text`."""

    @F.pandas_udf("array<struct<a: int, b: int>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: [{"a": a, "b": b} for a, b in span_bounds(t or "", config)])

    exploded = texts.select("*", F.posexplode(cut(F.col(text))).alias("chunk_index", "_s"))
    return exploded.withColumns({"span_start": F.col("_s.a"), "span_end": F.col("_s.b")}).drop("_s")


def chunks(sections: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks of sections (schema in README): offsets within the document and the section, id, counts; empty sections have none. Sections are numbered in the order they stand in."""
    order = W.partitionBy("document_id").orderBy("start_char_offset", "end_char_offset", "section_id")
    placed = sections.withColumn("position", F.row_number().over(order) - 1)
    cut = spans(placed, config)
    size = F.col("span_end") - F.col("span_start")
    return cut.select(
        "document_id",
        F.format_string("%s::chunk::%04d::%03d", "document_id", "position", "chunk_index").alias("chunk_id"),
        "section_id",
        "section_type",
        F.col("title").alias("section_title"),
        "parent_section_id",
        "policy_unit_id",
        "policy_unit_name",
        "variant_name",
        "chunk_index",
        strip(F.substring(F.col("text"), F.col("span_start") + 1, size)).alias("text"),
        F.col("start_page").alias("page_start"),
        F.col("end_page").alias("page_end"),
        (F.col("start_char_offset") + F.col("span_start")).alias("char_start"),
        (F.col("start_char_offset") + F.col("span_end")).alias("char_end"),
        size.alias("char_count"),
        F.floor((size + 3) / 4).cast("int").alias("token_estimate"),
        F.lit(config.strategy).alias("chunking_strategy"),
        F.col("span_start").alias("source_section_char_start"),
        F.col("span_end").alias("source_section_char_end"),
    )


def run_summary(documents: DataFrame, chunked: DataFrame) -> DataFrame:
    """Long form (kind, key, n): per document (those without chunks too), per section type, per variant."""
    per = documents.select("document_id").join(chunked.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id", "left")
    out = per.select(F.lit("document").alias("kind"), F.col("document_id").alias("key"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    for kind, key in (("section_type", F.col("section_type")), ("variant", F.coalesce("variant_name", F.lit("<null>")))):
        out = out.unionByName(chunked.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n"))
    return out


def run_totals(documents: DataFrame, chunked: DataFrame) -> DataFrame:
    """One row: documents_processed (those without chunks too), total_chunks, average_chars and max_chars of a chunk (0 without chunks)."""
    size = F.col("char_count")
    totals = chunked.agg(F.count(F.lit(1)).alias("total_chunks"), F.coalesce(F.avg(size), F.lit(0.0)).alias("average_chars"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("max_chars"))
    return documents.agg(F.count_distinct("document_id").alias("documents_processed")).crossJoin(totals)


def inspection(chunked: DataFrame, max_chars: int = 2200, limits: DataFrame | None = None) -> DataFrame:
    """One row of counts over all chunks, with what is odd about them. limits: document_id, max_chars of the documents that have a limit of their own."""
    if limits is None:
        chunked = chunked.withColumn("_most", F.lit(max_chars))
    else:
        own = limits.groupBy("document_id").agg(F.last("max_chars", ignorenulls=True).alias("_own"))
        chunked = chunked.join(own, "document_id", "left").withColumn("_most", F.coalesce("_own", F.lit(max_chars)))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    blank = lambda c: F.col(c).isNull() | (strip(c) == "")
    size = F.col("char_count")
    return chunked.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_distinct("document_id").alias("documents"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("chars"),
        F.min(size).cast("long").alias("least"),
        F.max(size).cast("long").alias("most"),
        n(size > F.col("_most")).alias("over_max"),
        n(F.col("variant_name").isNull()).alias("null_variant"),
        n(blank("section_id")).alias("blank_section_id"),
        n(F.col("variant_name").isNotNull() & F.col("policy_unit_id").isNull()).alias("variant_without_unit"),
        n(F.col("chunk_index") > 0).alias("later_chunks"),
        n(blank("section_type")).alias("missing_type"),
        n(blank("text")).alias("missing_text"),
        n(F.col("chunk_index") < 0).alias("negative_index"),
        n(F.length("text") != size).alias("length_mismatches"),
        (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("duplicate_ids"),
    )


def inspection_groups(chunked: DataFrame) -> DataFrame:
    """(kind, key, n) by document, section type, variant and strategy, in one pass."""
    keyed = chunked.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("document", F.col("document_id")), ("section_type", F.col("section_type")), ("variant", F.coalesce("variant_name", F.lit("<null>"))), ("strategy", F.col("chunking_strategy")))])).alias("g"))
    return keyed.groupBy("g.kind", "g.key").agg(F.count(F.lit(1)).alias("n"))


def largest(chunked: DataFrame, n: int = 20) -> DataFrame:
    return chunked.orderBy(F.desc("char_count"), "document_id", "chunk_id").limit(n).select("document_id", "chunk_id", "section_type", "char_count")
