"""Retrieval evaluation: did a query's hits meet its expectations within ranks 1, 3 and 5?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import compact, single_spaced


def title_met(title: Column | str, expected: Column | str) -> Column:
    """Any expected title equals the title, after runs of white space are one or none; no expectation is not met."""
    t = F.col(title) if isinstance(title, str) else title
    return F.exists(F.coalesce(F.col(expected) if isinstance(expected, str) else expected, F.array().cast("array<string>")), lambda e: (single_spaced(e) == single_spaced(t)) | (compact(e) == compact(t)))


def expectation_met(title: str, kind: str, titles: str, types: str) -> Column:
    """Titles and types where both are expected, else those that are."""
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    of_type = F.coalesce(F.array_contains(F.col(types), F.col(kind)), F.lit(False))
    return F.when(has(titles) & has(types), title_met(title, titles) & of_type).when(has(titles), title_met(title, titles)).otherwise(of_type)


def evaluate(hits: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per spec (id, expected_titles, expected_types, filters): pass_at_1, 3, 5, all_filters_matched, titles and types by rank, note.

    hits: query_id, rank, section_title, section_type, filters_matched.
    """
    joined = specs.join(hits, F.col("id") == F.col("query_id"), "left")
    met = F.coalesce(F.col("rank").isNotNull() & expectation_met("section_title", "section_type", "expected_titles", "expected_types"), F.lit(False))
    at = lambda k: F.coalesce(F.bool_or(met & (F.col("rank") <= k)), F.lit(False)).alias(f"pass_at_{k}")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", c)))), lambda x: x[c])
    out = joined.groupBy("id").agg(at(1), at(3), at(5), F.coalesce(F.bool_and("filters_matched"), F.lit(True)).alias("all_filters_matched"), listed("section_title").alias("top_titles"), listed("section_type").alias("top_types"), F.first("expected_titles").alias("et"), F.first("expected_types").alias("ey"))
    note = (
        F.when(F.col("pass_at_1"), "expected matched within rank 1")
        .when(F.col("pass_at_3"), "expected matched within rank 3 (not rank 1)")
        .when(F.col("pass_at_5"), "expected matched within rank 5 (not rank 3)")
        .otherwise(F.concat(F.lit("no expected section title/type found in top results; expected titles="), F.coalesce(F.to_json("et"), F.lit("[]")), F.lit(" types="), F.coalesce(F.to_json("ey"), F.lit("null"))))
    )
    return out.withColumn("note", note).drop("et", "ey")


def summary(per_query: DataFrame) -> DataFrame:
    """One row: total_queries, hit_at_1, hit_at_3, hit_at_5 (0 without queries)."""
    rate = lambda k: F.coalesce(F.avg(F.col(f"pass_at_{k}").cast("double")), F.lit(0.0)).alias(f"hit_at_{k}")
    return per_query.agg(F.count(F.lit(1)).alias("total_queries"), rate(1), rate(3), rate(5))
