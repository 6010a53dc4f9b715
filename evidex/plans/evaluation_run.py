"""A query file evaluated against an index: every query embedded, searched and judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.embedders import Embedder
from evidex.functions.text import casefold
from evidex.operators import evaluation, search
from evidex.plans.service import query_text
from evidex.sources.readers import retrieval_queries
from evidex.sources.tables import stored
from evidex.sources.writers import read_index


def evaluate(spark: SparkSession, folder: str, queries: str, embedder: Embedder) -> DataFrame:
    """What became of each query of a YAML file (evaluation.evaluate). An index of another model: ValueError.

    A query file is a list that people keep, so its queries are embedded one by one.
    """
    index, config = read_index(spark, folder)
    if embedder.model_name != config["model_name"]:
        raise ValueError(f"embedder model {embedder.model_name!r} does not match index config model {config['model_name']!r}")
    asked = retrieval_queries(spark, queries)
    vectors = [(r["id"], [float(v) for v in embedder.query(query_text(spark, r["query"]))]) for r in asked.select("id", "query").collect()]
    specs = asked.join(spark.createDataFrame(vectors, "id string, vector array<double>"), "id")
    hits = search.search_many(index, specs)
    wanted = specs.select(F.col("id").alias("query_id"), *[casefold(c).alias(f"_{c}") for c in ("insurer", "product_type", "variant_name")])
    same = lambda c: F.col(f"_{c}").isNull() | F.coalesce(casefold(c) == F.col(f"_{c}"), F.lit(False))
    variant = F.col("_variant_name").isNull() | F.coalesce(F.contains(casefold("variant_name"), F.col("_variant_name")), F.lit(False))
    judged = hits.join(wanted, "query_id").withColumn("filters_matched", search.SearchFilters().predicate() & same("insurer") & same("product_type") & variant)
    return stored(evaluation.evaluate(judged, specs), "evaluated")
