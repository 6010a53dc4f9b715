"""What a document's key says about it, labels for people, and the values that searches can filter by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import strip

# Labels and known product types, the order of the latter included.
INSURER_LABELS = {"kyobolife": "교보생명", "samsunglife": "삼성생명", "miraeassetlife": "미래에셋생명"}
TYPE_LABELS = {"annuity": "연금보험", "variable_annuity": "변액연금보험", "cancer": "암보험", "whole_life": "종신보험"}
PRODUCT_TYPES = ["variable_annuity", "whole_life", "annuity", "cancer"]
KEY = r"^(.+)_policy_terms_(\d{8})_([a-f0-9]{8})$"


def parsed(document_id: Column | str) -> Column:
    """struct(insurer, product_type, product_slug, product_name, effective_date, content_hash) of a key, or null."""
    key = strip(document_id)
    left = F.regexp_extract(key, KEY, 1)
    insurer = F.substring_index(left, "_", 1)
    rest = F.substr(left, F.length(insurer) + 2)
    kind = F.substring_index(rest, "_", 1)
    for t in reversed(PRODUCT_TYPES):
        kind = F.when((rest == t) | F.startswith(rest, F.lit(t + "_")), F.lit(t)).otherwise(kind)
    slug = F.substr(rest, F.length(kind) + 2)
    fields = (insurer.alias("insurer"), kind.alias("product_type"), slug.alias("product_slug"), F.replace(slug, F.lit("_"), F.lit(" ")).alias("product_name"), F.regexp_extract(key, KEY, 2).alias("effective_date"), F.regexp_extract(key, KEY, 3).alias("content_hash"))
    # a type that is the whole rest leaves no slug
    return F.when(key.rlike(KEY) & F.contains(left, F.lit("_")) & (rest != kind) & F.contains(rest, F.lit("_")), F.struct(*fields))


def label(value: Column | str, labels: dict[str, str]) -> Column:
    """The label of a value, the value itself if it has none; null for null and empty ones."""
    c = F.col(value) if isinstance(value, str) else value
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.when(c != "", F.coalesce(F.try_element_at(known, c), c))


def enriched(rows: DataFrame) -> DataFrame:
    """rows (document_id and perhaps insurer, product_type, product_name) with those filled where null, and their labels anew."""
    out = rows.withColumn("_k", parsed("document_id"))
    for c in ("insurer", "product_type", "product_name"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_k.{c}")) if c in rows.columns else F.col(f"_k.{c}"))
    labels = {"insurer_display_name": label("insurer", INSURER_LABELS), "product_type_display_name": label("product_type", TYPE_LABELS), "product_display_name": label("product_name", {"": ""})}
    return out.withColumns(labels).drop("_k")


def filter_options(index: DataFrame) -> DataFrame:
    """(dimension, value, label): the distinct values, neither null nor empty, of the five dimensions of enriched rows."""
    dims = {"insurers": "insurer", "product_types": "product_type", "product_names": "product_name", "variant_names": "variant_name", "policy_unit_names": "policy_unit_name"}
    rows = index.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(c).alias("value")) for k, c in dims.items()])).alias("o")).select("o.*")
    rows = rows.where("value is not null and value <> ''").distinct()
    of = F.when(F.col("dimension") == "insurers", label("value", INSURER_LABELS)).when(F.col("dimension") == "product_types", label("value", TYPE_LABELS)).otherwise(F.col("value"))
    return rows.withColumn("label", of)
