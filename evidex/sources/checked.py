"""JSON artifacts read with validation: files that are no JSON, and rows that break a rule, are told and never passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evidex.operators.validation import MODELS, as_text, typed, violations
from evidex.sources.folders import settle
from evidex.sources.tables import stored


class InvalidArtifacts(ValueError):
    """Files that were not read, with how many rows of all had violations."""


def _nested(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ", 1) for x in schema.split(", ")))


def raw_files(spark: SparkSession, folder: str, ending: str, schema: str) -> DataFrame:
    """A row for each file: its name, path, the fields of the schema, and _corrupt, the text of a file that doesn't parse."""
    settle(spark, folder)
    found = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", f"*{ending}").json(folder)
    return found.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))


def settled(found: DataFrame, quarantine: str | None) -> DataFrame:
    """found (file, position, violations, ...) without the files that have a violation anywhere.

    Counts are taken while the rows are stored, in the same pass. Violations are appended to the Parquet folder `quarantine`
    (file, position, violations); without one they raise InvalidArtifacts.
    """
    seen, bad = Observation("validation"), F.size("violations") > 0
    held = stored(found.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad")), "validated")
    counts = seen.get
    if not counts["bad"]:
        return held.drop("violations")
    wrong = held.where(bad).select("file", "position", "violations")
    if quarantine is None:
        first = wrong.orderBy("file", "position").first()
        raise InvalidArtifacts(f"{counts['bad']} of {counts['rows']} rows are not valid, the first in {first['file']}, row {first['position']}: {', '.join(first['violations'])}")
    wrong.write.mode("append").parquet(quarantine)
    return held.join(wrong.select("file").distinct(), "file", "left_anti").drop("violations")


def rows_of(spark: SparkSession, folder: str, kind: str, schema: str, quarantine: str | None = None) -> DataFrame:
    """The rows of the array `kind` of a folder's *.{kind}.json files, one artifact a file, in the schema's types; see settled."""
    raw = raw_files(spark, folder, f".{kind}.json", f"{kind} array<struct<{_nested(as_text(schema))}>>")
    whole = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("file:not_json"))).when(F.col(kind).isNull(), F.array(F.lit(f"{kind}:missing")))
    each = raw.select("file", whole.alias("_whole"), F.posexplode_outer(kind).alias("position", "_r")).where("_whole is not null or position is not null")
    found = each.select("file", "position", F.coalesce("_whole", violations(F.col("_r"), MODELS[kind])).alias("violations"), typed(F.col("_r"), schema).alias("_t"))
    return settled(found, quarantine).select("_t.*")


def documents_of(spark: SparkSession, folder: str, page_schema: str, quarantine: str | None = None) -> DataFrame:
    """path, document_id, page_count, total_char_count, created_at, pages of a folder's *.json documents; see settled. A violation of a page names it."""
    raw = raw_files(spark, folder, ".json", f"document_id string, page_count string, total_char_count string, created_at string, pages array<struct<{_nested(as_text(page_schema))}>>")
    own = violations(F.struct("document_id", "page_count", "total_char_count"), MODELS["documents"])
    of_pages = F.flatten(F.transform("pages", lambda p, i: F.transform(violations(p, MODELS["pages"]), lambda v: F.concat(F.lit("pages["), i, F.lit("]."), v))))
    said = F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("file:not_json"))).when(F.col("pages").isNull(), F.concat(own, F.array(F.lit("pages:missing")))).otherwise(F.concat(own, of_pages))
    head = typed(F.struct("document_id", "page_count", "total_char_count", "created_at"), "document_id string, page_count int, total_char_count bigint, created_at string")
    found = raw.select("file", "path", F.lit(None).cast("int").alias("position"), said.alias("violations"), head.alias("_t"), F.transform("pages", lambda p: typed(p, page_schema)).alias("pages"))
    return settled(found, quarantine).select("path", "_t.*", "pages")
