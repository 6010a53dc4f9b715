"""Sources: manifests, query files, pages of staged files, JSON artifacts and index folders. Bytes and texts are read by Spark."""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.sources.checked import documents_of, rows_of
from evidex.sources.folders import exists, settle
from evidex.sources.paged import listed

MANIFEST = "document_id string, insurer string, product_name string, product_type string, product_slug string, document_type string, effective_date string, source_file string, original_filename string, source_url string, content_hash string, collection_method string, dataset_split string, language string, tags array<string>, notes string"
PAGE = "document_id string, page_number int, text string, char_count int, extraction_method string"
SECTION = "document_id string, section_id string, section_type string, title string, start_page int, end_page int, start_char_offset bigint, end_char_offset bigint, parent_section_id string, text string, assembly_confidence double, assembly_evidence array<string>, policy_unit_id string, policy_unit_name string, variant_name string"
CHUNK = "document_id string, chunk_id string, section_id string, section_type string, section_title string, parent_section_id string, policy_unit_id string, policy_unit_name string, variant_name string, chunk_index int, text string, page_start int, page_end int, char_start bigint, char_end bigint, char_count int, token_estimate int, chunking_strategy string, source_section_char_start int, source_section_char_end int"


def _mapping(path: str, what: str) -> dict:
    with open(path, encoding="utf-8") as f:
        root = yaml.safe_load(f)
    if root is None:
        return {}
    if not isinstance(root, dict):
        raise ValueError(f"{what} root must be a mapping")
    return root


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a YAML manifest; keys not known are passed over. A manifest is a small file that people keep."""
    rows = _mapping(path, "manifest").get("documents") or []
    if not isinstance(rows, list):
        raise ValueError("manifest documents must be a list")
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    defaults = {"source_url": "", "notes": "", "tags": []}
    clean = lambda v: v.strip() if isinstance(v, str) else v if v is None or isinstance(v, list) else str(v)
    return spark.createDataFrame([tuple(clean(r.get(n, defaults.get(n))) for n in names) for r in rows], MANIFEST)


def resolved(source_file: str, root: str) -> str:
    if os.path.isabs(source_file):
        raise ValueError("source_file must be relative")
    return os.path.normpath(os.path.join(root, source_file))


def source_path(source: str, root: str) -> str:
    """Where a file to stage is: an absolute path (or one from the user's home) as it is, else below root."""
    return os.path.realpath(os.path.join(root, os.path.expanduser(source)))


def retrieval_queries(spark: SparkSession, path: str) -> DataFrame:
    """id, query, insurer, product_type, variant_name, expected_titles, expected_types, top_k, dedupe_section."""
    try:
        rows = _mapping(path, "queries").get("queries") or []
        out = []
        for r in rows:
            titles, types, k, f = r.get("expected_any_section_titles") or [], r.get("expected_any_section_types"), r.get("top_k", 5), r.get("filters") or {}
            if not (titles or types) or not 1 <= k <= 50 or not str(r["query"]).strip():
                raise ValueError(f"query {r.get('id')} is not valid")
            out.append((r["id"], r["query"].strip(), f.get("insurer"), f.get("product_type"), f.get("variant_name"), titles, types, k, r.get("dedupe_section", True)))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"invalid retrieval queries YAML {path}: {e}") from e
    return spark.createDataFrame(out, "id string, query string, insurer string, product_type string, variant_name string, expected_titles array<string>, expected_types array<string>, top_k int, dedupe_section boolean")


def form_feed_pages(content: bytes) -> list[str]:
    """The built-in extractor: UTF-8 text whose pages are parted by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def pdf_pages(content: bytes) -> list[str]:
    """The texts of a PDF's pages; where PyMuPDF or pypdf is installed."""
    try:
        import pymupdf
    except ModuleNotFoundError:
        import pypdf

        return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
    with pymupdf.open(stream=content, filetype="pdf") as document:
        return [p.get_text() for p in document]


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, filename, content, content_hash of the files of a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.sha2("content", 256).alias("content_hash"))


def pages(found: DataFrame, extract: Callable[[bytes], list[str]] = form_feed_pages, method: str = "form_feed", key: str = "path") -> DataFrame:
    """A row per page of files (key, content). extract: a file's bytes to its pages' texts, run where the file is read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, i, t, len(t), method) for k, c in zip(part[key], part["content"]) for i, t in enumerate(extract(c), 1)]
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "text", "char_count", "extraction_method"])

    return found.select(key, "content").mapInPandas(run, PAGE)


def head_texts(found: DataFrame, paged: DataFrame, most: int = 5) -> DataFrame:
    """found with head_text: its first pages, joined by line breaks."""
    heads = paged.where(F.col("page_number") <= most).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n").alias("head_text"))
    # sizes of pages read by tasks aren't known beforehand, so texts are never broadcast
    return found.join(heads.hint("merge"), found["path"] == heads["document_id"], "left").drop("document_id").withColumn("head_text", F.coalesce("head_text", F.lit("")))


def verified(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest rows (path, content_hash) with `problem`: missing_file, hash_mismatch, or null."""
    have = found.select("path", F.col("content_hash").alias("found_hash"))
    wanted = F.lower(F.trim("content_hash"))
    problem = F.when(F.col("found_hash").isNull(), "missing_file").when(wanted != F.col("found_hash"), "hash_mismatch")
    return listed.join(have, "path", "left").withColumn("problem", problem)


def require_verified(checked: DataFrame) -> DataFrame:
    """Rows of `verified`, or an error for the first by path that has a problem: FileNotFoundError or ValueError."""
    first = checked.where("problem is not null").orderBy("path").select("path", "problem").first()
    if first:
        raise (FileNotFoundError if first["problem"] == "missing_file" else ValueError)(f"{first['problem']}: {first['path']}")
    return checked


def artifacts(spark: SparkSession, folder: str, kind: str, required: bool = False, quarantine: str | None = None) -> DataFrame:
    """Rows of the `sections` or `chunks` of a folder's *.{kind}.json files, one artifact a file.

    A folder that isn't there has no rows; with `required` it is a FileNotFoundError, and one without such files a ValueError.
    A file that is no JSON, or has a row that breaks a rule of its model, is an InvalidArtifacts (a ValueError); with
    `quarantine`, a folder, what is wrong is written there and the other files' rows are returned.
    """
    schema = {"sections": SECTION, "chunks": CHUNK}[kind]
    if not exists(spark, folder):
        if required:
            raise FileNotFoundError(f"{kind} folder not found: {folder}")
        return spark.createDataFrame([], schema)
    if required and listed(spark, folder, f"*.{kind}.json").isEmpty():
        raise ValueError(f"no *.{kind}.json files in {folder}")
    return rows_of(spark, folder, kind, schema, quarantine)


def _artifact_files(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"*.{kind}.json").json(folder)


def chunk_limits(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, max_chars of the *.chunks.json files of a folder; of several files of a document the last by name counts."""
    settle(spark, folder)
    raw = _artifact_files(spark, folder, "chunks", "document_id string, chunking_config struct<max_chars: int>")
    last = F.max_by("chunking_config.max_chars", F.col("_metadata.file_name"))
    return raw.groupBy("document_id").agg(last.alias("max_chars"))


def documents(spark: SparkSession, folder: str, quarantine: str | None = None) -> DataFrame:
    """document_id, page_count, total_char_count, created_at, pages of a folder's *.json documents, in the order of their paths. No such folder: FileNotFoundError; what isn't valid: as in artifacts."""
    if not exists(spark, folder):
        raise FileNotFoundError(f"documents folder not found: {folder}")
    return documents_of(spark, folder, PAGE, quarantine).orderBy("path").drop("path")


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, length of the *.pdf files of an inbox, in the order of their paths; maybe none. No such folder: FileNotFoundError."""
    if not exists(spark, folder):
        raise FileNotFoundError(f"inbox not found: {folder}")
    return listed(spark, folder).orderBy("path")
