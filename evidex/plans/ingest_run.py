"""Manifest to document files: every file found, its digest checked, its pages read and written."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidex.sources import paged
from evidex.sources.readers import manifest, require_verified, resolved, verified
from evidex.sources.writers import write_documents


def ingest(spark: SparkSession, listing: str, root: str, out: str, stamp: str | None = None) -> int:
    """Writes a document file for each row of a manifest and returns their number.

    A file that isn't there is a FileNotFoundError, one with another digest a ValueError; then nothing is written.
    """
    rows = manifest(spark, listing)
    # a manifest is a small file that people keep
    paths = [(r["document_id"], "file:" + resolved(r["source_file"], root)) for r in rows.select("document_id", "source_file").collect()]
    placed = rows.join(spark.createDataFrame(paths, "document_id string, path string"), "document_id")
    found = paged.with_digests(paged.present(placed.select("path").distinct()))
    require_verified(verified(placed, found))
    files = found.join(placed.select("path", F.col("document_id").alias("key")), "path")
    named = paged.pages(files, keep=("key",)).withColumn("document_id", F.col("key")).drop("key")
    return write_documents(named, out, rows.withColumn("content_hash", F.lower(F.trim("content_hash"))), stamp)
