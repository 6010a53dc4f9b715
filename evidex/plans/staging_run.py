"""An inbox staged as a batch: what is inferred of each file and, if asked for, the copies and the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.operators.staging import entries
from evidex.sources import paged
from evidex.sources.folders import copy_files
from evidex.sources.readers import files, form_feed_pages, head_texts, inbox, pages
from evidex.sources.tables import stored
from evidex.sources.writers import write_manifest


def stage(spark: SparkSession, folder: str, root: str, extract: Callable[[bytes], list[str]] = form_feed_pages, apply: bool = False, most_pages: int = 5) -> DataFrame:
    """Entries of a folder's *.pdf files, those that failed too (reason).

    apply: files that passed are copied to data/raw/manual below root, each by the task that reads it, and the manifest
    data/manifests/manual.yaml is replaced. A file that stands there with other bytes is an error. No such folder:
    FileNotFoundError.
    """
    found = inbox(spark, folder)
    # text is read up to its last page wanted; other extractors take a file's bytes whole
    paged_ = paged.pages(found, last=most_pages) if extract is form_feed_pages else pages(files(spark, folder), extract)
    heads = head_texts(paged.with_digests(found), paged_, most_pages)
    out = stored(entries(heads.select("path", "filename", "head_text", "content_hash"), keep=("path",)), "staged")
    if apply:
        named = found.join(out.where("reason = ''").select("path", "entry_document_id"), "path")
        copy_files(named.select(F.concat("entry_document_id", F.lit(".pdf")).alias("name"), "path"), f"{root}/data/raw/manual")
        write_manifest(out, f"{root}/data/manifests/manual.yaml")
    return out
