"""Sinks: artifacts as JSON, an index folder, and manifests. Rows are written by Spark; only small files that people read are written by the driver."""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import yaml
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.functions.embedders import Embedder, with_embedding
from evidex.functions.text import prefixed
from evidex.operators.chunking import ChunkingConfig
from evidex.operators.identity import enriched
from evidex.sources.folders import copy, exists, replace, uri, write_files
from evidex.sources.tables import stored

CONFIG = "index_config.json"


def _named(rows: DataFrame, ending: str, body) -> DataFrame:
    return rows.select(F.concat(F.trim("document_id"), F.lit(ending)).alias("name"), F.to_json(body, {"pretty": "true", "ignoreNullFields": "false"}).alias("body"))


def _checked(rows: DataFrame) -> DataFrame:
    if not rows.where("document_id is null or trim(document_id) = ''").isEmpty():
        raise ValueError("document_id must not be blank")
    return rows


def write_artifacts(rows: DataFrame, folder: str, kind: str, stamp: str | None = None, documents: DataFrame | None = None, config: ChunkingConfig | None = None) -> int:
    """A file `<document_id>.<kind>.json` for each document: its rows as an array named `kind`. Returns the number of files.

    documents: ids of documents that get a file without rows too; config: the chunking that made the rows.
    """
    whole = _checked(rows).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(kind))
    if documents is not None:
        none = F.array().cast(whole.schema[kind].dataType)
        whole = _checked(documents.select("document_id").distinct()).join(whole, "document_id", "left").withColumn(kind, F.coalesce(kind, none))
    fields = [F.col("document_id"), F.lit(stamp or datetime.now(UTC).isoformat()).alias("created_at"), F.col(kind)]
    if config is not None:
        fields.append(F.struct(F.lit(config.max_chars).alias("max_chars"), F.lit(config.overlap_chars).alias("overlap_chars"), F.lit(config.strategy).alias("strategy")).alias("chunking_config"))
    return write_files(_named(whole, f".{kind}.json", F.struct(*fields)), folder)


def write_documents(pages: DataFrame, folder: str, metadata: DataFrame | None = None, stamp: str | None = None) -> int:
    """A file `<document_id>.json` for each document: its metadata (a struct of metadata's columns, by document_id), pages in order and counts."""
    page = F.struct("page_number", "document_id", "text", "char_count", "extraction_method")
    gathered = _checked(pages).groupBy("document_id").agg(F.array_sort(F.collect_list(page)).alias("p"), F.count(F.lit(1)).alias("page_count"), F.sum(F.length("text")).alias("total_char_count"))
    if metadata is not None:
        gathered = gathered.join(metadata.select("document_id", F.struct(*metadata.columns).alias("metadata")), "document_id", "left")
    fields = ["document_id", *["metadata"] * (metadata is not None), F.col("p").alias("pages"), "page_count", "total_char_count", F.lit(stamp or datetime.now(UTC).isoformat()).alias("created_at")]
    return write_files(_named(gathered, ".json", F.struct(*fields)), folder)


def build_index(chunks: DataFrame, folder: str, embedder: Embedder, created_at: str | None = None) -> dict:
    """Writes chunks with metadata and vectors, numbered by (document_id, char_start, char_end, chunk_id), and then the config.

    Rows go to a folder of their own below `versions`; the config, one file that is put in place whole, names it. Until then, and
    if the run ends before, readers see the index of the config before. Earlier versions stay for readers that hold them.
    Numbers come from a range partitioning and the partitions' sizes, so no task sees all rows. No chunks: ValueError.
    """
    if chunks.isEmpty():
        raise ValueError("no chunks to index")
    order = ["document_id", "char_start", "char_end", "chunk_id"]
    sorted_rows = chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    spark, version = chunks.sparkSession, f"versions/{uuid.uuid4().hex}"
    rows = stored(sorted_rows.withColumns({"_part": part, "_in": within}).drop("_at"), "numbering")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = rows.join(before, "_part").withColumn("row_idx", F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")
    embedded = with_embedding(enriched(numbered).withColumn("_passage", prefixed("text", "passage")), embedder, "_passage").drop("_passage")
    embedded.write.parquet(f"{folder}/{version}")
    stats = spark.read.parquet(f"{folder}/{version}").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    config = {"model_name": embedder.model_name, "embedding_dim": stats["d"], "num_chunks": stats["n"], "created_at": created_at or datetime.now(UTC).isoformat().replace("+00:00", "Z"), "backend": "spark_dot", "version": version}
    replace(folder, CONFIG, json.dumps(config, ensure_ascii=False).encode())
    return config


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The index's rows and its config. No config: FileNotFoundError; another number of rows than it says: ValueError."""
    if not exists(spark, f"{folder}/{CONFIG}"):
        raise FileNotFoundError(f"missing index config: {folder}/{CONFIG}")
    config = json.loads(spark.read.text(f"{folder}/{CONFIG}").first()[0])
    rows = spark.read.parquet(f"{folder}/{config.get('version', 'index')}")
    if (n := rows.count()) != config["num_chunks"]:
        raise ValueError(f"index rows ({n}) != num_chunks ({config['num_chunks']})")
    return rows, config


def export_index(index: DataFrame, folder: str) -> None:
    """An index as JSON lines (metadata.jsonl) and float32 matrices (embeddings.npy), both folders of parts in the order of row_idx.

    Part i of either holds the same rows. Nothing passes through the driver.
    """
    placed = index.repartitionByRange("row_idx").sortWithinPartitions("row_idx")
    placed = placed.withColumn("_part", F.spark_partition_id())
    placed.drop("embedding", "_part").write.mode("overwrite").json(f"{folder}/metadata.jsonl")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"_part": [], "row_idx": [], "embedding": []}), *parts])
        if len(held):
            body = io.BytesIO()
            np.save(body, np.stack(held["embedding"].to_list()).astype(np.float32))
            replace(f"{folder}/embeddings.npy", f"part-{int(held['_part'].iloc[0]):05d}-{int(held['row_idx'].iloc[0]):012d}.npy", body.getvalue())
        yield pd.DataFrame({"n": [len(held)]})

    placed.select("_part", "row_idx", "embedding").mapInPandas(run, "n long").agg(F.sum("n")).first()


def import_index(spark: SparkSession, metadata: str, embeddings: str, block: int = 4096) -> DataFrame:
    """The rows of JSON lines (a file or a folder of such) with row_idx and the vectors of float32 matrices (a .npy file or a folder of them, in the order of their names).

    Blank lines are passed over. Row i of the matrices belongs to line i; unequal numbers: ValueError. Tasks read blocks of rows.
    """
    texts = spark.read.text(metadata).where("trim(value) <> ''").select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    texts = stored(texts, "index-lines")
    sizes = texts.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("base", F.sum("n").over(W.orderBy("f", "b")) - F.col("n"))
    # a block of a file is read by one task, in order
    numbered = texts.withColumn("i", F.row_number().over(W.partitionBy("f", "b").orderBy("m")) - 1).join(sizes, ["f", "b"])
    numbered = numbered.select((F.col("base") + F.col("i")).alias("row_idx"), "value")
    shape = spark.read.json(metadata).drop("row_idx").schema
    rows = numbered.select("row_idx", F.from_json("value", shape).alias("r")).select("row_idx", "r.*")

    store, path = fs.FileSystem.from_uri(uri(embeddings))
    info = store.get_file_info(path)
    names = [path] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".npy"))
    blocks, total = [], 0
    for name in names:  # headers only
        with store.open_input_stream(name) as f:
            head = io.BytesIO(f.read(4096))
        version = np.lib.format.read_magic(head)
        (n, dim), fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        if fortran:
            raise ValueError(f"rows of {name} don't follow one another")
        blocks += [(name, head.tell() + i * dim * kind.itemsize, min(block, n - i), dim, kind.str, total + i) for i in range(0, n, block)]
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = fs.FileSystem.from_uri(uri(embeddings))
        for b in batches:
            for name, at, n, dim, kind, first in zip(*(c.to_pylist() for c in b.columns)):
                with own.open_input_file(name) as f:
                    f.seek(at)
                    x = np.frombuffer(f.read(n * dim * np.dtype(kind).itemsize), kind).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x))], ["row_idx", "embedding"])

    dealt = spark.createDataFrame(blocks, "name string, at long, n long, dim long, kind string, first long").repartition(max(1, len(blocks) // 8), "first")
    vectors = dealt.mapInArrow(run, "row_idx long, embedding array<float>")
    if (n := rows.count()) != total:
        raise ValueError(f"metadata rows ({n}) != embedding rows ({total})")
    return rows.join(vectors, "row_idx")


def manifest_yaml(entries: list[dict], stamp: str | None = None) -> str:
    head = {} if stamp is None else {"generated_by": "stage_inbox", "generated_at": stamp}
    return yaml.safe_dump(head | {"documents": entries}, allow_unicode=True, sort_keys=False)


def write_manifest(entries: DataFrame, path: str, stamp: str | None = None) -> int:
    """Replaces the manifest at path (a local file) by the entries that passed (reason ''), and returns how many; they come to the driver a few at a time."""
    fields = [c for c in entries.columns if c.startswith("entry_")]
    rows = entries.where("reason = ''").select(*[F.col(c).alias(c.removeprefix("entry_")) for c in fields]).orderBy("original_filename", "document_id")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(yaml.safe_dump({"generated_by": "stage_inbox", "generated_at": stamp or datetime.now(UTC).isoformat()}, sort_keys=False))
        for r in rows.toLocalIterator():
            f.write(("documents:\n" if not n else "") + yaml.safe_dump([r.asDict() | {"source_url": "", "tags": []}], allow_unicode=True, sort_keys=False))
            n += 1
        f.write("documents: []\n" if not n else "")
    os.replace(f"{path}.part", path)
    return n


def manifest_snippet(entry: dict) -> str:
    """A manifest row to paste: scalars in double quotes, tags as a flow list."""
    one = yaml.dump([entry], Dumper=_Quoting, allow_unicode=True, sort_keys=False, width=1 << 30)
    return "".join(f"  {line}\n" for line in one.splitlines())


class _Quoting(yaml.SafeDumper):
    pass


def _scalar(dumper: yaml.SafeDumper, value: str):
    # keys are plain, values quoted
    return dumper.represent_scalar("tag:yaml.org,2002:str", value, None if isinstance(value, _Key) else '"')


class _Key(str):
    pass


_Quoting.add_representer(str, _scalar)
_Quoting.add_representer(_Key, _scalar)
_Quoting.add_representer(dict, lambda d, m: d.represent_mapping("tag:yaml.org,2002:map", {_Key(k): v if isinstance(v, list) else str(v) for k, v in m.items()}.items(), False))
_Quoting.add_representer(list, lambda d, v: d.represent_sequence("tag:yaml.org,2002:seq", v, not any(isinstance(x, dict) for x in v)))


def stage_file(source: str, destination: str) -> bool:
    """Copies a file unless the destination holds the same bytes already (then False); other bytes there: FileExistsError."""
    return copy(os.path.abspath(source), os.path.abspath(os.path.dirname(destination)), os.path.basename(destination))
