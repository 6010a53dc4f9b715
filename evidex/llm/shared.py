"""What several training-data operators use: the shared folder, tables written there, and graph components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset: a folder of our own in local mode, else RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs nothing made before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_one_task(bounded: DataFrame, make: Callable[[list[tuple]], object]):
    """make(rows) over a bounded table, sorted, in one task of the cluster; what it makes comes back, so it must be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(rows))], pa.binary())], ["made"])

    found = bounded.coalesce(1).mapInArrow(run, "made binary").first()
    return pickle.loads(found["made"]) if found else make([])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id, n: int):
    """crc32 of the id's text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Of edges (a, b), both long and not null: (node, root) for every node of an edge, root being the smallest node reachable.

    Alternating large-star and small-star steps on a distributed edge list; each step is a partial-aggregated minimum and an
    equi-join, whose skewed keys AQE splits. Every round ends in a table in the shared folder. No edges: no rows.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        moved = joined.where("b > a") if large else joined.where("b <> m")
        out = moved.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        if not large:
            out = out.unionByName(least.where("a <> m").select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def stamp(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = stamp(current)
    while before[0]:
        current = written(star(star(current, True), False), name)
        now = stamp(current)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
