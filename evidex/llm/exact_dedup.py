"""Exact deduplication by a stateful stream, with DataFrame functions alone.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] became one space; null counts as empty. Documents arrive as a
file stream. Keyed state in RocksDB, on the executors' disks with its changelog in the shared folder and without expiry, holds
for each SHA-256 digest the stable identifier (smallest doc_id), the content locator (file and id of that row) and the count;
a restart from the same checkpoint goes on where it stopped, and so does a lost executor's store. Each micro-batch writes the
changed state to a table; its last value for a digest is the smallest id and the largest count.

A hit (a row whose digest has other rows) is settled by full bytes: the keeper's text, found by its locator, is joined to the
hits of its digest, and rows whose bytes differ leave the group and are grouped by their whole text. Where the table no longer
has that row (its files were written anew, or it was deleted), the digest's row of that id, or else of the smallest, stands in. Digests with over 1 / HOT of
the rows that have copies (so fewer than HOT digests) are known to every task by a broadcast, and salted before any join: the state and the
keeper's text are copied once for every SALT rows.

Odd input: null ids sort last (a group has a null keep_id only if all its ids are null); of rows that repeat an id all that
are equal stay with it (kept is true where doc_id is keep_id); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm.shared import new_path, table, written

SALT = 512
HOT = 4096
BROADCAST_ROWS = 500_000
STORE = "spark.sql.streaming.stateStore"
#: Stores on disk, whose changes alone go to the shared folder, and which don't take disk ahead of need.
SETTINGS = {f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true", f"{STORE}.rocksdb.allowFAllocate": "false"}


def normalised(text: Column) -> Column:
    """Each run of white space as one space. Runs that are one space already are passed over."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keep_state(documents: DataFrame, state: str, out: str, digest=sha256) -> None:
    """Runs the stream `documents` (doc_id, text, locator) to its present end; changed state goes to Parquet files under `out`."""
    spark = documents.sparkSession
    keyed = documents.select(digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), "locator")
    held = keyed.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        write = lambda batch, i: batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={i}")
        held.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(spark: SparkSession, path: str, digest=sha256, state: str | None = None, salt: int = SALT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of the documents at `path` (Parquet).

    state: a folder that keeps the stream's state from call to call, without it a new one. Between calls the table may grow, and its
    files may be written anew under other names. A file that was changed in place is not read again by the stream: rows of it that
    the state doesn't know raise ValueError.
    """
    docs = spark.read.parquet(path)
    base = state or new_path(spark, "exact-state")
    stem, name = path.rstrip("/").rsplit("/", 1)
    # a glob of one name: a file stream reads a single file by a pattern only
    stream = spark.readStream.schema(docs.schema).parquet(f"{stem}/{name[:-1]}[{name[-1]}]").select("doc_id", "text", F.col("_metadata.file_path").alias("locator"))
    keep_state(stream, f"{base}/stream", f"{base}/table", digest)
    shape = "digest string, first struct<none: boolean, doc_id: bigint, locator: string>, n bigint, batch bigint"
    held = spark.read.schema(shape).parquet(f"{base}/table").groupBy("digest").agg(F.max(F.struct("n", "first")).alias("s")).select("digest", "s.first", "s.n")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"), F.col("_metadata.file_path").alias("locator"))
    thin = written(rows.select("doc_id", F.unhex(sha256(F.col("t"))).alias("sha"), *([digest(F.col("t")).alias("digest")] if digest is not sha256 else [])), "exact-thin")
    thin = thin.select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), *["digest"] * (digest is not sha256))
    thin = thin if digest is not sha256 else thin.withColumn("digest", F.col("text_sha256"))

    if state and (unknown := thin.join(held, "digest", "left_anti").count()):
        raise ValueError(f"{unknown} rows of {path} are not in the state {state}: files that it has seen were changed in place")
    many = written(held.where("n > 1"), "exact-groups")
    # fewer than HOT digests
    hot = many.where(F.col("n") > many.agg(F.sum("n")).first()[0] // HOT if not many.isEmpty() else F.lit(False)).select("digest", F.ceil(F.col("n") / salt).alias("salts"))
    alone = thin.join(F.broadcast(hot), "digest", "left_anti").join(held.where("n = 1").select("digest"), "digest").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")

    def salted(groups: DataFrame) -> DataFrame:
        """A copy of a digest's row for each of its salts."""
        return groups.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    texts = rows.select("doc_id", "locator", digest(F.col("t")).alias("digest"), sha256(F.col("t")).alias("text_sha256"), "t")
    if many.count() <= BROADCAST_ROWS:  # texts of hits only are shuffled; beyond that size all are
        texts = texts.withColumn("short", F.xxhash64("digest")).join(F.broadcast(many.select(F.xxhash64("digest").alias("short")).distinct()), "short", "left_semi").drop("short")
    dealt = texts.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.coalesce("salts", F.lit(1)))).drop("salts")
    hits = written(dealt.join(salted(many.drop("n")), ["digest", "salt"]), "exact-texts")
    found = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("locator") == F.col("first.locator"))
    keeper = hits.where(found).groupBy("digest").agg(F.min("t").alias("keeper_t"), F.min("first.doc_id").alias("keep_id"))
    if state:  # only then can the row be gone
        other = F.struct((~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).alias("other"), F.col("doc_id").isNull().alias("none"), "doc_id", "locator")
        gone = hits.groupBy("digest").agg(F.max(found).alias("found"), F.min(other).alias("next")).where("not found").select("digest", "next")
        met = hits.join(gone, "digest").where(F.col("doc_id").eqNullSafe(F.col("next.doc_id")) & (F.col("locator") == F.col("next.locator")))
        keeper = keeper.unionByName(met.groupBy("digest").agg(F.min("t").alias("keeper_t"), F.min("doc_id").alias("keep_id")))
    keeper = salted(keeper)
    same = F.col("t") == F.col("keeper_t")
    checked = hits.join(keeper, ["digest", "salt"]).select("doc_id", "digest", "salt", "text_sha256", F.when(same, F.col("keep_id")).alias("keep_id"), same.alias("same"), F.when(~same, F.col("t")).alias("other"))
    checked = written(checked, "exact-hits")
    grouped = checked.groupBy("digest", "other").agg(F.min("doc_id").alias("other_id"), F.count(F.lit(1)).alias("group_size"))
    equal = checked.where("same").join(salted(grouped.where("other is null").select("digest", "group_size")), ["digest", "salt"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    apart = checked.where("not same").join(grouped.where("other is not null"), ["digest", "other"]).select("doc_id", F.col("other_id").alias("keep_id"), "group_size", "text_sha256")
    return alone.unionByName(equal).unionByName(apart).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""
