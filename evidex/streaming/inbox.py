"""An inbox watched as a stream: a look at the folder is a batch, and the batch operators infer the metadata of what is new.

A look lists the folder; names, lengths and times of change are the stream's rows, keyed by path. Kept state knows the last version
of each path, so only files that are new or changed are read, block by block, by the tasks that hold their keys. A version is a row
under <out>/_versions: path, filename, version (from 1), content_hash, supersedes (the hash of the version before, or null), and
`gone` for a file that wasn't seen for a while. A file that comes late, with an old time of change, is new like any other; one that
was touched and has the bytes it had is no new version. A batch that is run again starts from the state before it and overwrites
what it wrote.
"""

from __future__ import annotations

import fnmatch
import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evidex.operators.staging import entries
from evidex.sources import paged
from evidex.sources.folders import exists, place, uri
from evidex.sources.readers import form_feed_pages, head_texts, pages

SIGHT = "path string, filename string, length long, modified long"
VERSION = "path string, filename string, length long, version int, content_hash string, supersedes string, gone boolean"
_STATE = "filename string, length long, modified long, content_hash string, version int, due long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Look(InputPartition):
    pass


class _Looks(DataSourceStreamReader):
    """Every batch lists the folder anew, in a task."""

    def __init__(self, folder: str, glob: str):
        self.folder, self.glob = folder, glob

    def initialOffset(self) -> dict:
        return {"look": 0}

    def latestOffset(self) -> dict:
        return {"look": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Look(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, name = place(self.folder)
        head = "file:" if self.folder.startswith("file:") else self.folder[: self.folder.index("/", self.folder.index("://") + 3)]
        for f in store.get_file_info(fs.FileSelector(name)):
            if f.is_file and not f.base_name.startswith((".", "_")) and fnmatch.fnmatchcase(f.base_name, self.glob):
                yield f"{head}/{f.path.lstrip('/')}", f.base_name, f.size, f.mtime_ns or 0


class FolderLooks(DataSource):
    """Source `folder_looks`: path, filename, length, modified of the files in `path` whose names are like `glob`, at every batch."""

    @classmethod
    def name(cls) -> str:
        return "folder_looks"

    def schema(self) -> str:
        return SIGHT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Looks(self.options["path"], self.options.get("glob", "*"))


def _digest(path: str) -> str | None:
    """The SHA-256 of a file's bytes; null for one that is there no more."""
    store, name = place(path)
    if not store.get_file_info(name).is_file:
        return None
    digest = hashlib.sha256()
    with store.open_input_stream(name) as f:
        while block := f.read(paged.BLOCK):
            digest.update(block)
    return digest.hexdigest()


class Versions(StatefulProcessor):
    """Rows VERSION of a path's sights. gone_after: milliseconds without a sight after which a file is gone and its state goes, or None."""

    def __init__(self, gone_after: int | None = None):
        self.gone_after = gone_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = max(rows, key=lambda r: r.modified)
        name, length, modified, known, version, due = self.last.get() if self.last.exists() else (None, None, None, None, 0, None)
        digest = known if (length, modified) == (seen.length, seen.modified) else _digest(key[0])
        if digest is None:
            return
        if self.gone_after is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.gone_after
            self.handle.registerTimer(due)
        fresh = digest != known
        self.last.update((seen.filename, seen.length, seen.modified, digest, version + fresh, due))
        if fresh:
            yield Row(path=key[0], filename=seen.filename, length=seen.length, version=version + 1, content_hash=digest, supersedes=known, gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            name, length, _, known, version, due = self.last.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                # the number is kept, so that a file that comes back goes on from it
                self.last.update((name, None, None, None, version + 1, None))
                yield Row(path=key[0], filename=name, length=length, version=version + 1, content_hash=None, supersedes=known, gone=True)


def _with_content(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with paged.opened(path) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    return files.select("path").mapInArrow(run, "path string, content binary")


def watch_inbox(spark: SparkSession, folder: str, out: str, checkpoint: str, extract: Callable[[bytes], list[str]] = form_feed_pages, most_pages: int = 5, once: bool = True, gone_after: int | None = None, every: str = "1 minute") -> StreamingQuery:
    """Entries of a folder's *.pdf files as Parquet under out, and their versions under out/_versions.

    A file's new version has an entry of its own; a content hash seen before, in any run with this checkpoint, is passed over. Of
    new files with equal bytes the first by path has the entry. once: look one time and stop, else look again `every` so often.
    gone_after: milliseconds. No such folder: FileNotFoundError.
    """
    if not exists(spark, folder):
        raise FileNotFoundError(f"inbox not found: {folder}")
    spark.dataSource.register(FolderLooks)
    sights = spark.readStream.format("folder_looks").option("path", uri(folder)).option("glob", "*.pdf").load()
    versions = sights.groupBy("path").transformWithState(Versions(gone_after), VERSION, "Append", "None" if gone_after is None else "ProcessingTime")

    def stage(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_versions/batch={number}")
        every_ = spark.read.schema(f"{VERSION}, batch long").parquet(f"{out}/_versions").where("not gone")
        before = every_.where(F.col("batch") < number).select("content_hash")
        new = every_.where(F.col("batch") == number).groupBy("content_hash").agg(F.min(F.struct("path", "filename", "length")).alias("f"))
        new = new.join(before, "content_hash", "left_anti").select("f.*", "content_hash")
        texts = paged.pages(new, last=most_pages) if extract is form_feed_pages else pages(_with_content(new), extract)
        heads = head_texts(new, texts, most_pages)
        entries(heads.select("filename", "head_text", "content_hash")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = versions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(stage)
    usual = spark.conf.get(_PROVIDER, None)
    # a query takes its settings along when it starts
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
    finally:
        spark.conf.unset(_PROVIDER) if usual is None else spark.conf.set(_PROVIDER, usual)


def current(spark: SparkSession, out: str) -> DataFrame:
    """path, filename, version, content_hash of the files that are there, by the last look; entries are met by content_hash."""
    rows = spark.read.schema(f"{VERSION}, batch long").parquet(f"{out}/_versions")
    last = rows.groupBy("path").agg(F.max_by(F.struct("filename", "version", "content_hash", "gone"), "version").alias("v"))
    return last.select("path", "v.*").where("not gone").drop("gone")
