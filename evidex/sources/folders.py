"""Files of a folder that driver and executors reach: written whole or not at all, by the task that has their bytes."""

from __future__ import annotations

import contextlib
import hashlib
import os
import uuid
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as Spark writes it, and the name there; names may hold any character."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    at = path.find("/", path.index("://") + 3)
    store, base = fs.FileSystem.from_uri(path if at < 0 else path[:at])
    return store, base.rstrip("/") + ("" if at < 0 else path[at:])


#: Files of a folder that a task hands on at a time.
LISTED = 4096


def entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
    """Name and length of each file of a folder. Of a local folder one is held at a time; other stores hand over a whole listing."""
    if not isinstance(store, fs.LocalFileSystem):
        yield from ((f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file)
        return
    with os.scandir(folder) as found:
        for entry in found:
            with contextlib.suppress(FileNotFoundError):  # a file may go meanwhile
                if entry.is_file():
                    yield entry.name, entry.stat().st_size


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def put(folder: str, name: str, body: bytes) -> bool:
    """Writes a file under another name and moves it into place. False if the same bytes stand there; other bytes: FileExistsError."""
    store, path = place(folder)
    if store.get_file_info(f"{path}/{name}").type == fs.FileType.File:
        if _digest(store, f"{path}/{name}") == hashlib.sha256(body).hexdigest():
            return False
        raise FileExistsError(f"{folder}/{name} holds other bytes")
    replace(folder, name, body)
    return True


def replace(folder: str, name: str, body: bytes, aside: str = ".") -> None:
    """As put, whatever stands there. aside: the folder below it where the file is made; tasks that make many files in one folder wait for one another."""
    store, path = place(folder)
    made = path if aside == "." else f"{path}/{aside}"
    store.create_dir(made, recursive=True)
    part = f"{made}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(body)
    store.move(part, f"{path}/{name}")


def copy(source: str, folder: str, name: str, step: int = 1 << 20) -> bool:
    """As put, of a file's bytes, a block at a time."""
    store, path = place(folder)
    theirs, at = place(source)
    if store.get_file_info(f"{path}/{name}").type == fs.FileType.File:
        if _digest(store, f"{path}/{name}") == _digest(theirs, at):
            return False
        raise FileExistsError(f"{folder}/{name} holds other bytes")
    store.create_dir(path, recursive=True)
    part = f"{path}/.{uuid.uuid4().hex}"
    with theirs.open_input_stream(at) as read, store.open_output_stream(part) as out:
        while block := read.read(step):
            out.write(block)
    store.move(part, f"{path}/{name}")
    return True


def copy_files(named: DataFrame, folder: str) -> int:
    """Copies every file of named (name, path), in the task that holds the row, and returns how many; a file that holds other bytes is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for name, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if "/" in name:
                    raise ValueError(f"not a file name: {name!r}")
                copy(path, folder, name)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return named.select("name", "path").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _digest(store: fs.FileSystem, path: str, step: int = 1 << 20) -> str:
    found = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while block := f.read(step):
            found.update(block)
    return found.hexdigest()


#: A file of a folder that names the staged files which belong in the folder.
LOG = "_commit"


def write_files(named: DataFrame, folder: str, keep: bool = False) -> int:
    """Writes every row of named (name, body) as a file, in the task that holds it, and returns how many. keep: a file that holds other bytes is an error.

    All or none: files are written aside; once all are there, a log says so, and they move into place. A run that ends before the
    log leaves the folder as it was; one that ends after it is finished by whoever reads or writes next (settle).
    """
    spark = named.sparkSession
    settle(spark, folder)
    stage = f".staged-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        n, own = 0, f".{uuid.uuid4().hex}"
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if "/" in name:
                    raise ValueError(f"not a file name: {name!r}")
                n += 1
                if keep and store.get_file_info(f"{path}/{name}").type == fs.FileType.File:
                    if _digest(store, f"{path}/{name}") != hashlib.sha256(body).hexdigest():
                        raise FileExistsError(f"{folder}/{name} holds other bytes")
                    continue
                replace(f"{folder}/{stage}", name, body, own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = named.select("name", F.col("body").cast("binary").alias("body"))
    n = rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n:
        replace(folder, LOG, stage.encode())
        settle(spark, folder)
    return n


def settle(spark: SparkSession, folder: str) -> None:
    """Finishes a write whose files are all there but not all in place."""
    store, path = place(folder)
    if store.get_file_info(f"{path}/{LOG}").type != fs.FileType.File:
        return
    with store.open_input_stream(f"{path}/{LOG}") as f:
        stage = f"{path}/{f.read().decode()}"

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = place(folder)
        for b in batches:
            there = len(b) and own.get_file_info(stage).type == fs.FileType.Directory
            for some in batched((name for name, _ in entries(own, stage) if not name.startswith(".")) if there else (), LISTED):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["name"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = place(folder)
        n = 0
        for b in batches:
            for name in b.column(0).to_pylist():
                # another attempt may have moved it
                if own.get_file_info(f"{stage}/{name}").type == fs.FileType.File:
                    own.move(f"{stage}/{name}", f"{path}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    spark.range(0, 1, 1, 1).mapInArrow(names, "name string").repartition(spark.sparkContext.defaultParallelism, "name").mapInArrow(moved, "n long").agg(F.sum("n")).first()
    store.delete_file(f"{path}/{LOG}")
    if store.get_file_info(stage).type == fs.FileType.Directory:
        store.delete_dir(stage)
