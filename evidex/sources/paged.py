"""Files of any size as pages: text whose pages are parted by form feeds, read by byte ranges, and digests taken block by block.

A task lists the files and their lengths, empty ones too; a file is cut in ranges of bytes that tasks share. A pass over the ranges counts their
form feeds, sums over the ranges before number the pages, and a range reads the pages whose form feed lies in it (the first page belongs to
the first range), on into the next ranges if need be. A file is never held whole, only one page at a time. Ranges outside the
pages asked for are not read. The first pages alone are read from the front of each file without counting.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.sources.folders import LISTED, entries, place, uri

BLOCK = 1 << 20
RANGE = 64 << 20
BREAK = b"\f"
PAGE = "document_id string, page_number int, text string, char_count int, extraction_method string"
_NAMES = [x.split()[0] for x in PAGE.split(", ")]


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has: few bytes of rows stand for much to read, so that their size says nothing."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def listed(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, filename, length of the files of a folder. Contents are not read."""
    where = uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = place(where)
        head = "file:" if where.startswith("file:") else where[: where.index("/", where.index("://") + 3)]
        head += f"/{folder.strip('/')}".rstrip("/")
        for b in batches:
            for _ in range(len(b)):
                for some in batched((e for e in entries(store, folder) if not e[0].startswith((".", "_")) and fnmatch.fnmatchcase(e[0], glob)), LISTED):
                    names, sizes = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{head}/{n}" for n in names], pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "filename", "length"])

    return _spread(spark.range(0, 1, 1, 1).mapInArrow(run, "path string, filename string, length long"), "path")


def present(files: DataFrame) -> DataFrame:
    """Those of files (path) that are there, with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            infos = [(path, store.get_file_info(name)) for path in b.column("path").to_pylist() for store, name in [place(path)]]
            there = [(path, info.size) for path, info in infos if info.is_file]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in there], pa.string()), pa.array([n for _, n in there], pa.int64())], ["path", "length"])

    return _spread(files.select("path"), "path").mapInArrow(run, "path string, length long")


def opened(path: str) -> pa.NativeFile:
    """A file by a path as Spark gives it."""
    store, name = place(path)
    return store.open_input_file(name)


def _blocks(path: str, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
    with opened(path) as f:
        f.seek(start)
        while block := f.read(BLOCK if stop is None else min(BLOCK, stop - f.tell())):
            yield block


def with_digests(files: DataFrame) -> DataFrame:
    """files (path, ...) with content_hash, the SHA-256 of each, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = []
            for path in b.column("path").to_pylist():
                digest = hashlib.sha256()
                for block in _blocks(path):
                    digest.update(block)
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.string())], [*b.schema.names, "content_hash"])

    fields = ", ".join(f"`{n}` {kind}" for n, kind in files.dtypes)
    return files.mapInArrow(run, f"{fields}, content_hash string")


def ranges(files: DataFrame, size: int = RANGE, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, n, start, stop, breaks, base: byte ranges of files (path, length), the form feeds in each and those before it. keep: text columns that go along.

    A file's ranges, a row for each `size` bytes, meet in a window. A join would be with as many rows as there are files, which Spark
    takes for the few bytes that the listing started from, and would broadcast.
    """
    cut = files.select("path", "length", *keep, F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L) div {size}L)")).alias("n"))
    cut = cut.select("path", *keep, "n", (F.col("n") * size).alias("start"), F.least((F.col("n") + 1) * size, F.col("length")).alias("stop"))
    cut = _spread(cut, "path", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [sum(block.count(BREAK) for block in _blocks(p, a, z)) for p, a, z in zip(*(b.column(c).to_pylist() for c in ("path", "start", "stop")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], [*b.schema.names, "breaks"])

    counted = cut.mapInArrow(run, ", ".join(["path string", *[f"{c} string" for c in keep], "n long, start long, stop long, breaks long"]))
    before = W.partitionBy("path", *keep).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("base", F.coalesce(F.sum("breaks").over(before), F.lit(0)))


def _read(path: str, start: int, stop: int | None, number: int | None, first: int, last: int | None) -> Iterator[tuple[int, str]]:
    """(number, text) of the pages from first to last that begin in a range. number: of the page that begins with the range, if one does."""
    held: list[bytes] | None = [] if number is not None and first <= number else None
    at, now = start, number if number is not None else 0
    for block in _blocks(path, start):
        begin = 0
        while begin <= len(block):
            end = block.find(BREAK, begin)
            if held is not None:
                held.append(block[begin : end if end >= 0 else len(block)])
            if end < 0:
                break
            if held is not None:
                yield now, b"".join(held).decode("utf-8", "replace")
            if stop is not None and at + end >= stop or last is not None and now >= last:
                return
            now += 1
            held = [] if now >= first else None
            begin = end + 1
        at += len(block)
        if held is None and stop is not None and at >= stop:
            return
    if held is not None:
        yield now, b"".join(held).decode("utf-8", "replace")


def pages(files: DataFrame, first: int = 1, last: int | None = None, size: int = RANGE, method: str = "form_feed", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per page of files (path, length), document_id being the path; first, last: numbers of the pages asked for.

    keep: text columns of files that go along to each page, so that pages needn't be joined to their files: Spark takes pages for
    as few bytes as the rows of files are, and might send them to every task.
    With first = 1 and a last page, each file is read from its front to that page; else by ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(row: dict, found: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
            if found:
                numbers, texts = zip(*found)
                same = [pa.array([row[c]] * len(found), pa.string()) for c in keep]
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(found)), pa.array(numbers, pa.int32()), pa.array(texts), pa.array(map(len, texts), pa.int32()), pa.array([method] * len(found)), *same], [*_NAMES, *keep])

        for b in batches:
            for row in b.to_pylist():
                rows, held = [], 0
                # a page begins the range only at the front of a file; behind it pages begin after form feeds
                front = row["start"] == 0
                for number, text in _read(row["path"], row["start"], row["stop"], 1 if front else None, first if front else first - row["base"] - 1, last if front or last is None else last - row["base"] - 1):
                    rows.append((number if front else number + row["base"] + 1, text))
                    held += len(text)
                    if held > BLOCK:
                        yield from out(row, rows)
                        rows, held = [], 0
                yield from out(row, rows)

    shape = ", ".join([PAGE, *[f"{c} string" for c in keep]])
    if first == 1 and last is not None:
        return files.selectExpr("path", "0L start", "cast(null as long) stop", "0L base", *keep).mapInArrow(run, shape)
    cut = ranges(files, size, keep)
    # the front range holds pages 1 to breaks + 1, another base + 2 to base + breaks + 1
    least, most = F.when(F.col("start") == 0, 1).otherwise(F.col("base") + 2), F.col("base") + F.col("breaks") + 1
    wanted = cut.where((least <= most) & (most >= first) & (F.lit(True) if last is None else least <= last))
    # a file's ranges come from one window, but are for many tasks to read
    return _spread(wanted.select("path", "start", "stop", "base", *keep), "path", "start").mapInArrow(run, shape)
