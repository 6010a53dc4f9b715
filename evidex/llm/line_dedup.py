"""Line deduplication by a deletion-neighbourhood join.

Lines are what '\\n' separates. A line goes when an equal line, or one within the edit bound, stands earlier in the corpus: in
order of doc_id (null last), then line number. The bound is one inserted, deleted or replaced character for lines of `fuzzy`
(FUZZY by default) or more characters, and none for shorter ones. Lines of white space alone always stay.

1. Equal lines: the earliest place of each 128-bit line hash, by a partial-aggregated minimum.
2. Which lines can have a near line at all: cut the shorter of two lines into P pieces; an edit lies in one piece, so all before
   and all after it agree. Keys (P, piece, length, hash before, hash after) that hold one line only rule it out. Two rounds, of
   2 and of PIECES pieces; the first uses hashes only and nothing is lost.
3. Deletion neighbourhood: for the pieces left, every variant of the line with one character deleted in that piece is emitted as
   a 128-bit hash (rolling sums, so a line costs as much as its length). Lines of equal length that share a variant at the same
   position differ by a replacement there; a line that equals a variant of another differs by that deletion. So a group of
   any size needs only its least member, never its pairs.
4. The earlier line found is joined by its place and the edit distance is verified on the texts.
5. Places of the lines to drop: lines that make over 1 / HOT of all (so fewer than HOT lines) are found by a broadcast, the rest
   by a join on the hash, so no common line meets in one task.

Odd input: null is the empty text; rows with the same id and text are one document and share their fate; a table without rows
gives none; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.arrays import mix
from evidex.llm.shared import table, written

FUZZY = 10
PIECES = 16
HOT = 4096
VARIANTS = 1 << 18
BROADCAST_ROWS = 500_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
PLACE = "struct<none: boolean, doc_id: bigint, line: int, row: bigint>"


def occurrences(docs: DataFrame, text: bool) -> DataFrame:
    """at (place), h1, h2 (hash of the line), and with `text` the line, for every line that isn't blank."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("row"), F.posexplode(F.split(body, "\n")).alias("line", "t"))
    lines = lines.where(F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line", "row")
    return lines.select(place.alias("at"), F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), *["t"] * text)


def piece_keys(t: Column, pieces: int) -> Column:
    """For both lengths that the shorter line of a pair can have: struct(length, piece, key)."""
    n = F.length(t)

    def one(length: Column, p: int) -> Column:
        a, e = F.floor(length * p / pieces).cast("int"), F.floor(length * (p + 1) / pieces).cast("int")
        key = F.xxhash64(F.lit(p), length, F.substring(t, F.lit(1), a), F.lit(" | "), F.substring(t, e + (n - length) + 1, F.greatest(length - e, F.lit(0))))
        return F.struct(length.alias("length"), F.lit(p).alias("piece"), key.alias("key"))

    return F.array(*[one(n - d, p) for d in (0, 1) for p in range(pieces)])


def shared_pieces(lines: DataFrame, pieces: int, name: str) -> DataFrame:
    """key of the pieces that two lines or more have."""
    keyed = lines.select("h1", F.explode(piece_keys(F.col("t"), pieces)).alias("k"))
    return written(keyed.groupBy("k.key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"), name)


def _variant_hashes(codes: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.uint64]:
    """Hash of the line without character i for every i, and of the whole line."""
    n = len(codes)
    weight = np.full(n + 1, base)
    weight[0] = 1
    weight = np.cumprod(weight, dtype=np.uint64)[::-1]  # base to the n, ..., 1
    whole = codes * weight[1:]
    shorter = codes[:-1] * weight[2:]
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shorter, dtype=np.uint64)))
    total = np.cumsum(whole, dtype=np.uint64)
    return before + (total[-1] - total), total[-1]


def neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (number, t, pieces): rows (number, v1, v2, tag, whole). tag i + 1: the line without character i, to meet such of equal length; tag 0: the line (whole) or the line without a character."""
    names = ["number", "v1", "v2", "tag", "whole"]
    held: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    for b in batches:
        for number, text, pieces in zip(*(c.to_pylist() for c in b.columns)):
            codes = mix(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
            n = len(codes)
            (v1, w1), (v2, w2) = _variant_hashes(codes, BASES[0]), _variant_hashes(codes, BASES[1])
            same, less = np.zeros(n, bool), np.zeros(n, bool)
            for x in pieces:
                length = x["length"]
                a, e = length * x["piece"] // PIECES, length * (x["piece"] + 1) // PIECES
                if length == n:
                    same[a:e] = True
                else:
                    less[a : e + 1] = True
            i, j = np.flatnonzero(same), np.flatnonzero(less)
            if len(j):
                j = j[np.unique(np.stack([v1[j], v2[j]]), axis=1, return_index=True)[1]]
            one = np.array([w1, w2], np.uint64)
            rows = len(i) + len(j) + 1
            hashes = [np.concatenate([v[i], v[j], one[k : k + 1]]).view(np.int64) for k, v in enumerate((v1, v2))]
            tag = np.concatenate([i + 1, np.zeros(len(j) + 1, np.int64)]).astype(np.int64)
            held.append((np.full(rows, number, np.int64), *hashes, tag, np.arange(rows) == rows - 1))
            size += rows
            if size >= VARIANTS:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def near_earlier(docs: DataFrame, firsts: DataFrame, fuzzy: int = FUZZY) -> DataFrame:
    """h1, h2 of the lines that have an earlier line within the bound. firsts: h1, h2, first (place) of every line."""
    long = occurrences(docs, True).where(F.length("t") >= fuzzy)
    halves = shared_pieces(long, 2, "lines-halves")
    if halves.count() <= BROADCAST_ROWS:
        some = long.select("h1", "h2", "t", F.explode(piece_keys(F.col("t"), 2)).alias("k")).select("h1", "h2", "t", "k.key").join(F.broadcast(halves), "key", "left_semi")
    else:  # hashes are shuffled first, and texts only once
        hit = long.select("h1", "h2", F.explode(piece_keys(F.col("t"), 2)).alias("k")).select("h1", "h2", "k.key").join(halves, "key", "left_semi")
        some = long.select("h1", "h2", "t").join(hit.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    some = written(some.groupBy("h1", "h2").agg(F.min("t").alias("t")), "lines-half")
    parts = shared_pieces(some, PIECES, "lines-pieces")
    left = some.select("h1", "h2", "t", F.explode(piece_keys(F.col("t"), PIECES)).alias("k")).join(parts.withColumnRenamed("key", "shared"), F.col("k.key") == F.col("shared"), "left_semi")
    left = left.groupBy("h1", "h2").agg(F.min("t").alias("t"), F.collect_set(F.struct("k.length", "k.piece")).alias("pieces"))
    left = written(left.join(firsts, ["h1", "h2"]).select("h1", "h2", "t", "pieces", "first", F.xxhash64("h1", "h2").alias("number")), "lines-left")
    variants = left.select("number", "t", "pieces").mapInArrow(neighbourhood, "number long, v1 long, v2 long, tag long, whole boolean")
    variants = written(variants.join(left.select("number", "first"), "number"), "lines-variants")
    least = variants.groupBy("v1", "v2", "tag").agg(F.min(F.when(F.col("whole"), F.col("first"))).alias("of_whole"), F.min(F.when(~F.col("whole"), F.col("first"))).alias("of_less"))
    met = variants.join(least, ["v1", "v2", "tag"]).withColumn("other", F.when((F.col("tag") == 0) & ~F.col("whole"), F.col("of_whole")).otherwise(F.col("of_less")))
    met = met.where("other < first").groupBy("number").agg(F.collect_set("other").alias("others")).select("number", F.explode("others").alias("other"))
    met = met.join(left.select("number", "h1", "h2", "t"), "number").join(left.select(F.col("first").alias("other"), F.col("t").alias("other_t")), "other")
    return met.where(F.levenshtein("t", "other_t", 1).between(0, 1)).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, fuzzy: int = FUZZY) -> DataFrame:
    """doc_id, row (hash of the text), n (how many lines are to be dropped) and flags (bytes: 1 at the numbers of such lines, else 0), for the documents that have such."""
    every = written(occurrences(docs, False), "lines-all")
    firsts = written(every.groupBy("h1", "h2").agg(F.min("at").alias("first"), (F.max("at") > F.min("at")).alias("again"), F.count(F.lit(1)).alias("n")), "lines-first")
    near = near_earlier(docs, firsts.select("h1", "h2", "first"), fuzzy).withColumn("near", F.lit(True))
    judged = written(firsts.join(near, ["h1", "h2"], "left").where("again or near"), "lines-judged")
    common = judged.where(F.col("n") > (firsts.agg(F.sum("n")).first()[0] or 0) // HOT)
    # fewer than HOT lines
    hot, keys = F.broadcast(common.select("h1", "h2", "first", "near")), ["h1", "h2"]
    rest = every.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(judged.select(*keys, "first", "near"), keys)
    met = rest.unionByName(every.join(hot, keys))
    gone = met.where(F.col("near") | (F.col("at") > F.col("first"))).select("at.doc_id", "at.row", "at.line")
    digit = lambda of: lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get(of, i - 1), F.lit(-1)) - 1), F.lit("1"))
    # a lambda's variable holds the sorted numbers, so that they are sorted once
    written_out = F.transform(F.array(F.array_sort(F.collect_set("line"))), lambda of: F.array_join(F.transform(of, digit(of)), ""))
    return gone.groupBy("doc_id", "row").agg(F.count_distinct("line").alias("n"), F.get(written_out, F.lit(0)).cast("binary").alias("flags"))


def _judged(docs: DataFrame, fuzzy: int) -> tuple[DataFrame, Column, Column, Column]:
    """docs as `d` with its dropped lines, and as columns: the text that stays, its number of lines before, and how many go."""
    body = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    joined = docs.alias("d").join(dropped_lines(docs, fuzzy).alias("g"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(body) == F.col("g.row")), "left")
    lines = F.split(body, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: F.substring(F.col("g.flags"), i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    return joined, F.when(F.col("g.flags").isNull(), F.col("d.text")).otherwise(kept), F.size(lines), F.coalesce(F.col("g.n"), F.lit(0)).cast("int")


def _columns(docs: DataFrame, text: Column, dropped: Column) -> list[Column]:
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(dropped > 0, F.length(text)).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    return [new[c].alias(c) if c in new else F.col(f"d.`{c}`") for c in docs.columns]


def without_repeated_lines(docs: DataFrame, fuzzy: int = FUZZY) -> DataFrame:
    """Every row of docs with the lines that stay as its text, and n_lines and n_dropped (in place of such columns, if docs has them)."""
    joined, text, lines, dropped = _judged(docs, fuzzy)
    docs = docs.drop("n_lines", "n_dropped")
    return joined.select(*_columns(docs, text, dropped), lines.alias("n_lines"), dropped.alias("n_dropped"))


def drop_repeated_lines(docs: DataFrame, fuzzy: int = FUZZY) -> DataFrame:
    """docs, its columns only, with the lines that stay; documents of which no line stays go, those that had none but blank ones don't."""
    joined, text, _, dropped = _judged(docs, fuzzy)
    return joined.where((dropped == 0) | text.rlike(r"[^\x20\x09-\x0D]")).select(*_columns(docs, text, dropped))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's lines and how many go; an edit of one character counts for lines of FUZZY (10) or more characters, none for shorter ones."""
    out = without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.coalesce("text", F.lit("")).alias("text"))


_EDIT = "len(list_filter(range(a.n + 1), lambda i: left(a.t, i) = left(b.t, i) AND right(a.t, a.n - i - {one}) = right(b.t, a.n - i - {one}))) > 0"
#: Pairs that share the first or the last half of the shorter line, and of these the ones that one edit parts.
OP3_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS pos, regexp_matches(t, '[^\\x20\\x09-\\x0D]') AS filled FROM l),
f AS (SELECT t, length(t) AS n, min(pos) AS first FROM p WHERE filled GROUP BY t),
g AS (SELECT * FROM f WHERE n >= {FUZZY}),
pairs AS (
  {" UNION ".join(f"SELECT a.t AS x, b.t AS y, a.first AS xf, b.first AS yf FROM g a JOIN g b ON a.n = b.n - {d} AND {side}(a.t, {half}) = {side}(b.t, {half}) AND a.t <> b.t AND {_EDIT.format(one=1 - d)}" for d in (0, 1) for side, half in (("left", "a.n // 2"), ("right", "a.n - a.n // 2")))}
),
near AS (SELECT x AS t FROM pairs WHERE yf < xf UNION SELECT y FROM pairs WHERE xf < yf),
k AS (SELECT p.*, NOT filled OR (p.pos = f.first AND near.t IS NULL) AS stays FROM p LEFT JOIN f ON p.t = f.t AND p.filled LEFT JOIN near ON near.t = p.t AND p.filled),
o AS (SELECT doc_id, count(*)::INTEGER AS n_lines, count_if(NOT stays)::INTEGER AS n_dropped, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (stays), '') AS text FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS text_sha256, text FROM o
"""
