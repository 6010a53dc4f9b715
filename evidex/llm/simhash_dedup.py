"""Near-duplicates by SimHash, compared through pivot distance tables.

1. Every text's words, lower-cased in A-Z, give 3-word shingles with repeats; a fingerprint bit is set where over half of the
   shingles' XXH64 (seed 42) have it. Null, empty and blank texts have fingerprint zero.
2. Equal fingerprints are one class from here on, so copies cost nothing in the search.
3. No all-pairs join is allowed, so distinct fingerprints first meet by a lossless block key: the 64 bits make six blocks, and
   two fingerprints that differ in at most three bits agree in at least three of them. Each of the 20 choices of three blocks
   (32 or 33 bits) is a key.
4. Within a key, each fingerprint's Hamming distances to PIVOTS fixed reference fingerprints are computed once. Rows are
   sorted by the first distance, and a pair goes when any distance differs by over three, which the triangle inequality
   makes safe. What is left is verified bit by bit.
5. A task emits only links that join parts not yet joined, so its output is linear in its rows. Keys with over HOT distinct
   fingerprints are dealt as pairs of chunks to many tasks; nothing is dropped.

The pipeline's stage (drop_near_copies) has a setting of its own: texts are near-copies if the sets of their NEAR_SHINGLE-word
shingles have a Jaccard similarity of LEAST (four fifths) or more. Texts with equal sets are one class. Two sets that alike
share one of the fifth of their shingles (and one more) with the least hashes, so these are the lossless keys. Within a key, pairs
of like size go through a pivot distance table; those left whose fingerprints of 256 bits differ in at most NEAR_BITS meet in a
loose cluster (at 0.8, 39 to 48 bits are expected, with a standard deviation of 6). Within a loose cluster, pairs go through the
table again, and what is left is judged by the exact similarity of the sets; clusters with over SET_CHUNK shingles are dealt as
pairs of chunks. Links are spanning throughout.

That table is taken before SimHash's majority, since majorities of unrelated texts lie too evenly around any fixed fingerprint for a
bound of NEAR_BITS. A set is a bit vector over all hashes, and these are dealt in 24 parts with a fixed reference fingerprint each; a
distance is the set's Hamming distance to it within the part. Two sets of a and b shingles differ in at most (a + b) / 9 places if
they are alike at 0.8, and by the triangle inequality in at least the sum of their 24 coordinate differences: what that discards is
lost to no link.

Results for odd input: null ids take part, and a component's id is its smallest id that is not null; rows that repeat an id
each give a row; an empty table gives none; columns other than doc_id and text are not looked at. For drop_near_copies a document
is what rows equal in id and text say: such rows share their fate, and rows with the same id and other texts are judged apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.arrays import LOWER, Links, mix, powers, slices, word_hashes, words
from evidex.llm.shared import connected_components, table, written

SHINGLE = 3
BITS = 3
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
MASKS = [sum(((1 << n) - 1) << at for at, n in kept) for kept in combinations(BLOCKS, len(BLOCKS) - BITS)]
PIVOTS = mix(np.arange(1, 25, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
HOT = 20_000
NEAR_SHINGLE = 5
LEAST = (4, 5)
NEAR_BITS = 90
SKETCH = ["s0", "s1", "s2", "s3"]
TABLE = ["d0", "d1", "d2"]
SET_CHUNK = 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text in UTF-8."""
    w = text.lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    n = max(1, len(w) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((fingerprint(t.as_py() or b"", shingle) for t in texts), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _search(key: np.ndarray, fp: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> list[np.ndarray]:
    """Linking pairs of fingerprints with equal keys, a spanning part of them. left, right: the roles of a row in its group."""
    x = fp.view(np.uint64)
    first = np.bitwise_count(x ^ PIVOTS[0]).astype(np.int16)
    order = np.lexsort((first, key))
    key, x, left, right = key[order], x[order], left[order], right[order]
    distances = np.bitwise_count(x[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    first, links, out = distances[:, 0], Links(len(x)), []
    at, k = np.arange(len(x)), 0
    while True:
        k += 1
        at = at[at + k < len(x)]
        at = at[(key[at] == key[at + k]) & (first[at + k] - first[at] <= bits)]
        if not len(at):
            return out
        pair = at[(left[at] & right[at + k]) | (right[at] & left[at + k])]
        for p in range(1, len(PIVOTS)):
            if not len(pair):
                break
            pair = pair[np.abs(distances[pair, p] - distances[pair + k, p]) <= bits]
        pair = pair[np.bitwise_count(x[pair] ^ x[pair + k]) <= bits]
        if len(pair):
            pair = pair[links.add(pair, pair + k)]
            out.append(np.stack([x[pair].view(np.int64), x[pair + k].view(np.int64)]))


def _groups(bits: int):
    """For mapInArrow over rows (g, m, c, role, fp) whose groups (g, m, c) follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                change = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
                for pairs in _search(np.cumsum(change), np.ascontiguousarray(rows[:, 4]), (rows[:, 3] & 1) > 0, (rows[:, 3] & 2) > 0, bits):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        rest = np.zeros((0, 5), np.int64)
        for b in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)])
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            cut = change[-1] if len(change) else 0
            yield from found(rows[:cut])
            rest = rows[cut:]
        yield from found(rest)

    return run


def links(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Of distinct fingerprints fp: pairs (a, b) that differ in `bits` (at most 3) bits or fewer, enough of them to give every component."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be in 0 to {BITS}")
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("g"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("m")) for i, m in enumerate(MASKS)])
    banded = fps.select("fp", F.explode(keys).alias("k")).select("k.g", "k.m", "fp")
    counted = banded.select("*", F.expr("count(1) over (partition by g, m)").alias("n"))
    cold = counted.where(F.col("n").between(2, hot)).select("g", "m", F.lit(0).cast("long").alias("c"), F.lit(3).cast("long").alias("role"), "fp")
    chunks = F.ceil(F.col("n") / hot)
    own = F.pmod(F.xxhash64("fp"), chunks)
    # chunk i meets chunk j in task (min, max); role 1: it stands on the left there, 2: on the right, 3: both
    paired = counted.where(F.col("n") > hot).select("g", "m", "fp", own.alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("p"))
    split = paired.select("g", "m", (1 + F.least("o", "p") * (1 << 20) + F.greatest("o", "p")).alias("c"), F.expr("case when o = p then 3 when o < p then 1 else 2 end").cast("long").alias("role"), "fp")
    split = split.repartition("g", "m", "c").sortWithinPartitions("g", "m", "c")
    return cold.mapInArrow(_groups(bits), "a long, b long").unionByName(split.mapInArrow(_groups(bits), "a long, b long"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint, component_id, kept of every row; kept is true for the rows whose id stands for their component."""
    prints = written(fingerprints(docs, shingle), "simhash-fp")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(classes.select("fp"), bits), "simhash-cc")
    labelled = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(by_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Of each text: the sorted distinct hashes of its shingles; a text of fewer words is one shingle, a blank one has none."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h, by = word_hashes(data, starts, ends), powers(shingle)
    rolled = np.zeros(max(0, len(h) - shingle + 1), np.uint64)
    for i in range(shingle):
        rolled += h[i : i + len(rolled)] * by[i]
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= shingle:
            yield np.unique(rolled[a : b - shingle + 1])
        else:
            yield mix((h[a:b] * by[: b - a]).sum(keepdims=True) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A fingerprint of 256 bits of a set, as four signed integers."""
    counts = np.zeros(256, np.int64)
    for i in range(0, len(shingles), 1 << 14):
        part = shingles[i : i + (1 << 14)]
        four = np.stack([part] + [mix(part + PIVOTS[k]) for k in range(1, len(SKETCH))], axis=1)
        counts += np.add.reduce(np.unpackbits(four.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")


def pivot_distances(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 24 Hamming distances for each set: in part h % 24 of the hashes h, to the fingerprint of all h with bit 32 unset there.

    They are without what the reference has itself, equal for all sets, and cut to eight bits, which makes no difference greater.
    """
    h, n = np.concatenate(sets), len(PIVOTS)
    cell = np.repeat(np.arange(len(sets)) * n, [len(s) for s in sets]) + (h % np.uint64(n)).astype(np.int64)
    step = 2.0 * ((h >> np.uint64(32)) & np.uint64(1)) - 1
    return np.clip(np.bincount(cell, step, len(sets) * n), -127, 127).astype(np.int8).reshape(-1, n)


def undiscarded(distances: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs (a, b) of rows whose coordinate differences leave a similarity of LEAST possible. distances: wider than eight bits."""
    apart = np.abs(distances[a] - distances[b]).sum(axis=1, dtype=np.int64)
    return np.flatnonzero((LEAST[1] + LEAST[0]) * apart <= (LEAST[1] - LEAST[0]) * (size[a] + size[b]))


def _class(shingles: np.ndarray) -> int:
    return int(mix(mix(shingles + PIVOTS[0]).sum(keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def _prints(shingle: int):
    """For mapInArrow over (doc_id, t, text): doc_id, t, the set's class k, its size, sketch, pivot distances and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column(2)):
                sets = list(shingle_sets(data, offsets, shingle))
                sketches = np.stack([sketch(s) for s in sets])
                keys = [s[: len(s) - -(-len(s) * LEAST[0] // LEAST[1]) + 1].view(np.int64) for s in sets]
                ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
                columns = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                columns += [pa.array(np.ascontiguousarray(c)) for c in (*sketches.T, *pivot_distances(sets).view("<i8").T)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], ["doc_id", "t", "k", "size", *SKETCH, *TABLE, "keys"])

    return run


def _sets(shingle: int):
    """For mapInArrow over (t, text): t and the set's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(data, offsets, shingle)], pa.binary())], ["t", "shingles"])

    return run


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows (g, c, role, k, size, sketch, pivot distances) whose groups (g, c) follow one another: spanning links of
    the pairs that the pivots do not discard and whose sketches are alike."""

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        group = np.cumsum(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
        order = np.lexsort((rows[:, 4], group))
        group, rows = group[order], rows[order]
        role, size, bits = rows[:, 2], rows[:, 4], np.ascontiguousarray(rows[:, 5:9]).view(np.uint64)
        distances = np.ascontiguousarray(rows[:, 9:]).view(np.int8).astype(np.int16)
        names, own = np.unique(rows[:, 3], return_inverse=True)
        links, at, k = Links(len(names)), np.arange(len(rows)), 0
        while True:
            k += 1
            at = at[at + k < len(rows)]
            at = at[(group[at] == group[at + k]) & (LEAST[1] * size[at] >= LEAST[0] * size[at + k])]
            if not len(at):
                return
            # roles 1 and 2 meet, and 3 and 3
            pair = at[(role[at] | role[at + k]) == 3]
            pair = pair[(role[pair] == 3) | (role[pair] != role[pair + k])]
            pair = pair[links.parent[own[pair]] != links.parent[own[pair + k]]]
            pair = pair[undiscarded(distances, size, pair, pair + k)]
            pair = pair[np.bitwise_count(bits[pair] ^ bits[pair + k]).sum(axis=1, dtype=np.int64) <= NEAR_BITS]
            if len(pair):
                pair = pair[links.add(own[pair], own[pair + k])]
                yield pa.RecordBatch.from_arrays([pa.array(names[own[pair]]), pa.array(names[own[pair + k]])], ["a", "b"])

    rest = np.zeros((0, 12), np.int64)
    for b in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)])
        change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        cut = change[-1] if len(change) else 0
        yield from found(rows[:cut])
        rest = rows[cut:]
    yield from found(rest)


def alike(sets: list[np.ndarray], role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs of sets whose Jaccard similarity is LEAST or more; pairs that the pivots discard are not looked at closer."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, role = [sets[i] for i in order], role[order]
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    ids, distances = np.unique(np.concatenate(sets), return_inverse=True)[1], pivot_distances(sets).astype(np.int16)
    links, mark, a, b = Links(len(sets)), np.zeros(len(ids), bool), [], []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, np.searchsorted(size, LEAST[1] * size[i] // LEAST[0], side="right"))
        j = j[(links.parent[j] != links.parent[i]) & ((role[j] | role[i]) == 3) & ((role[j] == 3) | (role[j] != role[i]))]
        j = j[undiscarded(distances, size, np.full(len(j), i), j)]
        if not len(j):
            continue
        mine = ids[start[i] : start[i] + size[i]]
        mark[mine] = True
        begin = np.cumsum(size[j]) - size[j]
        both = np.add.reduceat(mark[ids[np.repeat(start[j] - begin, size[j]) + np.arange(size[j].sum())]], begin, dtype=np.int64)
        mark[mine] = False
        j = j[LEAST[1] * both >= LEAST[0] * (size[i] + size[j] - both)]
        j = j[links.add(np.full(len(j), i), j)]
        a.append(np.full(len(j), i))
        b.append(j)
    none = [np.zeros(0, np.int64)]
    return order[np.concatenate(a or none)], order[np.concatenate(b or none)]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows (root, c, role, k, shingles) whose groups (root, c) follow one another."""
    group, rows = None, []

    def found() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            names = np.array([r[1] for r in rows])
            a, b = alike([np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[0] for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])

    for batch in batches:
        for root, c, *row in zip(*(column.to_pylist() for column in batch.columns)):
            if (root, c) != group:
                yield from found()
                group, rows = (root, c), []
            rows.append(row)
    yield from found()


def _dealt(rows: DataFrame, chunks, where: str) -> DataFrame:
    """rows with c and role, dealt by (where, c): chunk i meets chunk j in (min, max); role 1: it stands on the left there, 2: on the right, 3: both."""
    rows = rows.withColumn("chunks", chunks).withColumn("o", F.pmod(F.xxhash64("k"), F.col("chunks"))).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.withColumn("c", F.least("o", "p") * (1 << 20) + F.greatest("o", "p")).withColumn("role", F.expr("case when o = p then 3 when o < p then 1 else 2 end").cast("long"))
    return rows.repartition(where, "c").sortWithinPartitions(where, "c")


def near_copy_components(docs: DataFrame, shingle: int = NEAR_SHINGLE, hot: int = HOT, chunk: int = SET_CHUNK) -> DataFrame:
    """doc_id, t (hash of the text), component_id, kept of every row: components of the texts whose shingle sets have a Jaccard similarity of LEAST or more.

    kept is true for one document of each component, the first by id (null last) and then by t, and so for all rows that repeat it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    shape = "doc_id long, t long, k long, size long, s0 long, s1 long, s2 long, s3 long, d0 long, d1 long, d2 long, keys array<long>"
    prints = written(texts.select("doc_id", "t", "text").mapInArrow(_prints(shingle), shape), "near-prints")
    document = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    once = [F.first(c).alias(c) for c in ("size", *SKETCH, *TABLE, "keys")]
    classes = written(prints.groupBy("k").agg(F.min(document).alias("least"), F.min("t").alias("t"), *once), "near-classes")
    keyed = classes.select("k", F.explode("keys").alias("g")).select("*", F.expr("count(1) over (partition by g)").alias("n")).where("n > 1")
    keyed = _dealt(keyed.join(classes.select("k", "size", *SKETCH, *TABLE), "k"), F.ceil(F.col("n") / hot), "g")
    loose = keyed.select("g", "c", "role", "k", "size", *SKETCH, *TABLE).mapInArrow(_loose, "a long, b long")
    clusters = written(classes.select("k", "t", "size").join(connected_components(loose, "near-loose"), F.col("k") == F.col("node")).select("k", "t", "size", "root"), "near-clusters")
    clusters = clusters.join(clusters.groupBy("root").agg(F.sum("size").alias("total")), "root")
    needed = texts.select("t", "text").join(clusters.select("t"), "t", "left_semi").dropDuplicates(["t"])
    sets = needed.mapInArrow(_sets(shingle), "t long, shingles binary")
    members = _dealt(clusters.join(sets, "t"), F.ceil(F.col("total") / chunk), "root")
    links = members.select("root", "c", "role", "k", "shingles").mapInArrow(_verified, "a long, b long")
    roots = connected_components(links, "near-cc")
    labelled = classes.join(roots, F.col("k") == F.col("node"), "left").select("k", "least", F.coalesce("root", "k").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("first"))
    judged = prints.select("doc_id", "t", "k").join(labelled.join(named, "root").select("k", "first"), "k")
    return judged.select("doc_id", "t", F.col("first.doc_id").alias("component_id"), (document == F.col("first")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without the near-copies: of each component the document that near_copy_components keeps stays, with all rows that repeat it."""
    gone = near_copy_components(docs).where(~F.col("kept")).select("doc_id", "t").distinct().alias("g")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("g.t"))
    return docs.alias("d").join(gone, same, "left_anti")


def op1_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
