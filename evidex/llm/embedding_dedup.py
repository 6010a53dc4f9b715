"""Near-duplicate vectors by product quantisation with coarse inverted lists and exact cosine rerank.

Fit, on a bounded sample (SAMPLE_A_LIST distinct vectors a list, within SAMPLE, those with the least hash) and in one task:
LISTS_A_ROOT x sqrt(n) coarse centres, at most MOST_LISTS (reached at 30 million vectors), and in each of SUBSPACES subspaces
CODES centres of the residuals. Every vector is then indexed: its nearest centre's list, a code per subspace, and the length of
what the code leaves out.

Search: each vector probes the lists that may hold a vector within the radius sqrt(2 - 2 x 0.9) of it: with centre distances a
to the nearest and b to another, a neighbour can only lie there if (b^2 - a^2) / (2 |difference of the centres|) is at most the
radius (always safe), and is taken to if it is at most SIGMAS standard deviations of a random offset of that length. In a
list, table lookups give the distance from the vector to each code, and what is left out bounds how far it can be wrong, so no
pair found in a probed list is lost. Survivors are judged by exact cosine in double precision; where the lookups leave over
LEFT of the pairs, products of blocks in single precision, less their rounding, choose what is judged instead. A pair is found
if either vector probes the other's list. Probes carry the vector itself: how many links a vector has is counted where its list
is, so that a group of many near-copies is never written out as pairs.

Where the threshold is so low that vectors probe half of the lists or more, a probe a list would write each vector as often as
there are lists, which grows as n to 1.5. Vectors are then dealt by hash to SHELVES shelves (more if SHELF components would not
hold one), each vector is sent to its own shelf and half of the others, and every pair of shelves meets in one of them: all
pairs are compared, each once, and a vector is written SHELVES / 2 + SALTS times. Comparing is quadratic, memory is not.

Equal vectors are one from the start, weighted by their number, and tasks emit sums and links that join parts, so output is
linear. A long list is cut in CHUNK parts and its probing vectors are dealt to several tasks; none is dropped.

Odd input: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths never link; null ids take part and a component's id is its smallest id that is not null; rows that repeat count as
vectors of their own; an empty table gives none; label and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.arrays import Links, mix
from evidex.llm.shared import connected_components, in_one_task, table, written

LEAST = 0.9
SAMPLE = (20_000, 131_072)
SAMPLE_A_LIST = 8
LISTS_A_ROOT = 3
MOST_LISTS = 16_384
SUBSPACES = 16
CODES = 64
SIGMAS = 3.0
CHUNK = 4096
BATCH = 1024
#: Share of the pairs that lookups may leave.
LEFT = 1 / 32
#: Where vectors probe half of the lists: shelves (odd) and tasks a shelf, at least, and components of a shelf's vectors, at most.
SHELVES, SALTS = 17, 4
SHELF = 1 << 22


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, and the squared distances to it."""
    step = max(1, (1 << 22) // len(centres))
    own, far = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    norm = (centres**2).sum(axis=1)
    for i in range(0, len(x), step):
        d = norm - 2 * (x[i : i + step] @ centres.T)
        own[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = d.min(axis=1) + (x[i : i + step] ** 2).sum(axis=1)
    return own, np.maximum(far, 0)


class Index:
    """Coarse centres and residual codebooks of unit vectors of one length; its size is bounded by the constants above."""

    def __init__(self, sample: np.ndarray, lists: int, least: float, sigmas: float = SIGMAS):
        rng = np.random.default_rng(7)
        sample = sample.astype(np.float32)
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-3
        self.least, self.dim = least, sample.shape[1]
        self.centres = kmeans(sample, lists, rng)
        rest = sample - self.centres[nearest(sample, self.centres)[0]]
        self.parts = [p for p in np.array_split(np.arange(self.dim), SUBSPACES) if len(p)]
        self.books = [kmeans(rest[:, p], CODES, rng, 6) for p in self.parts]
        self.norm = (self.centres**2).sum(axis=1)
        self.reach = 2 * self.radius * min(1.0, sigmas / np.sqrt(self.dim))

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors (float32): list, and which lists each probes."""
        d = self.norm - 2 * (x @ self.centres.T)
        own = d.argmin(axis=1)
        gap = np.sqrt(np.maximum(self.norm[own][:, None] + self.norm - 2 * self.centres[own] @ self.centres.T, 0))
        return own, d - d[np.arange(len(x)), own][:, None] <= self.reach * gap + 1e-4

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors (float32): list, codes, the decoded residual's fixed term, length left out, and which lists each probes."""
        own, probes = self.probed(x)
        rest = x - self.centres[own]
        codes = np.stack([nearest(rest[:, p], b)[0] for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        decoded = self.decode(codes)
        fixed = 2 * (self.centres[own] * decoded).sum(axis=1) + (decoded**2).sum(axis=1)
        return own, codes, fixed, np.sqrt(((rest - decoded) ** 2).sum(axis=1)), probes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self.dim), np.float32)
        for k, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, p] = b[codes[:, k]]
        return out

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of each vector's parts with every code: (vector, subspace x CODES)."""
        out = np.zeros((len(x), len(self.parts), CODES), np.float32)
        for k, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, k, : len(b)] = x[:, p] @ b.T
        return out.reshape(len(x), -1)

    def close(self, x: np.ndarray, tables: np.ndarray, own: np.ndarray, codes: np.ndarray, fixed: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (vector, member) that may lie within the radius. own: the members' lists."""
        lists, at = np.unique(own, return_inverse=True)
        coarse = (x**2).sum(axis=1)[:, None] + self.norm[lists] - 2 * (x @ self.centres[lists].T)
        flat = codes.astype(np.int64) + np.arange(codes.shape[1]) * CODES
        far = coarse[:, at] + fixed[None, :]
        for k in range(codes.shape[1]):
            far -= 2 * tables[:, flat[:, k]]
        return np.nonzero(far <= (self.radius + left[None, :] + 1e-3) ** 2)

    def alike(self, x: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (vector, member) whose cosine may reach the threshold, by products whose rounding is allowed for."""
        least = np.float32(self.least - 1e-6 - (self.dim + 2) * 2.0**-23)
        return np.divmod(np.flatnonzero((x @ members.T).ravel() >= least), len(members))


def _doubles(raw: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled by their largest component first, so that no square vanishes or overflows."""
    x = raw.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, numbers of copies and components of up to BATCH vectors of rows (k, n, embedding) at a time."""
    for b in batches:
        for i in range(0, len(b), BATCH):
            part = b.slice(i, BATCH)
            yield part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), part.column(2).flatten().to_numpy(zero_copy_only=False)


def _sizes(held):
    """For mapInArrow: how many vectors each list gets, and how many lists they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        total, probing = np.zeros((2, len(index.centres)), np.int64)
        for _, _, raw in _vectors(batches):
            own, probes = index.probed(_doubles(raw, index.dim).astype(np.float32))
            np.add.at(total, own, 1)
            np.add.at(probing, own, probes.sum(axis=1))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some]), pa.array(probing[some])], ["list", "size", "probes"])

    return run


def _turn(k: np.ndarray) -> np.ndarray:
    return (mix(k.view(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _rows(held, parts: np.ndarray, shelves: int = 0, salts: int = 1):
    """For mapInArrow: vectors packed by where they are searched. parts: into how many parts each list is cut.

    A member of a list (role 0) stands in one part and is sent to the tasks of every salt; a vector that probes the list (role
    1) has one salt and is sent to every part. With shelves (an odd number), a list is a shelf, and vectors probe their own
    shelf and as many of the next, in a circle, as half of the others are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for k, n, raw in _vectors(batches):
            x = _doubles(raw, index.dim).astype(np.float32)
            own, codes, fixed, left, probes = index.place(x)
            bits = np.packbits(probes, axis=1, bitorder="little") if not shelves else np.zeros((len(k), 0), np.uint8)
            tail = np.stack([fixed, left], axis=1).astype(np.float32)
            components = np.ascontiguousarray(raw).reshape(-1, index.dim)
            turn, every = _turn(k), np.arange(len(k))
            if shelves:
                home, step = turn % shelves, (shelves + 1) // 2
                cut, salted = np.ones(shelves, np.int64), np.full(shelves, salts)
                sent = (0, every, home), (1, every.repeat(step), (home.repeat(step) + np.tile(np.arange(step), len(k))) % shelves)
                turn = turn // shelves
            else:
                cut, salted = parts, parts
                sent = (0, every, own), (1, *np.nonzero(probes))
            out = []
            for role, r, l in sent:
                # copies: to every salt, or to every part
                copies = (salted if role == 0 else cut)[l]
                r, l = np.repeat(r, copies), np.repeat(l, copies)
                turned = np.arange(len(l)) - np.repeat(np.cumsum(copies) - copies, copies)
                part, salt = (turn[r] % cut[l], turned) if role == 0 else (turned, turn[r] % salted[l])
                order = np.lexsort((salt, part, l))
                r, l, part, salt = r[order], l[order], part[order], salt[order]
                ends = np.flatnonzero(np.append(True, (l[1:] != l[:-1]) | (part[1:] != part[:-1]) | (salt[1:] != salt[:-1]))) if len(l) else []
                for a, b in zip(ends, np.append(ends[1:], len(l))):
                    w = r[a:b]
                    more = (codes[w].tobytes(), tail[w].tobytes(), bits[w].tobytes()) if role == 0 else (None, None, None)
                    out.append((int(l[a]), int(part[a]), int(salt[a]), role, k[w].tobytes(), n[w].tobytes(), own[w].tobytes(), components[w].tobytes(), *more))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 7)], ["list", "part", "salt", "role", *"knoxctb"])

    return run


class _Members:
    """The members of a list's part, or of a shelf, against which vectors are held; sums up what links with them."""

    def __init__(self, index: Index, kind: str, rows: list[tuple], shelves: int):
        self.index, self.kind, self.shelves = index, kind, shelves
        self.k, self.n, self.own, self.x = self._joined(rows)
        whole = lambda i, t: np.frombuffer(b"".join(r[i] for r in rows), t).reshape(len(self.k), -1)
        self.codes, self.tail, self.bits = whole(8, np.uint8), whole(9, np.float32), whole(10, np.uint8)
        self.x32 = self.x.astype(np.float32)
        self.copies, self.links = np.zeros(len(self.k), np.int64), Links(len(self.k))
        self.looked, self.left = 0, 0

    def _joined(self, rows: list[tuple]) -> list[np.ndarray]:
        whole = lambda i, t: np.frombuffer(b"".join(r[i] for r in rows), t)
        return [*(whole(i, np.int64) for i in (4, 5, 6)), _doubles(whole(7, self.kind), self.index.dim)]

    def _near(self, x: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (vector, member) to be judged."""
        if self.looked < 1 << 16 or self.left < LEFT * self.looked:
            a, b = self.index.close(x, self.index.tables(x), self.own[at], self.codes[at], self.tail[at, 0], self.tail[at, 1])
            self.looked, self.left = self.looked + len(x) * len(self.own[at]), self.left + len(a)
            if self.looked < 1 << 16 or self.left < LEFT * self.looked:
                return a, b
        return self.index.alike(x, self.x32[at])

    def searched(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Vectors (role 1) held against all members: their sums of linked copies, and spanning links."""
        k, n, own, x = self._joined(rows)
        x32, copies, first = x.astype(np.float32), np.zeros(len(k), np.int64), np.full(len(k), -1)
        here = _turn(k) % self.shelves == _turn(self.k[:1]) % self.shelves if self.shelves else None
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, (1 << 22) // self.index.dim)
        for i in range(0, len(self.k), CHUNK):
            a, b = self._near(x32, slice(i, i + CHUNK))
            b = b + i
            a, b = a[k[a] != self.k[b]], b[k[a] != self.k[b]]
            good = np.concatenate([np.einsum("ij,ij->i", x[a[j : j + step]], self.x[b[j : j + step]]) >= self.index.least for j in range(0, len(a), step)] or [np.zeros(0, bool)])
            a, b = a[good], b[good]
            if not len(a):
                continue
            # if the member probes the vector's list too, it finds the pair there, and counts for itself
            both = here[a] if self.shelves else (self.bits[b, own[a] >> 3] >> (own[a] & 7)) & 1 > 0
            copies += np.bincount(a, self.n[b], len(k)).astype(np.int64)
            self.copies += np.bincount(b[~both], n[a[~both]], len(self.k)).astype(np.int64)
            new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            new = new[first[a[new]] < 0]
            first[a[new]] = b[new]
            # members that one vector links are joined by the members that stand for their parts
            for j in range(0, len(a), 65536):
                one, other = self.links.parent[first[a[j : j + 65536]]], self.links.parent[b[j : j + 65536]]
                keep = self.links.add(one, other)
                ends.append((self.k[one[keep]], self.k[other[keep]]))
        if linked := np.flatnonzero(first >= 0).tolist():
            ends.append((k[linked], self.k[self.links.parent[first[linked]]]))
            yield _found(k[linked], None, copies[linked])
            yield _found(*map(np.concatenate, zip(*ends)), np.zeros(sum(len(e) for e, _ in ends), np.int64))

    def summed(self) -> Iterator[pa.RecordBatch]:
        if (some := np.flatnonzero(self.copies)).size:
            yield _found(self.k[some], None, self.copies[some])


def _found(k: np.ndarray, other: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.int64()) if other is None else pa.array(other), pa.array(n)], ["k", "other", "n"])


def _search(held, kind: str, shelves: int = 0):
    """For mapInArrow over packed rows sorted by (list, part, salt, role): sums of linked copies, and spanning links, as (k, other, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, group in groupby(rows, lambda row: row[:3]):
            members, own, waiting, n = [], None, [], 0
            for row in group:
                if row[3] == 0:
                    members.append(row)
                    continue
                if not members and own is None:
                    continue
                if own is None:
                    own, members = _Members(index, kind, members, shelves), []
                waiting.append(row)
                n += len(row[4]) // 8
                if n >= BATCH:
                    yield from own.searched(waiting)
                    waiting, n = [], 0
            if waiting:
                yield from own.searched(waiting)
            if own is not None:
                yield from own.summed()

    return run


def _one_length(vectors: DataFrame, dim: int, least: float, sigmas: float) -> DataFrame:
    """k, other, n of the distinct vectors (k, n, embedding) of one length."""
    spark = vectors.sparkSession
    n = vectors.count()
    lists = int(min(MOST_LISTS, max(1, LISTS_A_ROOT * np.sqrt(n))))
    # SAMPLE rows at most; the index is of MOST_LISTS centres at most
    sample = vectors.select(F.xxhash64("k").alias("o"), "k", "embedding").orderBy("o", "k").limit(min(max(SAMPLE[0], SAMPLE_A_LIST * lists), SAMPLE[1]))
    held = spark.sparkContext.broadcast(in_one_task(sample, lambda r: Index(_doubles(np.array([v for *_, v in r]), dim), lists, least, sigmas)))
    rows = vectors.select("k", "n", "embedding")
    # MOST_LISTS rows at most
    sizes = rows.mapInArrow(_sizes(held), "list int, size long, probes long").groupBy("list").agg(F.sum("size").alias("size"), F.sum("probes").alias("probes")).collect()
    parts = np.ones(len(held.value.centres), np.int64)
    for r in sizes:
        parts[r["list"]] = -(-r["size"] // CHUNK)
    shelves, salts = 0, 1
    if 2 * sum(r["probes"] for r in sizes) >= n * len(parts):
        shelves = max(SHELVES, -(-n * dim // SHELF)) | 1
        salts = max(SALTS, shelves // 4)
    packed = rows.mapInArrow(_rows(held, parts, shelves, salts), "list int, part long, salt long, role int, k binary, n binary, o binary, x binary, c binary, t binary, b binary")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    where = ("list", "part", "salt")
    return packed.repartition(*where).sortWithinPartitions(*where, "role").mapInArrow(_search(held, kind, shelves), "k long, other long, n long")


def embedding_components(vectors: DataFrame, least: float = LEAST, sigmas: float = SIGMAS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    numbers = F.transform(e, lambda v: v.cast(kind))
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(numbers, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), numbers).alias("embedding")).withColumn("k", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    rows = written(rows, "pq-rows")
    distinct = written(rows.where("k is not null").groupBy("k").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("embedding").alias("embedding")), "pq-distinct")
    found = spark.createDataFrame([], "k long, other long, n long")
    for dim in sorted(r["d"] for r in distinct.select(F.size("embedding").alias("d")).distinct().collect()):
        found = found.unionByName(_one_length(distinct.where(F.size("embedding") == dim), dim, least, sigmas))
    found = written(found, "pq-found")
    linked = found.where("other is null").groupBy("k").agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("other is not null").select(F.col("k").alias("a"), F.col("other").alias("b")), "pq-cc")
    classes = distinct.select("k", "least", "n").join(linked, "k", "left").join(roots, F.col("k") == F.col("node"), "left").select("k", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "k").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.select("vec_id", "k").join(classes.join(named, "root").select("k", "n_links", "component_id"), "k", "left")
    component = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


#: Few tables hold vectors that are alike; at this threshold all do, and every probe is the always safe one: there, of every list.
LOOSE = 0.4


def embedding_links_loose(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine LOOSE."""
    return embedding_components(table(spark, sf_dir, "embeddings"), LOOSE, sigmas=float("inf"))


_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) {least}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = v.vec_id
"""
OP7_SQL = _SQL.replace("{least}", f">= {LEAST}")
LOOSE_SQL = _SQL.replace("{least}", f">= {LOOSE}")
