"""Merkle manifest of a dataset over a tree of SHA-256 midstates.

Every row is a leaf, hashed by Spark's own functions before anything is shuffled; rows of a group (a language) stand in the
order of their ids, and every `fan` consecutive nodes, given as hex text, hash to a parent, until a group has one node, its
subroot. The subroots, in the order of their groups, likewise give the root. A digest as hex text is one block of SHA-256,
so the state before each child slot of a parent is a whole number of blocks: parents keep a copy of it (eight words), and
folding a replaced leaf resumes that state with the replacement and the siblings to its right only. States are plain values,
hashed for many lanes at once in numpy, so that they lie in tables: another task resumes them, also after a lost executor.

How it is dealt: leaves are dealt by ranges of (group, id), so that a group that holds a third of all rows, or an id that does,
is many ranges; a row's place in its group is its place in its range plus the counts of the ranges before. Subtrees of
`fan ** k` <= 4,096 leaves are built and folded side by side, whole in a task. Their roots are the next pass's nodes, a 4,096th
of the rows, whose steps up to the root (state, siblings on the left, siblings on the right) come back to each subtree once.
A row carries its folded digest and the midstate of the hash of its siblings, never the siblings themselves unless asked for.

Odd input: nulls are fields of their own (`-`); a null group comes first, null ids come first in their group and count as the
empty text in the crc; rows that share group and id stand in the order of their leaf digests, so that equal rows give the same
digests in any order; texts of any length are hashed whole; an empty table gives none; columns other than the five fields are
not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidex.llm.shared import crc_remainder, table, written

SUBTREE = 4096
LANES = 16384
HELD = 1 << 15


def _root_bits(n: int, power: int) -> int:
    """The first 32 bits of the fraction of n ** (1 / power)."""
    wanted, low, high = n << 32 * power, 0, n << 32
    while low < high:
        middle = (low + high + 1) >> 1
        low, high = (middle, high) if middle**power <= wanted else (low, middle - 1)
    return low & 0xFFFFFFFF


PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, int(n**0.5) + 1))]
START = np.array([_root_bits(p, 2) for p in PRIMES[:8]], np.uint32)[:, None]
ROUND = [np.uint32(_root_bits(p, 3)) for p in PRIMES]
#: Two bytes as four hex characters, one word of a block.
HEX = np.frombuffer(b"".join(b"%04x" % i for i in range(1 << 16)), ">u4").astype(np.uint32)


def _compressed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x >> np.uint32(by) | x << np.uint32(32 - by)

    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            near, far = w[(i - 15) % 16], w[(i - 2) % 16]
            w[i % 16] = w[i % 16] + (turned(near, 7) ^ turned(near, 18) ^ near >> np.uint32(3)) + w[(i - 7) % 16] + (turned(far, 17) ^ turned(far, 19) ^ far >> np.uint32(10))
        first = h + (turned(e, 6) ^ turned(e, 11) ^ turned(e, 25)) + (g ^ e & (f ^ g)) + ROUND[i] + w[i % 16]
        second = (turned(a, 2) ^ turned(a, 13) ^ turned(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def compressed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) each."""
    n = state.shape[1]
    return np.concatenate([_compressed(state[:, k : k + LANES], block[:, k : k + LANES]) for k in range(0, n, LANES)] or [state], axis=1)


def fed(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """States after one more digest (8, n), as hex text."""
    block = np.empty((16, digest.shape[1]), np.uint32)
    block[0::2], block[1::2] = HEX[digest >> np.uint32(16)], HEX[digest & np.uint32(0xFFFF)]
    return compressed(state, block)


def ended(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The hash of a message of so many digests of which this is the state."""
    block = np.zeros((16, len(digests)), np.uint32)
    block[0], block[15] = 1 << 31, digests * 512
    return compressed(state, block)


def words(column: pa.Array) -> np.ndarray:
    """A column of 32 bytes a row as (8, n)."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(-1, 8).T


def as_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def as_column(state: np.ndarray) -> pa.Array:
    n = state.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * 32).tobytes()), pa.py_buffer(as_bytes(state).tobytes())])


def levels(n: int, fan: int) -> int:
    """Levels above n nodes."""
    found = 0
    while n > 1:
        n, found = -(-n // fan), found + 1
    return found


@dataclass
class Level:
    """One level of nodes, parents' children next to each other, and the state each parent had before each of them."""

    digest: np.ndarray
    before: np.ndarray
    first: np.ndarray  # of each node: its parent's first child
    slot: np.ndarray
    size: np.ndarray  # of each node: its parent's children
    above: np.ndarray  # of each node: its parent's place in the next level

    @classmethod
    def over(cls, group: np.ndarray, place: np.ndarray, digest: np.ndarray, fan: int) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray]:
        """The level and the next one's group, place and digest."""
        starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (place[1:] // fan != place[:-1] // fan)))
        size = np.diff(np.append(starts, len(group)))
        above = np.repeat(np.arange(len(starts)), size)
        before = np.empty_like(digest)
        state = np.repeat(START, len(starts), axis=1)
        for slot in range(int(size.max())):
            has = size > slot
            child = starts[has] + slot
            before[:, child] = state[:, has]
            state[:, has] = fed(state[:, has], digest[:, child])
        level = cls(digest, before, starts[above], np.arange(len(group)) - starts[above], size[above], above)
        return level, group[starts], place[starts] // fan, ended(state, size)

    def siblings(self, of: np.ndarray, right_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slot from left to right: which of the nodes `of` have another child there (or one to their right), and its digest."""
        for slot in range(int(self.size[of].max()) if len(of) else 0):
            has = (slot < self.size[of]) & ((slot > self.slot[of]) if right_only else (slot != self.slot[of]))
            yield has, self.digest[:, self.first[of[has]] + slot]

    def folded(self, of: np.ndarray, replacement: np.ndarray) -> np.ndarray:
        """The parent's digest for each of the nodes `of` with the replacement in its place."""
        state = fed(self.before[:, of], replacement)
        for has, digest in self.siblings(of, right_only=True):
            state[:, has] = fed(state[:, has], digest)
        return ended(state, self.size[of])


def climbed(group: np.ndarray, place: np.ndarray, digest: np.ndarray, todo: np.ndarray, fan: int) -> tuple[list[tuple[np.ndarray, np.ndarray, Level]], np.ndarray]:
    """The levels of subtrees, each with the nodes still climbing and where they stand in it, and each subtree's root.

    group: number of the subtree of each node, ascending from 0; todo: levels of each subtree.
    """
    nodes = at = np.arange(len(group))
    roots = np.empty((8, len(todo)), np.uint32)
    found: list[tuple[np.ndarray, np.ndarray, Level]] = []
    while True:
        goes = todo[group] > len(found)
        roots[:, group[~goes]] = digest[:, ~goes]
        if not goes.any():
            return found, roots
        still = goes[at]
        nodes, at = nodes[still], (np.cumsum(goes) - 1)[at[still]]
        level, group, place, digest = Level.over(group[goes], place[goes], digest[:, goes], fan)
        found.append((nodes, at, level))
        at = level.above[at]


def _by_subtree(make: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """make(rows, subtree number of each) over whole subtrees, about HELD rows at a time, of rows sorted by key and subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in _and_end(batches):
            if b is not None:
                held.append(b)
                if sum(map(len, held)) < HELD:
                    continue
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            key, subtree = rows["key"].chunk(0).dictionary_encode().indices.to_numpy(), rows["subtree"].to_numpy()
            number = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (subtree[1:] != subtree[:-1])))
            whole = len(rows) if b is None else int(np.searchsorted(number, number[-1]))
            if whole:
                yield from make(rows.slice(0, whole).combine_chunks(), number[:whole])
            held = rows.slice(whole).to_batches()

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if len(b))
    yield None


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.repartition("key", "subtree").sortWithinPartitions("key", "subtree", *order)


def _placed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with the column `place`, the number of rows of their key before them by `order`, and `n`, the number of rows of their key.

    Rows that agree in key and order are dealt as if they were different. The counts have a row for each key and range.
    """
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange("key", *order, "salt").sortWithinPartitions("key", *order).drop("salt")
    ranged = written(ranged.withColumn("row", F.monotonically_increasing_id()), name)
    part = F.shiftright("row", 33)
    counts = ranged.groupBy("key", part.alias("part")).agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("rows"))
    of_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("key", "part", (before - F.col("least")).alias("shift"), F.sum("rows").over(of_key).alias("n"))
    placed = ranged.withColumn("part", part).join(counts, ["key", "part"])
    return placed.withColumn("place", F.col("row") + F.col("shift")).drop("row", "shift", "part")


STEP = "struct<state: binary, left: binary, right: binary>"


def _climb(nodes: DataFrame, fan: int, high: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Of nodes (key, place, n, digest): (key, place, steps), the steps from each node to its key's root, and (key, digest), the roots."""
    span = fan**high

    def make(rows: pa.Table, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        n = rows["n"].to_numpy()[first]
        todo = np.array([min(high, levels(int(x), fan)) for x in n])
        found, roots = climbed(number, rows["place"].to_numpy(), words(rows["digest"]), todo, fan)
        steps: list[list[dict]] = [[] for _ in range(len(rows))]
        for nodes, at, level in found:
            states, digests = as_bytes(level.before), as_bytes(level.digest)
            for node, a in zip(nodes.tolist(), at.tolist()):
                begin, own, end = level.first[a], a, level.first[a] + level.size[a]
                steps[node].append({"state": states[a].tobytes(), "left": digests[begin:own].tobytes(), "right": digests[own + 1 : end].tobytes()})
        own = pa.array(steps, pa.list_(pa.struct([("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])))
        yield pa.RecordBatch.from_arrays([rows["key"].combine_chunks(), rows["place"].combine_chunks(), rows["n"].combine_chunks(), own, pa.nulls(len(rows), pa.binary())], names=SHAPE)
        at = pa.array(first)
        keys, places = rows["key"].take(at).combine_chunks(), rows["subtree"].take(at).combine_chunks()
        yield pa.RecordBatch.from_arrays([keys, places, pa.array(-(-n // span)), pa.nulls(len(first), own.type), as_column(roots)], names=SHAPE)

    SHAPE = ["key", "place", "n", "steps", "digest"]
    passes: list[DataFrame] = []
    while True:
        made = _dealt(nodes.selectExpr("key", "place", "n", "digest", f"place div {span} subtree"), "place").mapInArrow(_by_subtree(make), f"key string, place long, n long, steps array<{STEP}>, digest binary")
        made = written(made, name)
        passes.append(made.where("digest is null").select("key", "place", "steps"))
        nodes = made.where("digest is not null").select("key", "place", "n", "digest")
        if not nodes.where("n > 1").limit(1).count():
            break
    steps = passes.pop()
    while passes:
        upper = steps.select("key", F.col("place").alias("subtree"), F.col("steps").alias("more"))
        lower = passes.pop().withColumn("subtree", F.expr(f"place div {span}"))
        steps = lower.join(upper, ["key", "subtree"]).select("key", "place", F.concat("steps", "more").alias("steps"))
    return steps, nodes.select("key", "digest")


def field(column: Column) -> Column:
    """A field of a leaf: `-` if null, else the number of its UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hashed(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def manifest(rows: DataFrame, fan: int = 2, siblings: bool = False) -> DataFrame:
    """Of rows (group, id, leaf binary, replaced binary): id, group, leaf, subroot, root, proof, folded (all binary, of 32 bytes).

    proof: the hash of the siblings' digests as hex text from the leaf to the root. folded: the root with `replaced`, or where that
    is null the leaf itself, in the leaf's place. With `siblings` the digests themselves, joined, in a column of that name.
    """
    high = next(k for k in range(20, -1, -1) if fan**k <= SUBTREE) or 1
    span = fan**high
    # a key sorts as the group does, nulls first
    keyed = rows.select(F.coalesce(F.concat(F.lit("v"), F.col("group").cast("string")), F.lit("n")).alias("key"), "id", "leaf", "replaced")
    placed = _placed(written(keyed, "merkle-leaves"), "merkle-order", "id", "leaf")
    shape = ["kind", "key", "subtree", "n", "id", "leaf", "folded", "proof", "count", "siblings", "digest"]

    def build(table: pa.Table, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        n = table["n"].to_numpy()[first]
        leaf = words(table["leaf"])
        found, roots = climbed(number, table["place"].to_numpy(), leaf, np.array([min(high, levels(int(x), fan)) for x in n]), fan)
        replaced = table["replaced"].combine_chunks()
        folded = words(pc.coalesce(replaced, table["leaf"].combine_chunks()))
        proof, count = np.repeat(START, len(table), axis=1), np.zeros(len(table), np.int64)
        listed: list[bytes] = [b""] * len(table)
        for nodes, at, level in found:
            folded[:, nodes] = level.folded(at, folded[:, nodes])
            for has, digest in level.siblings(at, right_only=False):
                proof[:, nodes[has]] = fed(proof[:, nodes[has]], digest)
                count[nodes[has]] += 1
                if siblings:
                    for node, d in zip(nodes[has].tolist(), as_bytes(digest)):
                        listed[node] += d.tobytes()
        both = [table[c].combine_chunks() for c in ("key", "subtree", "n", "id", "leaf")]
        none = pa.nulls(len(table), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(table), np.int32)), *both, as_column(folded), as_column(proof), pa.array(count), pa.array(listed, pa.binary()) if siblings else none, none], names=shape)
        m, at = len(first), pa.array(first)
        gone = [pa.nulls(m, kind) for kind in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), table["key"].take(at).combine_chunks(), table["subtree"].take(at).combine_chunks(), pa.array(-(-n // span)), *gone, as_column(roots)], names=shape)

    types = "kind int, key string, subtree long, n long, id long, leaf binary, folded binary, proof binary, count long, siblings binary, digest binary"
    dealt = _dealt(placed.withColumn("subtree", F.expr(f"place div {span}")), "place")
    built = written(dealt.select("key", "subtree", "place", "n", "id", "leaf", "replaced").mapInArrow(_by_subtree(build), types), "merkle-subtrees")

    steps, subroots = _climb(built.where("kind = 0").select("key", F.col("subtree").alias("place"), "n", "digest"), fan, high, "merkle-nodes")
    groups = _placed(written(subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), "merkle-subroots"), "merkle-groups", "group")
    groups = written(groups, "merkle-groups-placed")
    upper, root = _climb(groups.select("key", "place", "n", "digest"), fan, high, "merkle-root")
    tops = groups.join(upper, ["key", "place"]).join(root.withColumnRenamed("digest", "root"), "key")
    tops = tops.select(F.col("group").alias("key"), F.col("digest").alias("subroot"), F.col("steps").alias("more"), "root")
    paths = steps.withColumnRenamed("place", "subtree").join(tops, "key").select("key", "subtree", F.concat("steps", "more").alias("steps"), "subroot", "root")

    def finish(table: pa.Table, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind = table["kind"].to_numpy()
        paths, leaves = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1)).combine_chunks()
        number = number[kind == 1]  # each subtree has one path, in the same order
        folded, proof, count = words(leaves["folded"]), words(leaves["proof"]), leaves["count"].to_numpy().copy()
        listed = leaves["siblings"].to_pylist() if siblings else []
        steps = paths["steps"].to_pylist()
        for k in range(max(map(len, steps))):
            goes = np.array([len(s) > k for s in steps])
            at = np.flatnonzero(goes[number])
            of = (np.cumsum(goes) - 1)[number[at]]
            here = [s[k] for s in steps if len(s) > k]
            # the parents' children: those to the left, the node itself (which is not looked at), those to the right
            slot, size = np.array([len(s["left"]) // 32 for s in here]), np.array([(len(s["left"]) + len(s["right"])) // 32 + 1 for s in here])
            digest = words(pa.array([s["left"] + bytes(32) + s["right"] for s in here], pa.binary()))
            first = np.cumsum(size) - size
            own = first + slot
            before = np.zeros_like(digest)
            before[:, own] = words(pa.array([s["state"] for s in here], pa.binary()))
            each = np.repeat(np.arange(len(here)), size)
            level = Level(digest, before, first[each], np.arange(len(each)) - first[each], size[each], each)
            folded[:, at] = level.folded(own[of], folded[:, at])
            for has, other in level.siblings(own[of], right_only=False):
                proof[:, at[has]] = fed(proof[:, at[has]], other)
                count[at[has]] += 1
                if siblings:
                    for node, d in zip(at[has].tolist(), as_bytes(other)):
                        listed[node] += d.tobytes()
        place = pa.array(number)
        columns = [leaves["key"], leaves["id"], leaves["leaf"], paths["subroot"].take(place), paths["root"].take(place)]
        columns = [c.combine_chunks() for c in columns] + [as_column(ended(proof, count)), as_column(folded)] + [pa.array(listed, pa.binary())] * siblings
        yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "leaf", "subroot", "root", "proof", "folded"] + ["siblings"] * siblings)

    kept = built.where("kind = 1").select("kind", "key", "subtree", "id", "leaf", "folded", "proof", "count", "siblings")
    met = _dealt(kept.unionByName(paths.withColumn("kind", F.lit(0)), allowMissingColumns=True), "kind")
    shape_out = "key string, id long, leaf binary, subroot binary, root binary, proof binary, folded binary" + ", siblings binary" * siblings
    out = met.mapInArrow(_by_subtree(finish), shape_out)
    return out.withColumn("group", F.expr("if(key = 'n', null, substr(key, 2))")).drop("key")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(group, id, leaf, replaced) of documents; replaced: the leaf with one more in n_chars, where 7 divides the crc32 of doc_id."""
    fields = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))

    def leaf(n_chars: Column) -> Column:
        return hashed(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    more = F.col("n_chars").cast("decimal(20,0)") + 1
    replaced = F.when(crc_remainder("doc_id", 7) == 0, leaf(more.cast("string")))
    return fields.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf(F.col("n_chars")).alias("leaf"), replaced.alias("replaced"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    def text(name: str) -> Column:
        return F.lower(F.hex(name))

    made = manifest(document_leaves(table(spark, sf_dir, "documents")))
    return made.select(
        F.col("id").alias("doc_id"),
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
