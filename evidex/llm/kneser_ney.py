"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped to score texts.

Tokens are words [^\\x20\\x09-\\x0D]+, lower-cased in A-Z, then one end; a text's first token follows a begin mark. With c the
count of a bigram, D(c) the discount of modified Kneser-Ney for counts 1, 2 and 3 or more, and N(c, u) how many words follow
u with such a count:

    P(w | u) = max(c(u w) - D(c), 0) / c(u) + (D1 N(1, u) + D2 N(2, u) + D3 N(3+, u)) / c(u) x P(w)

P(w) is the same over continuation counts (in how many contexts w occurs), with discounts of its own, and at its end the
uniform 1 / (V + 1). Unseen contexts give P(w).

Counting: tasks hash words to 64 bits, count a few million tokens at a time by sorting, and send packed runs of (context,
word, count), dealt by the context's hash; contexts with over 1 / HOT of all tokens (so fewer than HOT) are dealt by the whole
bigram. A bucket's runs are merged to sorted arrays and saved once in the shared folder, where a later task or a retry finds
them. Buckets hold about ROWS_A_BUCKET tokens, so their number grows with the text; they are shuffled as at most PARTS groups
of consecutive buckets, whose runs are cut by bucket and sorted by Spark, on disk where need be, in the task that merges them.
A 64-bit hash stands for a word or bigram; two share one with a chance of about n^2 / 2^65.

Storage: three files a bucket, of arrays one after another; workers map them and look up a batch's sorted hashes, so that
reads run forward. At most OPEN files are mapped at a time, those used longest ago are let go. Where a store can't be mapped,
files are read whole, and let go beyond KEPT bytes too.

Odd input: null is the empty text, of one token; without training rows every text has N = 0, V = 0 and base_score and score
are those of the empty model; rows that repeat count as often; other columns are not looked at.
"""

from __future__ import annotations

import io
import mmap
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.arrays import BASE, LOWER, mix, slices, word_hashes, words
from evidex.llm.shared import crc_remainder, new_path, table

TOKENS = 2_500_000
SCORED = 700_000
HOT = 512
ROWS_A_BUCKET = 1_500_000
PARTS = 4096
OPEN = 64
KEPT = 256 << 20
BEGIN = np.uint64(0x51ED270B7F3A4C15)
END = np.uint64(0xA24BAED4963EE407)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's tokens, an end after each text, and where each text's tokens begin (one more at the end)."""
    starts, ends, first = words(data, offsets)
    n = len(offsets) - 1
    bounds = first + np.arange(n + 1)
    out = np.full(bounds[-1], END)
    place = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
    out[place] = word_hashes(LOWER[data], starts, ends)
    return out, bounds


def contexts(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = BEGIN
    return before


def bigram_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * BASE + (word ^ (word << np.uint64(17) | word >> np.uint64(47))))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    change = np.ones(len(sorted_values), bool)
    change[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(change)


# files of arrays


def save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Written under another name and then moved, so that a file is whole or absent whichever attempt wrote it."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    body = io.BytesIO()
    for array in arrays:
        body.write(b"\0" * (-body.tell() % 64))
        np.save(body, array)
    other = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(other) as f:
        f.write(body.getbuffer())
    store.move(other, f"{path}/{name}.npy")


def load(folder: str, name: str) -> list[np.ndarray] | None:
    """The arrays of a file, if there is one: mapped to memory where the folder is mounted, read whole from other stores."""
    store, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}.npy"
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as f:
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with store.open_input_stream(path) as f:
            whole = io.BytesIO(f.read()).getbuffer()
    found, at = [], 0
    while at < len(whole):
        head = io.BytesIO(whole[at : at + 256])
        np.lib.format.read_magic(head)
        shape, _, kind = np.lib.format.read_array_header_1_0(head)
        found.append(np.frombuffer(whole, kind, int(np.prod(shape)), at + head.tell()).reshape(shape))
        at += head.tell() + found[-1].nbytes
        at += -at % 64
    return found


# counting


def _packed(columns: list[np.ndarray], bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns sorted by bucket, each bucket's part as one row: bucket, and each column's bytes."""
    at = runs(bucket)
    ends = np.append(at[1:], len(bucket))
    if len(at):
        parts = [pa.array([c[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), *parts], ["bucket", *"abcd"[: len(parts)]])


class Numbers:
    """How (hash, number) is packed in rows of a bucket."""

    shape = "bucket int, a binary, b binary"

    @staticmethod
    def pack(arrays: tuple[np.ndarray, ...], bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket, kind="stable")
        yield from _packed([c[order] for c in arrays], bucket[order])

    @staticmethod
    def unpack(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        return _view(rows[0], np.uint64), _view(rows[1], np.uint32)


class Followers:
    """How (context, word, number) is packed in rows of a bucket: contexts as their runs' starts, which pack well."""

    shape = "bucket int, a binary, b binary, c binary, d binary"

    @staticmethod
    def pack(arrays: tuple[np.ndarray, ...], bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        before, tokens, n = arrays
        order = np.lexsort((before, bucket))
        before, tokens, n, bucket = before[order], tokens[order], n[order], bucket[order]
        head = np.union1d(runs(before), runs(bucket))
        length = np.diff(np.append(head, len(before))).astype(np.uint32)
        cut, ends = runs(bucket), np.append(runs(bucket)[1:], len(bucket))
        rows = []
        for a, b in zip(cut, ends):
            i, j = np.searchsorted(head, (a, b))
            rows.append((int(bucket[a]), before[head[i:j]].tobytes(), length[i:j].tobytes(), tokens[a:b].tobytes(), n[a:b].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], ["bucket", *"abcd"])

    @staticmethod
    def unpack(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        return np.repeat(_view(rows[0], np.uint64), _view(rows[1], np.uint32)), _view(rows[2], np.uint64), _view(rows[3], np.uint32)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes and bounds of up to about TOKENS tokens at a time."""
    held, n = [], 0
    for b in batches:
        for _, _, data, offsets in slices(b.column(0)):
            held.append(token_hashes(data, offsets))
            n += len(held[-1][0])
            if n >= TOKENS:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0] + [len(t) for t, _ in held])
    bounds = [b[:-1] + e for (_, b), e in zip(held, ends)]
    return np.concatenate([t for t, _ in held]), np.append(np.concatenate(bounds), ends[-1])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


@dataclass
class Counts:
    """What scoring needs beside the arrays: all of fixed size."""

    folder: str
    buckets: int
    tokens: int = 0
    types: int = 0
    documents: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted, fewer than HOT + 2
    hot_follow: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(3))
    lower: np.ndarray = field(default_factory=lambda: np.zeros(3))
    lower_total: int = 0
    lower_follow: np.ndarray = field(default_factory=lambda: np.zeros(3))
    together: int = 1  # buckets that are shuffled as one

    def deal(self, context: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Bucket of bigrams: by context, or by the whole bigram for hot contexts."""
        if not len(self.hot):
            return _bucket(context, self.buckets)
        at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
        return _bucket(np.where(self.hot[at] == context, key, context), self.buckets)


def _merged(spread: DataFrame, kind: type[Numbers] | type[Followers], deal: Callable, shape: str, merge: Callable, buckets: int, together: int) -> list:
    """Every bucket's packed rows merged by merge(bucket, arrays), which saves arrays and returns a tuple of whole numbers.

    spread: rows of groups of `together` buckets; deal(arrays): each entry's bucket.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of groups as rows of buckets, about TOKENS entries at a time."""
        held, n = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns[1:])):
                held.append(row)
                n += len(row[-1]) // 4
                if n >= TOKENS:
                    arrays = kind.unpack(list(zip(*held)))
                    yield from kind.pack(arrays, deal(*arrays))
                    held, n = [], 0
        if held:
            arrays = kind.unpack(list(zip(*held)))
            yield from kind.pack(arrays, deal(*arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: int, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in merge(bucket, *kind.unpack(list(zip(*rows))))], names)

        last, rows = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != last and rows:
                    yield out(last, rows)
                    rows = []
                last = row[0]
                rows.append(row[1:])
        if rows:
            yield out(last, rows)

    # a group is a task: its number is the partition's
    dealt = spread.repartitionById(-(-buckets // together), "bucket")
    dealt = dealt.mapInArrow(cut, kind.shape) if together > 1 else dealt
    names = [x.split()[0] for x in shape.split(",")]
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, shape).agg(*[F.sum(n).alias(n) for n in names]).first()


def _discounts(n: np.ndarray) -> np.ndarray:
    """Of how many things have the counts 1, 2, 3, 4: discounts for 1, 2, and 3 or more; each within 0 and its count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(d, 0.05), c - 0.05) for d, c in zip(raw, (1, 2, 3))])


def _view(parts, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def count(docs: DataFrame, learn: Column, per_bucket: int = ROWS_A_BUCKET) -> Counts:
    """Counts the training rows of docs (doc_id, text) into arrays in the shared folder."""
    spark = docs.sparkSession
    texts = docs.where(learn).selectExpr("coalesce(cast(text as string), '') text")
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    out = Counts(new_path(spark, "kneser-ney"), max(4, int(size["chars"] // 6 // per_bucket) + 1), documents=size["n"])
    folder, buckets = out.folder, out.buckets
    together = out.together = -(-buckets // PARTS)
    every = spark.range(0, buckets, 1, -(-buckets // together))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _pieces(batches):
            tokens.sort()
            at = runs(tokens)
            n = np.diff(np.append(at, len(tokens))).astype(np.uint32)
            yield from _packed([tokens[at], n], _bucket(tokens[at], buckets) // np.uint64(together))

    def of_word(word: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _bucket(word, buckets)

    def merge_one(bucket: int, words_: np.ndarray, n: np.ndarray) -> tuple:
        order = np.argsort(words_)
        at = runs(words_[order])
        n = np.add.reduceat(n[order].astype(np.int64), at)
        save(folder, f"word-{bucket}", words_[order][at], n)
        return n.sum(), len(at)

    got = _merged(texts.mapInArrow(one, Numbers.shape), Numbers, of_word, "tokens long, types long", merge_one, buckets, together)
    out.tokens, out.types = int(got["tokens"] or 0), int(got["types"] or 0)
    if not out.tokens:
        return out
    least = out.tokens // HOT

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket in b.column(0).to_pylist():
                if found := load(folder, f"word-{bucket}"):
                    word, n = found
                    yield pa.RecordBatch.from_arrays([pa.array(word[n > least].view(np.int64))], ["word"])

    # fewer than HOT words can have over 1 / HOT of all tokens, so this is bounded
    hot = [r["word"] for r in every.mapInArrow(frequent, "word long").collect()]
    out.hot = np.unique(np.append(np.array(hot, np.int64).view(np.uint64), BEGIN))

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, bounds in _pieces(batches):
            before = contexts(tokens, bounds)
            key = bigram_hash(before, tokens)
            order = np.argsort(key)
            at = runs(key[order])
            n = np.diff(np.append(at, len(key))).astype(np.uint32)
            pick = order[at]
            before, tokens, key = before[pick], tokens[pick], key[pick]
            yield from Followers.pack((before, tokens, n), out.deal(before, key) // np.uint64(together))

    def of_pair(before: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
        return out.deal(before, bigram_hash(before, after))

    def merge_two(bucket: int, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> tuple:
        key = bigram_hash(before, after)
        order = np.argsort(key)
        at = runs(key[order])
        n = np.add.reduceat(n[order].astype(np.int64), at)
        key, small, big = key[order][at], np.minimum(n, 255).astype(np.uint8), np.flatnonzero(n >= 255)
        big = np.stack([big, n[big]])
        before, after = before[order][at], after[order][at]
        order = np.argsort(before)
        head = runs(before[order])
        follow = np.stack([np.add.reduceat((n[order] == 1).astype(np.int64), head), np.add.reduceat((n[order] == 2).astype(np.int64), head), np.add.reduceat((n[order] >= 3).astype(np.int64), head)], axis=1)
        save(folder, f"pair-{bucket}", key, small, big, before[order][head], follow.astype(np.int32 if len(n) < 1 << 31 else np.int64))
        after = np.sort(after)
        head = runs(after)
        save(folder, f"after-{bucket}", after[head], np.diff(np.append(head, len(after))).astype(np.uint32))
        return tuple((n == k).sum() for k in (1, 2, 3, 4)) + (len(n),)

    got = _merged(texts.mapInArrow(two, Followers.shape), Followers, of_pair, "n1 long, n2 long, n3 long, n4 long, n long", merge_two, buckets, together)
    out.discounts = _discounts([got[f"n{k}"] for k in (1, 2, 3, 4)])
    out.lower_total = int(got["n"])

    def three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket in b.column(0).to_pylist():
                if found := load(folder, f"after-{bucket}"):
                    yield from _packed(found, _bucket(found[0], buckets) // np.uint64(together))

    def merge_three(bucket: int, after: np.ndarray, n: np.ndarray) -> tuple:
        order = np.argsort(after)
        at = runs(after[order])
        n = np.add.reduceat(n[order].astype(np.int64), at)
        # every token has a context, so these are the bucket's words, in the same order
        save(folder, f"continuation-{bucket}", n)
        return tuple((n == k).sum() for k in (1, 2, 3, 4)) + ((n >= 3).sum(),)

    got = _merged(every.mapInArrow(three, Numbers.shape), Numbers, of_word, "n1 long, n2 long, n3 long, n4 long, more long", merge_three, buckets, together)
    out.lower = _discounts([got[f"n{k}"] for k in (1, 2, 3, 4)])
    out.lower_follow = np.array([got["n1"], got["n2"], got["more"]], float)

    def hot_follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket in b.column(0).to_pylist():
                if found := load(folder, f"pair-{bucket}"):
                    context, f = found[3:]
                    at = np.isin(context, out.hot)
                    f = f[at]
                    yield pa.RecordBatch.from_arrays([pa.array(context[at].view(np.int64)), *(pa.array(f[:, k].astype(np.int64)) for k in range(3))], ["u", "n1", "n2", "n3"])

    # at most HOT + 1 contexts after the sum
    found = {r["u"] & (1 << 64) - 1: r for r in every.mapInArrow(hot_follow, "u long, n1 long, n2 long, n3 long").groupBy("u").agg(*[F.sum(k).alias(k) for k in ("n1", "n2", "n3")]).collect()}
    out.hot_follow = np.array([[found[int(u)][k] for k in ("n1", "n2", "n3")] if int(u) in found else [0, 0, 0] for u in out.hot], float)
    return out


# scoring


class Model:
    """Looks up batches of hashes in the mapped arrays of one set of counts."""

    def __init__(self, counts: Counts, kept: int = KEPT, most: int | None = None):
        self.c, self.kept, self.held, self.most = counts, kept, 0, most or OPEN
        self.open: OrderedDict[str, list[np.ndarray] | None] = OrderedDict()
        self.mapped = isinstance(fs.FileSystem.from_uri(counts.folder)[0], fs.LocalFileSystem)

    def _arrays(self, name: str) -> list[np.ndarray] | None:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        found = self.open[name] = load(self.c.folder, name)
        self.held += self._size(found)
        while (self.held > self.kept or len(self.open) > self.most) and len(self.open) > 1:
            self.held -= self._size(self.open.popitem(last=False)[1])
        return found

    def _size(self, arrays: list[np.ndarray] | None) -> int:
        """Bytes of memory; mapped files take none of their own."""
        return 0 if self.mapped else sum(a.nbytes for a in arrays or [])

    def _find(self, name: str, column: int, hashes: np.ndarray, bucket: np.ndarray, values: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For hashes sorted by bucket and value: positions of those found, and values(bucket, arrays of its file, their rows)."""
        at = runs(bucket)
        for a, b in zip(at, np.append(at[1:], len(bucket))):
            arrays = self._arrays(f"{name}-{bucket[a]}")
            if arrays is None or not len(keys := arrays[column]):
                continue
            row = np.searchsorted(keys, hashes[a:b])
            hit = np.flatnonzero(keys[np.minimum(row, len(keys) - 1)] == hashes[a:b])
            yield a + hit, values(int(bucket[a]), arrays, row[hit])

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted distinct words: count, lower-order probability, and what follows (three columns)."""
        c, n = self.c, len(hashes)
        count, cont, follow = np.zeros(n), np.zeros(n), np.zeros((n, 3))
        bucket = _bucket(hashes, c.buckets)
        for at, (x, y) in self._find("word", 0, hashes, bucket, lambda b, arrays, r: (arrays[1][r], self._arrays(f"continuation-{b}")[0][r])):
            count[at], cont[at] = x, y
        for at, x in self._find("pair", 3, hashes, bucket, lambda b, arrays, r: arrays[4][r]):
            follow[at] = x
        if len(c.hot):
            at = np.minimum(np.searchsorted(c.hot, hashes), len(c.hot) - 1)
            hot = c.hot[at] == hashes
            follow[hot] = c.hot_follow[at[hot]]
        count[hashes == BEGIN] = c.documents
        uniform = 1 / (c.types + 1)
        if not c.lower_total:
            return count, np.full(n, uniform), follow
        discount = np.where(cont > 0, c.lower[np.clip(cont, 1, 3).astype(int) - 1], 0)
        lower = np.maximum(cont - discount, 0) / c.lower_total + (c.lower * c.lower_follow).sum() / c.lower_total * uniform
        return count, lower, follow

    def bigrams(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Counts of bigrams sorted by bucket and key."""
        out = np.zeros(len(key), np.int64)

        def values(b: int, arrays: list[np.ndarray], r: np.ndarray) -> np.ndarray:
            _, small, big, *_ = arrays
            n = small[r].astype(np.int64)
            over = n == 255
            n[over] = big[1][np.searchsorted(big[0], r[over])]
            return n

        for at, x in self._find("pair", 0, key, bucket, values):
            out[at] = x
        return out

    def score(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text."""
        c = self.c
        distinct, back = np.unique(np.append(tokens, BEGIN), return_inverse=True)
        count, lower, follow = self.words(distinct)
        w = back[:-1]
        u = np.empty_like(w)
        u[1:] = w[:-1]
        u[bounds[:-1]] = back[-1]
        pair = u.astype(np.int64) * len(distinct) + w
        order = np.argsort(pair)
        at = runs(pair[order])
        one = order[at]
        pu, pw = u[one], w[one]
        key = bigram_hash(distinct[pu], distinct[pw])
        bucket = c.deal(distinct[pu], key)
        sort = np.lexsort((key, bucket))
        n = np.empty(len(key), np.int64)
        n[sort] = self.bigrams(key[sort], bucket[sort])
        total = count[pu]
        seen = np.maximum(total, 1)
        discount = np.where(n > 0, c.discounts[np.clip(n, 1, 3) - 1], 0)
        p = np.where(total > 0, np.maximum(n - discount, 0) / seen + (follow[pu] @ c.discounts) / seen * lower[pw], lower[pw])
        logs = np.empty(len(tokens))
        logs[order] = np.repeat(np.log10(np.maximum(p, 1e-300)), np.diff(np.append(at, len(pair))))
        base = np.log10((count + 0.5) / (c.tokens + 0.5 * (c.types + 1)))
        return tuple(np.add.reduceat(x, bounds[:-1]) for x in ((count[w] > 0).astype(np.int64), base[w], logs))


def scored(docs: DataFrame, counts: Counts) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts)

        def out(held: list, ids: list) -> pa.RecordBatch:
            tokens, bounds = _joined(held)
            known, base, score = model.score(tokens, bounds)
            n = np.diff(bounds)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(n), pa.array(known), pa.array(np.full(len(n), counts.tokens)), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        held, ids, n = [], [], 0
        for b in batches:
            for i, j, data, offsets in slices(b.column(1)):
                held.append(token_hashes(data, offsets))
                ids.append(b.column(0).slice(i, j - i))
                n += len(held[-1][0])
                if n >= SCORED:
                    yield out(held, ids)
                    held, ids, n = [], [], 0
        if held:
            yield out(held, ids)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", 5) == 1
    return scored(docs, count(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
