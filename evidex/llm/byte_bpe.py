"""Byte-level BPE encoding and decoding with segment trees.

A text is cut into matches of a pattern; each match is merged by itself. Over a match's byte positions stands a segment tree
whose leaf i holds (rank, i) of the pair that starts at the live token i and whose root is therefore the leftmost pair of
least rank. A merge takes the root, joins the two tokens and updates three leaves - the merged token's, its right part's, and
its live left neighbour's - up to the root, which is logarithmic. Matches of like length are merged side by side, one tree a
row of an array, so that numpy does the work of many trees at once; matches seen before come from a bounded cache.

A match of over LONG bytes has a tree of its own. All pairs of the least rank are found by one descent and merged together,
overlapping ones leftmost first, unless a merge would make a pair of lesser rank, which has to come before the rest: then only
the leftmost is merged. A match takes about 40 bytes of memory a byte while it is merged.

Odd input: null is the empty text, which has no ids; rows that repeat give repeated rows; texts of any length are encoded
whole; an empty table gives none; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evidex.llm.shared import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED = 400_000
CACHED_CHARS = 64
CELLS = 1 << 20
LONG = 4096
NONE = np.int64(1) << np.int64(62)


class Vocabulary:
    """Ranks of a file with lines of a base64 token and its rank."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        ranks = self.ranks
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.pairs = np.array([k for k, _ in pairs] + [NONE], np.int64)
        self.merged = np.array([r for _, r in pairs] + [0], np.int64)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def _merge(self, words: list[bytes], size: int) -> list[bytes]:
        """Ids (little-endian, 32 bits) of words of up to `size` bytes, a power of two."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(size)[None, :] < lengths[:, None]
        token = np.full((n, size + 1), -1, np.int64)
        token[:, :size][inside] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        live = np.zeros((n, size + 1), bool)
        live[:, :size] = inside
        tree = np.full((n, 2 * size), NONE, np.int64)
        paired = np.arange(size)[None, :] < lengths[:, None] - 1
        rows, at = np.nonzero(paired)
        rank = self._rank(token[rows, at], token[rows, at + 1])
        tree[rows, size + at] = np.where(rank < NONE, rank * size + at, NONE)
        for level in (1 << i for i in range(size.bit_length() - 2, -1, -1)):
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])

        def leaf(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = size + at
            tree[row, node] = value
            while size > 1 and node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.arange(n)
        while True:
            least = tree[row, 1]
            row = row[least < NONE]
            if not len(row):
                break
            least = least[least < NONE]
            at, rank = least % size, least // size
            right = after[row, at]
            end = after[row, right]
            token[row, at] = rank
            live[row, right] = False
            after[row, at] = end
            inner = end < lengths[row]
            before[row[inner], end[inner]] = at[inner]
            leaf(row, right, np.full(len(row), NONE))
            rank = self._rank(token[row, at], token[row, np.minimum(end, size)])
            leaf(row, at, np.where(inner & (rank < NONE), rank * size + at, NONE))
            has = before[row, at] >= 0
            if has.any():
                r, a = row[has], at[has]
                left = before[r, a]
                rank = self._rank(token[r, left], token[r, a])
                leaf(r, left, np.where(rank < NONE, rank * size + left, NONE))
        flat = token[live].astype("<u4")
        ends = np.cumsum(live.sum(axis=1)) * 4
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])), ends)]

    def _merge_long(self, word: bytes) -> bytes:
        """Ids of one long word."""
        n, size, none = len(word), 1 << (len(word) - 1).bit_length(), np.int32(np.iinfo(np.int32).max)
        token = np.full(size + 1, -1, np.int32)
        token[:n] = self.bytes[np.frombuffer(word, np.uint8)]
        after, before = np.arange(1, size + 2, dtype=np.int32), np.arange(-1, size, dtype=np.int32)
        live = np.zeros(size + 1, bool)
        live[:n] = True
        tree = np.full(2 * size, none, np.int32)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return np.minimum(self._rank(left.astype(np.int64), right.astype(np.int64)), none).astype(np.int32)

        tree[size : size + n - 1] = ranks(token[: n - 1], token[1:n])
        for level in (1 << i for i in range(size.bit_length() - 2, -1, -1)):
            np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2], out=tree[level : 2 * level])
        while (least := tree[1]) < none:
            node = np.ones(1, np.int64)
            while node[0] < size:
                below = (2 * node[:, None] + np.arange(2)).ravel()
                node = below[tree[below] == least]
            at = node - size
            # of pairs that overlap, each beginning at the right part of the one before, every other one
            place = np.arange(len(at))
            chained = np.append(False, after[at[:-1]] == at[1:])
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            while True:
                right = after[at]
                end = after[right]
                gone = before[at]
                inside = gone >= 0
                # a left neighbour that is the right part of another merged pair stands for that pair
                paired = np.zeros(len(at), bool)
                paired[1:] = right[:-1] == gone[1:]
                left = np.where(paired, before[gone], gone)
                made = np.where(inside, ranks(np.where(paired, least, token[gone]), np.full(len(at), least)), none)
                met = ranks(np.full(len(at), least), token[end])
                if len(at) == 1 or min(made.min(), met.min()) >= least:
                    break
                at = at[:1]
            token[at] = least
            live[right] = False
            after[at] = end
            before[end] = at
            tree[size + right] = none
            tree[size + at] = ranks(token[at], token[end])
            outer = inside & ~paired
            tree[size + left[outer]] = made[outer]
            node = np.unique(np.concatenate([right, at, left[outer]])).astype(np.int64) + size
            while node[0] > 1:
                node = node >> 1
                node = node[np.append(True, node[1:] != node[:-1])]
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
        return token[:n][live[:n]].astype("<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; a word that is a token by itself is that token."""
        out = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (rank := self.ranks.get(w)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = self._merge_long(w)
            else:
                classes.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        for size, members in classes.items():
            step = max(1, CELLS // (2 * size))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge([words[i] for i in part], size)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.find(t) for t in texts]
        fresh = list(set().union(*cut) - self.known.keys()) if cut else []
        if len(self.known) + len(fresh) > CACHED:
            self.known = {}
            fresh = list(set().union(*cut))
        known = dict(zip(fresh, self.merge([w.encode() for w in fresh])))
        self.known.update((w, ids) for w, ids in known.items() if len(w) <= CACHED_CHARS)
        if any(len(w) > CACHED_CHARS for w in fresh) or len(self.known) > CACHED:
            known = {**self.known, **known}
        else:
            known = self.known
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        if len(self.known) > CACHED:
            self.known = {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[bytes, Vocabulary] = {}


def loaded(content: bytes, pattern: str) -> Vocabulary:
    """One vocabulary for the life of a worker."""
    key = hashlib.sha256(content + pattern.encode()).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content, pattern)
    return _loaded[key]


def encoded(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, ids: bool = True, chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with `ids` the ids themselves (array<int>).

    vocabulary: path of a rank file on the driver; its content, fixed by the file, goes to the executors.
    chars: about so many characters are encoded at a time.
    """
    with open(vocabulary, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = loaded(content.value, pattern)
        for b in batches:
            rows = b.column(1)
            at = 0
            while at < len(rows):
                texts, held = [], 0
                while at < len(rows) and held < chars:
                    texts.append(rows[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                found = vocab.encode(texts)
                columns = [
                    b.column(0).slice(at - len(texts), len(texts)),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(vocab.decode(x)).hexdigest() for x in found]),
                ]
                if ids:
                    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, shape)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), ids=False)
