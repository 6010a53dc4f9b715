"""SentencePiece encoding and decoding with BPE models, by vectorised merge rounds.

A text becomes the model's normalised form (a word mark for each space and one before the text) and is cut into words: before
a mark that follows something else, and wherever two characters meet that no piece holds side by side, since no merge can
cross there. The characters of many words lie in one flat array of symbols. A round finds the best rank of a pair in each word
(a segmented minimum over the ranks of all neighbours), merges every pair of that rank at once, overlapping ones leftmost
first, and closes the gaps; only pairs beside a merge are looked up again. A word without a pair of known rank leaves the
arrays, and rounds go on until none is left. Where a merge in a word would make a pair that comes before the rest, only the
leftmost is merged in that round. Words seen before come from a bounded cache.

Of a round the work is the symbols still in play, so a word of n symbols takes n times its number of distinct ranks at most.

Models: BPE with the identity as normaliser, with or without byte fallback, no user-defined or unused pieces; others raise
ValueError. Odd input: null is the empty text, whose ids are the begin and end ids alone; rows that repeat give repeated
rows; texts of any length are encoded whole; an empty table gives none; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from evidex.llm.shared import table

MODEL = "piece_bpe_32k.model"
CACHED = 400_000
CACHED_CHARS = 64
NONE = np.int32(np.iinfo(np.int32).max)
MARK = "▁"

# fixed values of the model file: numbers of its fields, and kinds of pieces
PIECES, TRAINER, NORMALISER = 1, 2, 3
TEXT, SCORE, KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, UNKNOWN_ID, BEGIN_ID, END_ID, UNKNOWN_SURFACE = 3, 35, 40, 41, 42, 44
CHARS_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPES, SUFFIX_MARK = 2, 3, 4, 5, 24
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2

codecs.register_error("evidex.each_byte", lambda e: ("�", e.start + 1))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            value: int | bytes = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    def __init__(self, content: bytes):
        found = list(_fields(content))
        trainer = dict(_fields(dict(found).get(TRAINER, b"")))
        normaliser = dict(_fields(dict(found).get(NORMALISER, b"")))
        pieces = [dict(_fields(value)) for number, value in found if number == PIECES]
        texts = [p[TEXT].decode() for p in pieces]
        kinds = [p.get(KIND, NORMAL) for p in pieces]
        if trainer.get(MODEL_TYPE, 1) != BPE or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(SUFFIX_MARK, 0):
            raise ValueError("only BPE models of normal, unknown, control and byte pieces are known here")
        if normaliser.get(CHARS_MAP) or normaliser.get(EXTRA_SPACES, 1) or not normaliser.get(ESCAPES, 1):
            raise ValueError("only models with the identity as normaliser are known here")
        self.prefix = MARK if normaliser.get(DUMMY_PREFIX, 1) else ""
        self.unknown = trainer.get(UNKNOWN_ID, 0)
        self.begin, self.end = trainer.get(BEGIN_ID, 1), trainer.get(END_ID, 2)
        self.bytes = [0] * 256 if trainer.get(BYTE_FALLBACK) else None
        self.surface: list[bytes] = []
        for i, (text, kind) in enumerate(zip(texts, kinds)):
            if kind == BYTE:
                value = int(text[3:5], 16)
                self.surface.append(bytes([value]))
                if self.bytes:
                    self.bytes[value] = i
            else:
                shown = {CONTROL: b"", UNKNOWN: trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode())}
                self.surface.append(shown.get(kind, text.replace(MARK, " ").encode()))
        self.marked = [kind == NORMAL and text.startswith(MARK) for text, kind in zip(texts, kinds)]

        ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == NORMAL}
        scores = {i: struct.unpack("<f", pieces[i][SCORE])[0] if SCORE in pieces[i] else 0.0 for i in ids.values()}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # characters that are no piece by themselves but part of one have a symbol too; any other is `other` and never merges
        symbols = dict(ids)
        for char in sorted(set().union(*ids)):
            symbols.setdefault(char, len(texts) + len(symbols) - len(ids))
        self.count, self.other = len(texts), len(texts) + len(symbols) - len(ids)
        single = sorted((ord(t), s) for t, s in symbols.items() if len(t) == 1)
        self.chars = np.array([c for c, _ in single] + [1 << 32], np.int64)
        self.symbols = np.array([s for _, s in single] + [self.other], np.int64)
        pairs = sorted(
            (symbols[t[:i]] << 32 | symbols[t[i:]], rank_of[scores[piece]], piece)
            for t, piece in ids.items()
            for i in range(1, len(t))
            if t[:i] in symbols and t[i:] in symbols
        )
        self.pairs = np.array([k for k, _, _ in pairs] + [1 << 62], np.int64)
        self.ranks = np.array([r for _, r, _ in pairs] + [NONE], np.int32)
        self.merged = np.array([p for _, _, p in pairs] + [-1], np.int64)
        self.beside = np.array(sorted({ord(a) << 32 | ord(b) for t in ids for a, b in zip(t, t[1:])}) + [1 << 62], np.int64)
        marks_begin = not any(MARK in t.lstrip(MARK) for t in ids)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if marks_begin else "(?s:.+)").findall
        self.known: dict[str, bytes] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the tables; the last place is that of pairs that no piece holds."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, at, len(self.pairs) - 1)

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each word."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        found = np.searchsorted(self.chars, chars)
        symbol = np.where(self.chars[found] == chars, self.symbols[found], self.other)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        key = chars[:-1] << 32 | chars[1:]
        last = np.append(self.beside[np.searchsorted(self.beside, key)] != key, True)
        last[ends - 1] = True
        out, live = symbol.copy(), np.ones(len(chars), bool)

        place = np.arange(len(chars))
        pair = np.append(self._pair(symbol[:-1], symbol[1:]), 0)
        pair[last] = len(self.pairs) - 1
        while len(place):
            rank = self.ranks[pair]
            begins = np.flatnonzero(np.append(True, last[:-1]))
            least = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(place)))
            if (least == NONE).any():
                stay = np.repeat(least < NONE, sizes)
                gone = place[~stay]
                out[gone] = symbol[~stay]
                symbol, place, pair, last, rank = symbol[stay], place[stay], pair[stay], last[stay], rank[stay]
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(place):
                    break
            word = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == least[word])
            # of a run of pairs that overlap, every other one
            order = np.arange(len(at))
            chained = np.append(False, at[1:] == at[:-1] + 1)
            at = at[(order - np.maximum.accumulate(np.where(chained, 0, order))) % 2 == 0]
            first = np.append(True, word[at[1:]] != word[at[:-1]])
            if not first.all():
                at = at[first | ~self._early(symbol, pair, last, word, least, at)[word[at]]]
            keep = np.ones(len(place), bool)
            keep[at + 1] = False
            symbol[at] = self.merged[pair[at]]
            last[at] = last[at + 1]
            live[place[at + 1]] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            symbol, place, pair, last = symbol[keep], place[keep], pair[keep], last[keep]
            new = np.unique(np.concatenate([at, at[at > 0] - 1]))
            pair[new] = np.where(last[new], len(self.pairs) - 1, self._pair(symbol[new], symbol[np.minimum(new + 1, len(symbol) - 1)]))
        counts = np.add.reduceat(live, np.append(0, ends[:-1]))
        out, chars = out[live], chars[live]
        strange = out >= self.count
        if not strange.any():
            raw = out.astype("<u4").tobytes()
            stops = np.cumsum(counts) * 4
            return [raw[a:b] for a, b in zip(np.append(0, stops[:-1]), stops)]
        result, begin = [], 0
        for stop in np.cumsum(counts):
            part = out[begin:stop].tolist()
            if strange[begin:stop].any():
                part = [i for s, c in zip(part, chars[begin:stop].tolist()) for i in ([s] if s < self.count else self._fallback(chr(c)))]
            result.append(np.array(part, "<u4").tobytes())
            begin = stop
        return result

    def _early(self, symbol: np.ndarray, pair: np.ndarray, last: np.ndarray, word: np.ndarray, least: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each word, whether merging all of `at` makes a pair that would have come before some of them."""
        made = self.merged[pair[at]]
        before = np.where(np.append(False, at[1:] - 2 == at[:-1]), np.append(0, made[:-1]), symbol[at - 1])
        early = np.zeros(len(least), bool)
        # a merge meets its left neighbour merged already, its right one not yet
        has, more = ~np.append(True, last[:-1])[at], ~last[at + 1]
        early[word[at[has]][self.ranks[self._pair(before[has], made[has])] <= least[word[at[has]]]]] = True
        early[word[at[more]][self.ranks[self._pair(made[more], symbol[at[more] + 2])] <= least[word[at[more]]]]] = True
        return early

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the begin and end ids."""
        cut = [self.words(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        wanted = set().union(*cut)
        if len(self.known) + len(wanted - self.known.keys()) > CACHED:
            self.known = {}
        fresh = list(wanted - self.known.keys())
        made = dict(zip(fresh, self._merge(fresh))) if fresh else {}
        short = {w: ids for w, ids in made.items() if len(w) <= CACHED_CHARS}
        if len(short) <= CACHED:
            self.known.update(short)
        known = {**self.known, **made} if len(short) < len(made) or len(short) > CACHED else self.known
        begin, end = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        return [b"".join([begin, *map(known.__getitem__, words), end]) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: control pieces show nothing, one mark at its beginning goes, bytes that are no UTF-8 become U+FFFD each."""
        listed = np.frombuffer(ids, "<u4").tolist()
        shown = [self.surface[i] for i in listed]
        if self.prefix and (first := next((k for k, s in enumerate(shown) if s), None)) is not None and self.marked[listed[first]]:
            shown[first] = shown[first][1:]
        parts, begin = [], 0
        for k, s in enumerate(shown):  # bytes on both sides of a control piece make no character together
            if not s:
                parts.append(b"".join(shown[begin:k]))
                begin = k
        parts.append(b"".join(shown[begin:]))
        return "".join(p.decode("utf-8", "evidex.each_byte") for p in parts)


_loaded: dict[bytes, Model] = {}


def loaded(content: bytes) -> Model:
    """One model for the life of a worker."""
    key = hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(content)
    return _loaded[key]


def encoded(docs: DataFrame, model: str, ids: bool = True, chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with `ids` the ids (array<int>) and the decoded text.

    model: path of a model file on the driver; its content, fixed by the file, goes to the executors.
    chars: about so many characters are encoded at a time.
    """
    with open(model, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(content.value)
        for b in batches:
            rows, at = b.column(1), 0
            while at < len(rows):
                texts, held = [], 0
                while at < len(rows) and held < chars:
                    texts.append(rows[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                found = known.encode(texts)
                decoded = [known.decode(x) for x in found]
                columns = [
                    b.column(0).slice(at - len(texts), len(texts)),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                if ids:
                    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4"))), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, shape)


def op11_piece_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), ids=False)
