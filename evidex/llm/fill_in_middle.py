"""Fill-in-middle transformation with a wavelet matrix over character classes.

Each character has one of four classes: inside a word or mark run, last of a word, white space, line break. The classes of all
texts of a batch lie in one sequence under a wavelet matrix: a bit a level, each level's characters ordered by the bits above,
with counts of ones before every 64-bit word. `rank(c, i)` counts the characters of class c before place i through the two
levels. A unit ends at a character of certain classes, so the sum of these classes' ranks is the number of units that end
before a place; what follows a text's last such character is one more unit. The cut after u units is a `select` where one
class ends units, found through the levels upwards, and else the least place whose ranks sum to u, found by bisection. Cuts of
all texts are found together, in numpy.

A document's cuts and form come from a hash of the seed and its doc_id. Its output can be undone from the output and the form
alone (`restored`): a text that holds a sentinel stays plain, and a sentinel never arises where pieces meet, since it begins
and ends with characters that only sentinels hold in these places.

Odd input: a null text is the empty one, and empty texts stay plain with n = 0; a null doc_id counts as the empty text in the
hash; rows that repeat give repeated rows; texts of any length are cut whole; an empty table gives none; columns other than
doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidex.llm.shared import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INSIDE, WORD_END, SPACE, LINE_END = range(4)
#: The classes at which a unit ends.
UNITS = {"line": (LINE_END,), "word": (WORD_END,), "word_or_line": (WORD_END, LINE_END), "char": (INSIDE, WORD_END, SPACE, LINE_END)}
LEVELS = 2


class Bits:
    """A sequence of bits with constant-time rank, and select by bisection on ranks."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def rank(self, bit: int, at: np.ndarray) -> np.ndarray:
        return self.ones(at) if bit else at - self.ones(at)

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) bit of this kind."""
        return least_place(lambda at: self.rank(bit, at), k + 1, np.zeros_like(k), np.full_like(k, self.size)) - 1


def least_place(count, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least place in [low, high] before which `count` is `wanted` at least; count grows with the place."""
    while (low < high).any():
        middle = (low + high) >> 1
        enough = count(middle) >= wanted
        low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
    return low


class WaveletMatrix:
    def __init__(self, classes: np.ndarray):
        self.size = len(classes)
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in reversed(range(LEVELS)):
            ones = (classes >> level & 1).astype(bool)
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(ones) - ones.sum()))
            classes = np.concatenate([classes[~ones], classes[ones]])

    def _down(self, level: int, bit: int, at: np.ndarray) -> np.ndarray:
        return self.levels[level].rank(bit, at) + self.zeros[level] * bit

    def rank(self, of: int, at: np.ndarray) -> np.ndarray:
        """Characters of class `of` before each place."""
        begin = np.zeros(1, np.int64)
        for level in range(LEVELS):
            bit = of >> (LEVELS - 1 - level) & 1
            begin, at = self._down(level, bit, begin), self._down(level, bit, at)
        return at - begin

    def select(self, of: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) character of class `of`."""
        begin = np.zeros(1, np.int64)
        bits = [of >> (LEVELS - 1 - level) & 1 for level in range(LEVELS)]
        for level, bit in enumerate(bits):
            begin = self._down(level, bit, begin)
        at = begin + k
        for level, bit in reversed(list(enumerate(bits))):
            at = self.levels[level].select(bit, at - self.zeros[level] * bit)
        return at


def classes_of(chars: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Class of each character of joined texts; last: whether it is its text's last one."""
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    ends = ~space & (np.append(space[1:], True) | last)
    return np.where(chars == 10, LINE_END, np.where(space, SPACE, np.where(ends, WORD_END, INSIDE))).astype(np.uint8)


def cuts(texts: list[str], draws: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, end of the prefix, end of the middle) of each text; draws: two integers a text, each taken modulo units + 1."""
    ending = UNITS[unit]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(lengths)
    starts = stops - lengths
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    last = np.zeros(len(chars), bool)
    last[stops[lengths > 0] - 1] = True
    classes = classes_of(chars, last)
    matrix = WaveletMatrix(classes)

    def ended(at: np.ndarray) -> np.ndarray:
        return sum(matrix.rank(c, at) for c in ending)

    before = ended(starts)
    whole = ended(stops) - before
    tail = np.zeros(len(texts), bool)
    tail[lengths > 0] = ~np.isin(classes[stops[lengths > 0] - 1], ending)
    units = whole + tail
    ends = []
    for draw in np.sort(draws % (units + 1)[:, None], axis=1).T:
        inner = (draw > 0) & (draw <= whole)
        at = np.where(draw > 0, stops, starts)
        if inner.any():
            wanted = (before + draw)[inner]
            at[inner] = matrix.select(ending[0], wanted - 1) + 1 if len(ending) == 1 else least_place(ended, wanted, starts[inner], stops[inner])
        ends.append(at - starts)
    return units, *ends


def arranged(text: str, first: int, second: int, form: str) -> str:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else text


def restored(output: str, form: str) -> str:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    front, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = front.removeprefix(PREFIX).split(SUFFIX, 1)
    else:
        suffix, prefix = front.removeprefix(SUFFIX).split(PREFIX, 1)
    return prefix + middle + suffix


def draws_of(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def transformed(docs: DataFrame, unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, outputs: bool = True, chars: int = 1 << 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row, and with `outputs` the output.

    unit: a key of UNITS; percent: of the texts that are transformed at all; spm_percent: of those, the suffix first.
    chars: about so many characters are cut at a time.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * outputs

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = b.column(1), 0
            while at < len(rows):
                texts, begin, held = [], at, 0
                while at < len(rows) and held < chars:
                    texts.append(rows[at].as_py() or "")
                    held += len(texts[-1])
                    at += 1
                ids = b.column(0).slice(begin, at - begin)
                drawn = np.array([draws_of(seed, i) for i in ids.to_pylist()], np.int64)
                units, first, second = cuts(texts, drawn[:, :2], unit)
                plain = [not t or PREFIX in t or SUFFIX in t or MIDDLE in t or d % 100 >= percent for t, d in zip(texts, drawn[:, 2].tolist())]
                forms = ["plain" if p else "spm" if d % 100 < spm_percent else "psm" for p, d in zip(plain, drawn[:, 3].tolist())]
                made = [arranged(*x) for x in zip(texts, first.tolist(), second.tolist(), forms)]
                arrays = [
                    ids,
                    pa.array(units, pa.int64()),
                    pa.array(forms),
                    pa.array(first, pa.int64(), mask=np.array(plain)),
                    pa.array(second - first, pa.int64(), mask=np.array(plain)),
                    pa.array(map(digest, made)),
                    pa.array(map(digest, map(restored, made, forms))),
                ]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(made)] * outputs, columns)

    shape = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * outputs
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, shape)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return transformed(table(spark, sf_dir, "documents"), outputs=False)


OP12_SQL = r"""
with drawn as (
    select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units
    from documents),
numbers as (
    select *, len(units) as n,
           cast('0x' || substr(h, 1, 8) as ubigint) % (len(units) + 1) as u1, cast('0x' || substr(h, 9, 8) as ubigint) % (len(units) + 1) as u2,
           cast('0x' || substr(h, 17, 8) as ubigint) % 100 as r3, cast('0x' || substr(h, 25, 8) as ubigint) % 100 as r4
    from drawn),
parts as (
    select *,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r3 >= 100 then 'plain'
                when r4 < 50 then 'spm' else 'psm' end as form,
           array_to_string(units[1:least(u1, u2)], '') as prefix,
           array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], '') as middle,
           array_to_string(units[greatest(u1, u2) + 1:], '') as suffix
    from numbers)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""
