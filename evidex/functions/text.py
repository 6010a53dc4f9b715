"""Column helpers over text. White space is what Python's str.strip and re's \\s take, unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character, for Java and RE2 alike.
W = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"
#: The characters of W.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NEWLINES = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
OTHER_NEWLINES = r"[\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: The end of a word, where Java's \b and RE2's differ.
B = r"(?:[^\p{L}\p{N}_]|$)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, of) -> Column:
    """of(value), with value computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def left_blank(c: Column | str) -> Column:
    """Number of leading white-space characters."""
    return F.length(F.regexp_extract(col(c), f"^{W}*", 0))


def compact(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(col(c), f"{W}+", "")


def single_spaced(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), f"{W}+", " ")


def clip(c: Column | str, most: int) -> Column:
    """A longer text ends in three dots at `most` characters."""
    c = col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def split_lines(c: Column | str) -> Column:
    """The lines of a text by any line break; no empty line after a last break, none of an empty text."""
    # most texts break lines by \n alone, which splits without a pattern
    parts = F.when(col(c).rlike(OTHER_NEWLINES), F.split(col(c), NEWLINES)).otherwise(F.split(col(c), "\n"))
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def after_first(lines: Column) -> Column:
    """All lines but the first."""
    return F.when(F.size(lines) > 1, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def casefold(c: Column | str) -> Column:
    """Lower case with the two letters that differ in folded text. lower(upper(x)) won't do: Spark simplifies it to lower(x)."""
    return F.translate(F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss")), "ς", "σ")


def document_preview(c: Column | str) -> Column:
    """200 characters, line breaks as \\n, stripped."""
    return clip(strip(F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))), 200)


def hit_preview(c: Column | str) -> Column:
    """240 characters on one line."""
    return clip(F.replace(col(c), F.lit("\n"), F.lit(" ")), 240)


def prefixed(c: Column | str, kind: str) -> Column:
    """'query: ' or 'passage: ' before the stripped text, unless it begins so in any case."""
    s = strip(c)
    return F.when(F.startswith(F.lower(s), F.lit(f"{kind}:")), s).otherwise(F.concat(F.lit(f"{kind}: "), s))


def key_segment(c: Column | str) -> Column:
    """Lower-case letters and digits with single underscores; null if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s != "", s)


def hash8(c: Column | str) -> Column:
    """The first 8 digits of a SHA-256 in hex; null if it isn't one."""
    s = F.lower(strip(c))
    return F.when(s.rlike("^[0-9a-f]{64}$"), F.substring(s, 1, 8))


def date_segment(c: Column | str) -> Column:
    """YYYYMMDD of YYYY-MM-DD; null if it doesn't have that shape."""
    s = strip(c)
    return F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.replace(s, F.lit("-"), F.lit("")))


def csv_list(c: Column | str) -> Column:
    """Stripped, non-empty parts between commas; null if there are none."""
    parts = F.filter(F.transform(F.split(col(c), ","), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def four_places(c: Column) -> Column:
    return F.format_string("%.4f", c)


def once(df, **columns: Column):
    """df with added columns that are computed once a row. A generator of one row stands between them and what uses them, where Spark would write them out at every use."""
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], made)
