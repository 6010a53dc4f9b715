"""Licence scan by canonical digest lookup, with DataFrame functions alone.

A text's canonical form is lower-cased; statements of copyright go: one that one of OPENINGS follows in its line, within STATED
characters, is cut from the line, else a line that begins with one goes; equivalent spellings become one (licence, sub-license,
non-commercial, v2 for version 2, http for https, & for and); all that is neither letter nor digit becomes one space, and lines
are trimmed. The SHA-256 of the whole canonical text, its lines joined by spaces, is hash-joined to the digests of known
licences; so is that of every line by itself, since a notice often stands as a line of a longer document. No part of a text is
skipped and none is compared loosely. Canonical forms are written once; of the lines only those that a known digest meets are
ever shuffled.

Odd input: null, empty and punctuation-only texts have an empty canonical form, which is no licence; rows that repeat give
repeated rows; empty tables give none; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm.shared import table, written

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Known licences: full texts of two short ones, and names in the phrases that notices use.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "ISC": ["the ISC License", "ISC"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GPL-3.0", "GPLv3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["the Unlicense"],
}
PHRASES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is released under {}.", "SPDX-License-Identifier: {}"]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text)."""
    return [("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("ISC", ISC)] + [(k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES]


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the entire licences in the folder `licenses`, with the spellings in which they are met: as published, a line for each paragraph, and one line."""
    found = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    texts = dict(found)
    apache = texts["Apache-2.0"]
    header = apache[apache.index("   Licensed under the Apache License") :]
    found += [("Apache-2.0", header), ("Apache-2.0", apache[: apache.index("   APPENDIX")]), ("Apache-2.0", apache[: apache.index("END OF TERMS")])]
    for name, begin in (("GPL-2.0", "    This program is free software; you can"), ("GPL-3.0", "    This program is free software: you can")):
        notice = texts[name][texts[name].index(begin) :]
        found.append((name, notice[: re.search(r"Also add information", notice).start()]))
    regents = texts["BSD-3-Clause"]
    for holder, by, either in (("copyright holder", "COPYRIGHT HOLDERS AND", "COPYRIGHT HOLDER OR"), ("copyright holder", "COPYRIGHT HOLDERS AND", "COPYRIGHT OWNER OR"), ("University", "REGENTS AND", "REGENTS OR")):
        three = regents.replace("the University", f"the {holder}").replace("REGENTS AND", by).replace("REGENTS OR", either)
        two = re.sub(r"(?m)^3\.[^\n]*\n(?: [^\n]*\n)+", "", three)
        for name, text in (("BSD-3-Clause", three), ("BSD-2-Clause", two)):
            bare = re.sub(r"(?m)^[123]\. ", "", text)
            found += [(name, text), (name, bare)]
    return found + [(k, re.sub(r"(?<=\S)[ ]*\n[ \t]*(?=\S)", " ", t)) for k, t in found] + [(k, " ".join(t.split())) for k, t in found]


#: Words by which a licence or a notice begins behind a statement of copyright in one line.
OPENINGS = [
    "permission is hereby granted", "permission to use", "redistribution and use", "everyone is permitted",
    "licensed under", "licenced under", "released under", "distributed under", "spdx-license-identifier",
    "this program is", "this software is", "this work is", "this project is", "this file is", "this code is",
]
#: The most characters between the mark of a copyright and what follows its statement.
STATED = 300

#: Pattern and replacement, in order; group 1 is written $1 here.
RULES = [
    (r"(?:copyright *(?:\(c\)|©)|(?:copyright|\(c\)|©)[ ,]*(?:[0-9]{4}|[<\[{]y))[^\n]{0,%d}?(%s)" % (STATED, "|".join(OPENINGS)), "$1"),
    (r"(^|\n)[^\p{L}\p{N}\n(©]*(?:copyright(?!\p{L})|\(c\)|©)[^\n]*", "$1"),
    (r"(^|\n)[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*", "$1"),
    (r"sub[ -]licen", "sublicen"),
    (r"licence", "license"),
    (r"non[ -]commercial", "noncommercial"),
    (r"http://", "https://"),
    (r"&", " and "),
    (r"\bv(?:er)?[. ]{0,2}([0-9])", "version $1"),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r" ?\n ?", "\n"),
]


def canonical(text: Column) -> Column:
    """The canonical form, its lines apart."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for pattern, by in RULES:
        plain = pattern in ("licence", "http://", "&")
        out = F.replace(out, F.lit(pattern), F.lit(by)) if plain else F.regexp_replace(out, pattern, by)
    return F.trim(out)


def joined(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"\n+", " "))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license of texts (licence, text), or of all that are known here."""
    rows = spark.createDataFrame(known_texts() + full_texts() if texts is None else texts, "license string, t string")
    rows = rows.select("license", F.sha2(joined(canonical(F.col("t"))), 256).alias("digest")).where(F.col("digest") != F.sha2(F.lit(""), 256))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, license (of the whole text, or null), n_notices (lines that are a known text), licenses (all found, sorted, joined by commas) of every row.

    known: digest, license; written once, so that Spark knows its size and broadcasts it only if that is small.
    """
    known = written(known, "license-known")
    number = F.monotonically_increasing_id().alias("number")
    rows = written(docs.select(number, F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("t")), "license-forms")
    whole = rows.select("number", "doc_id", F.sha2(joined(F.col("t")), 256).alias("text_digest"))
    whole = whole.join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    lines = rows.select("number", F.explode(F.split("t", "\n")).alias("u")).where("u <> ''").select("number", F.sha2("u", 256).alias("digest"))
    hits = lines.join(known, "digest").groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.collect_set("license").alias("found"))
    out = whole.join(hits, "number", "left")
    licenses = F.array_distinct(F.array_compact(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array("license"))))
    return out.select("doc_id", "text_digest", "license", F.coalesce("n", F.lit(0)).alias("n_notices"), F.array_join(F.array_sort(licenses), ",").alias("licenses"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), known_digests(spark))
