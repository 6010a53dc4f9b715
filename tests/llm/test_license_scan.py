"""Licence scan: canonical forms meet their licence, others don't."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from evidex.llm import license_scan as L
from evidex.llm.license_sql import plain

SHAPE = "doc_id long, text string, license string, digest string, t string"


def test_scan(spark):
    mit = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + L.MIT.replace("sublicense", "sub-license").upper().replace(".", " .")
    rows = [
        (1, mit),
        (2, "Some prose here.\nLicenced under the  APACHE Licence, version 2.0\nMore prose.\nReleased under the MIT License!"),
        (3, "SPDX-License-Identifier: CC BY-NC 4.0"),
        (4, "This work is licensed under the GNU General Public License v3"),
        (5, L.MIT + " And one word more."),
        (6, None),
        (7, ""),
        (8, "...!!!\n---"),
        (9, "© 2021 Nobody"),
        (None, "Released under MIT"),
        (3, "SPDX-License-Identifier: CC BY-NC 4.0"),
        (10, "prose " * 50000 + "\nLicensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame([(d, t, "", "", "") for d, t in rows], SHAPE)
    got = sorted(((r.doc_id, r.license, r.n_notices, r.licenses) for r in L.license_scan(docs, L.known_digests(spark)).collect()), key=repr)
    want = [(1, "MIT", 0, "MIT"), (2, None, 2, "Apache-2.0,MIT"), (3, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (3, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (4, "GPL-3.0", 1, "GPL-3.0"), (None, "MIT", 1, "MIT"), (10, None, 1, "CC-BY-NC-4.0")]
    want += [(d, None, 0, "") for d in (5, 6, 7, 8, 9)]
    assert got == sorted(want, key=repr)
    assert L.license_scan(docs.limit(0), L.known_digests(spark)).count() == 0


def test_known_texts_differ(spark):
    rows = L.known_digests(spark).collect()
    assert len(rows) == len({r.digest for r in rows}) and {r.license for r in rows} == {k for k, _ in L.known_texts()}


def test_entire_texts(spark):
    header = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    folder = Path(L.__file__).parent / "licenses"
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSD-3-Clause"]
    texts = [(n, (folder / f"{n}.txt").read_text("utf-8").upper()) for n in names] + [("Apache-2.0", "Copyright 2020 Some One\n\n" + header)]
    bsd = texts[7][1].replace("THE UNIVERSITY", "THE COPYRIGHT HOLDER").replace("REGENTS AND", "COPYRIGHT HOLDERS AND").replace("REGENTS OR", "COPYRIGHT HOLDER OR")
    third = bsd[bsd.index("3. NEITHER") : bsd.index("\nTHIS SOFTWARE IS")]
    texts += [("BSD-3-Clause", bsd), ("BSD-2-Clause", bsd.replace(third, ""))]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, (_, t) in enumerate(texts)] + [(99, texts[0][1] + "\nand more", "", "", "")], SHAPE)
    got = {r.doc_id: r.license for r in L.license_scan(docs, L.known_digests(spark)).collect()}
    assert got == {**{i: n for i, (n, _) in enumerate(texts)}, 99: None}
    mine = L.known_digests(spark, [("Own-1.0", "my own licence text")])
    assert [r.license for r in L.license_scan(spark.createDataFrame([(1, "My own license text.", "", "", "")], SHAPE), mine).collect()] == ["Own-1.0"]


def test_file_headers(spark):
    folder = Path(L.__file__).parent / "licenses"
    three = (folder / "GPL-3.0.txt").read_text("utf-8")
    header = three[three.index("    This program is free software:") : three.index("Also add information")]
    docs = spark.createDataFrame([(1, "# Copyright (C) 2020  Some One\n#\n" + "".join(f"# {x.strip()}\n" for x in header.strip().split("\n")), "", "", "")], SHAPE)
    assert [r.license for r in L.license_scan(docs, L.known_digests(spark)).collect()] == ["GPL-3.0"]


def test_canonical_form_against_a_plain_one(spark):
    rng = random.Random(2)
    parts = [*L.OPENINGS, "Copyright (c)", "(c) 2019,", "Copyright [yyyy]", "Copyright <year>", "Copyright", "(c)", "©", "2020", "All rights reserved.", "licence", "sub-license", "Sub license", "non-commercial", "http://", "&", "v2", "ver. 3", "MIT", "é", "--", "#", "copyrighted", "x" * 40, "_"]
    texts = ["\n".join(" ".join(rng.choices(parts, k=rng.randrange(6))) for _ in range(5)) for _ in range(400)] + ["", "\n\n", "copyright", "Copyright\nnext"]
    texts += [f"Copyright (c) {'y' * n} licensed under MIT (c) 2020 this file is" for n in (L.STATED - 3, L.STATED - 2, L.STATED - 1, L.STATED, 9 * L.STATED)] + ["copyright 2020 " * 20000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.joined(L.canonical(F.col("t"))).alias("c")).collect()
    assert [(r.t, r.c) for r in rows] == [(r.t, plain(r.t)) for r in rows]


def test_statements_within_a_line(spark):
    bsd = next(t for n, t in L.full_texts() if n == "BSD-3-Clause")
    rows = [
        (1, "Copyright (c) 2020 Foo. " + " ".join(L.MIT.split()), "MIT"),
        (2, "The MIT License? " + " ".join(L.MIT.split()), None),
        (3, "MIT License Copyright (c) 2020 Foo Inc. and others " + " ".join(L.MIT.split()), "MIT"),
        (4, "Copyright 2020 A\nCopyright <year> B, all rights reserved. " + L.MIT, "MIT"),
        (5, "Copyright (c) 1999 Some One. All rights reserved. " + " ".join(bsd[bsd.index("Redistribution") :].split()), "BSD-3-Clause"),
        (6, "Copyright 2020 Permission Isle. " + "z" * L.STATED + " " + L.MIT, None),
    ]
    docs = spark.createDataFrame([(d, t, "", "", "") for d, t, _ in rows], SHAPE)
    got = {r.doc_id: r.license for r in L.license_scan(docs, L.known_digests(spark)).collect()}
    assert got == {d: k for d, _, k in rows}
