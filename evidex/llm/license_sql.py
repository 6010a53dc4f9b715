"""The licence scan in SQL, written apart from license_scan: lines are brought to their canonical form one by one, and the digests of
the known texts come from a plain function."""

from __future__ import annotations

import hashlib
import re

from evidex.llm.license_scan import OPENINGS, STATED, full_texts, known_texts


_MARK = re.compile(r"copyright *\(c\)|copyright *©|(?:copyright|\(c\)|©)[ ,]*(?:[0-9]{4}|<y|\[y|\{y)")


def _uncovered(line: str) -> str:
    """A line without the statements of copyright that an opening follows."""
    out, at = "", 0
    while mark := _MARK.search(line, at):
        # of all openings the nearest behind the mark
        near = min((i for o in OPENINGS if 0 <= (i := line.find(o, mark.end())) <= mark.end() + STATED), default=None)
        if near is None:
            out, at = out + line[at : mark.start() + 1], mark.start() + 1
        else:
            opening = next(o for o in OPENINGS if line.startswith(o, near))
            out, at = out + line[at : mark.start()] + opening, near + len(opening)
    return out + line[at:]


def plain(text: str) -> str:
    """The canonical form of a text, its lines joined by spaces."""
    out = []
    for line in map(_uncovered, text.lower().split("\n")):
        bare = re.sub(r"^[\W_]+", "", line)
        stated = line[: len(line) - len(bare)]
        if re.match(r"copyright(?![^\W\d_])", bare) and not re.search("[(©]", stated) or re.match(r"(?:[^\w(©]|_)*(\(c\)|©)", line):
            continue
        if bare.startswith("all rights reserved"):
            line = re.sub(r"^[\W_]+", "", bare.removeprefix("all rights reserved"))
        for a, b in (("sub-licen", "sublicen"), ("sub licen", "sublicen"), ("licence", "license"), ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"), ("http://", "https://"), ("&", " and ")):
            line = line.replace(a, b)
        line = re.sub(r"(?<![\w])v(?:er)?[. ]{0,2}(?=[0-9])", "version ", line)
        out += "".join(c if c.isalnum() else " " for c in line).split()
    return " ".join(out)


def _known() -> str:
    held: dict[str, str] = {}
    for name, text in known_texts() + full_texts():
        digest = hashlib.sha256(plain(text).encode()).hexdigest()
        held[digest] = min(name, held.get(digest, name))
    return ", ".join(f"('{d}', '{n}')" for d, n in sorted(held.items()))


# RE2 can't look ahead; what an opening takes is given back
_CUT = f"regexp_replace(x, '(copyright *(\\(c\\)|©)|(copyright|\\(c\\)|©)[ ,]*([0-9][0-9][0-9][0-9]|[<[{{]y))[^\\n]{{0,{STATED}}}?({'|'.join(OPENINGS)})', '\\5', 'g')"

_LINE = r"""CASE WHEN regexp_matches(x, '^[^\p{L}\p{N}(©]*(copyright([^\p{L}]|$)|\(c\)|©)') THEN '' ELSE
  trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(replace(regexp_replace(regexp_replace(x,
    '^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*', ''), 'sub[ -]licen', 'sublicen', 'g'), 'licence', 'license'), 'non[ -]commercial', 'noncommercial', 'g'),
    'http://', 'https://'), '&', ' and '), '\bv(er)?[. ]{0,2}([0-9])', 'version \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') END"""

OP8_SQL = f"""
WITH known AS (SELECT * FROM (VALUES {_known()}) AS v(digest, license)),
c AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: {_CUT}), lambda x: {_LINE}), lambda x: x <> '') AS l FROM documents),
w AS (SELECT r, doc_id, sha256(coalesce(array_to_string(l, ' '), '')) AS text_digest FROM c),
n AS (SELECT r, count(*) AS n, list(DISTINCT license) AS f FROM (SELECT r, sha256(unnest(l)) AS digest FROM c) JOIN known USING (digest) GROUP BY r)
SELECT w.doc_id, text_digest, k.license, coalesce(n.n, 0) AS n_notices,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(n.f, []), CASE WHEN k.license IS NULL THEN [] ELSE [k.license] END))), ',') AS licenses
FROM w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN n ON n.r = w.r
"""
