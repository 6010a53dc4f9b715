"""DuckDB SQL that says again what the section operators do, as common table expressions over the derived corpus."""

from __future__ import annotations

from evidex.functions.text import NEWLINES, W
from evidex.operators import regions as R
from evidex.operators import sections as S
from evidex.operators import units as U
from evidex.plans.corpus import SQL as CORPUS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{W}+|{W}+$')}, '', 'g')"


def compact(x: str) -> str:
    return f"regexp_replace({x}, {q(W + '+')}, '', 'g')"


def spaced(x: str) -> str:
    return f"regexp_replace({strip(x)}, {q(W + '+')}, ' ', 'g')"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def lines(x: str) -> str:
    cut = f"string_split_regex({x}, {q(NEWLINES)})"
    return f"(CASE WHEN {cut}[-1] = '' THEN {cut}[1:-2] ELSE {cut} END)"


def clip(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n - 3}) || '...' ELSE {x} END"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def legal(s: str) -> str:
    return f"({like(compact(s), R.LEGAL_COMPACT)} OR {like(s, R.LEGAL_SPACED)} OR {like(s, R.RELATED_LAW)})"


def legal_heading(s: str) -> str:
    return f"(NOT {like(s, S.LEGAL_NUMBER)} AND {legal(s)})"


def kept_chars(ls: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter(list_transform({ls}, lambda z: {strip('z')}), lambda z: z <> '' AND NOT {like('z', S.POINTER_OR_NUMBER)}), lambda z: length(z))), 0)"


LAYOUT = f"""
ps AS (SELECT document_id, page_number, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_start FROM pg),
ft AS (SELECT document_id, string_agg(text, chr(10) ORDER BY page_number) AS full_text FROM pg GROUP BY 1),
t AS (SELECT document_id, full_text, length(full_text)::BIGINT AS total_len FROM ft),
ln0 AS (SELECT document_id, page_number, page_start, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM ps WHERE text <> ''),
ln AS (SELECT document_id, page_number, line_no, line, (page_start + coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id, page_number ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM ln0)
"""

REGIONS = f"""
r0 AS (SELECT document_id, page_number, {strip("text")} AS s FROM pg),
r1 AS (SELECT *, {lines("s")} AS ls, list_transform({lines("s")}, lambda x: {strip("x")}) AS sl, length(s) AS n FROM r0),
r2 AS (SELECT *,
  len(list_filter(ls, lambda x: {like("x", R.DOT_LEADER)})) AS dots,
  len(list_filter(sl, lambda x: {like("x", R.ARTICLE_LINE)})) AS articles,
  len(list_filter(sl, lambda x: x <> '' AND length(x) <= 140 AND {like("x", R.PAGE_REFERENCE)} AND {like("x", R.REFERENCE_SUBJECT)})) AS "rows",
  len(list_filter(ls, lambda x: {like("x", R.APPENDIX_PAREN_HEAD)} OR {like("x", R.APPENDIX_PLAIN_HEAD)} OR {like("x", R.APPENDIX_COMPACT_HEAD)})) AS heads,
  len(list_filter(sl, lambda x: {legal("x")})) > 0 AS legal,
  (len(list_filter(sl, lambda x: length(x) >= 110 AND NOT ({like("x", R.ARTICLE_LINE)} AND length(x) < 85) AND NOT {like("x", R.PAGE_TOKEN)})) >= 2 OR n > 9500 OR ({like("s", R.PART_ANYWHERE)} AND n > 4500)) AS substantive
  FROM r1),
r3 AS (SELECT *, (NOT substantive AND (articles >= 5 OR (articles >= 3 AND "rows" >= 5) OR "rows" >= 6)) AS rowy FROM r2),
r4 AS (SELECT *,
  CASE WHEN page_number <= 2 AND n < 1600 AND {any_of("s", ["보험약관", "개정약관", "공시"])} THEN 52.0 ELSE 0 END AS s_cover,
  CASE WHEN dots >= 2 THEN least(60.0 + 8 * dots, 95) ELSE 0 END + CASE WHEN {like("s", R.TOC_MARK)} THEN 55.0 ELSE 0 END + CASE WHEN articles >= 4 AND n < 6000 AND "rows" >= 3 THEN 45.0 ELSE 0 END
    + CASE WHEN "rows" >= 4 THEN least(30.0 + 6 * "rows", 95) ELSE 0 END + CASE WHEN NOT substantive AND articles >= 5 THEN least(40 + 4.5 * articles, 220) ELSE 0 END + CASE WHEN rowy THEN 55.0 ELSE 0 END AS s_toc0,
  CASE WHEN {any_of("s", ["고객권리안내문", "약관 이용"])} OR contains(lower(s), 'guide book') THEN 85.0 ELSE 0 END AS s_guide,
  CASE WHEN {any_of("s", ["요약", "알아두세요", "주요내용"])} THEN 48.0 ELSE 0 END AS s_summary,
  CASE WHEN {like("s", R.PART_ANYWHERE)} THEN 62.0 ELSE 0 END + CASE WHEN n > 3200 THEN 28.0 ELSE 0 END + CASE WHEN substantive THEN 72.0 ELSE 0 END AS s_body,
  CASE WHEN heads >= 1 THEN least(38.0 + 14 * heads, 88) ELSE 0 END AS s_app0,
  CASE WHEN legal THEN 80.0 ELSE 0 END AS s_leg0,
  CASE WHEN starts_with(s, '보험용어 해설') OR (contains(s, '보험용어') AND contains(s, '해설')) THEN 78.0 ELSE 0 END AS s_glo0
  FROM r3),
r5 AS (SELECT document_id, page_number, s, unnest([
  {{'o': 0, 'name': 'cover', 'v': s_cover::DOUBLE}}, {{'o': 1, 'name': 'toc', 'v': (CASE WHEN substantive THEN least(s_toc0, 40) ELSE s_toc0 END)::DOUBLE}}, {{'o': 2, 'name': 'guide', 'v': s_guide::DOUBLE}},
  {{'o': 3, 'name': 'summary', 'v': s_summary::DOUBLE}}, {{'o': 4, 'name': 'policy_body', 'v': s_body::DOUBLE}}, {{'o': 5, 'name': 'appendix', 'v': (CASE WHEN rowy THEN least(s_app0, 12) ELSE s_app0 END)::DOUBLE}},
  {{'o': 6, 'name': 'legal_reference', 'v': (CASE WHEN rowy THEN least(s_leg0, 12) ELSE s_leg0 END)::DOUBLE}}, {{'o': 7, 'name': 'glossary', 'v': (CASE WHEN rowy THEN least(s_glo0, 12) ELSE s_glo0 END)::DOUBLE}}, {{'o': 8, 'name': 'unknown', 'v': 0.0::DOUBLE}}], recursive := true) FROM r4),
r6 AS (SELECT *, row_number() OVER w AS k, v / (v + lead(v) OVER w + 1e-6) AS c FROM r5 WINDOW w AS (PARTITION BY document_id, page_number ORDER BY v DESC, o)),
rg AS (SELECT document_id, page_number, CASE WHEN s = '' OR v <= 0 THEN 'unknown' ELSE name END AS region_type, CASE WHEN s = '' OR v <= 0 THEN 0.35 ELSE least(greatest(c, 0.25), 1.0) END AS confidence FROM r6 WHERE k = 1)
"""


def _spaced_heading(p: str) -> str:
    whole = f"{compact(f'regexp_extract(line, {q(p)}, 1)')} || ' ' || {strip(f'regexp_extract(line, {q(p)}, 2)')}"
    return strip(f"regexp_replace({whole}, {q(W + '+')}, ' ', 'g')")


_POINTS = f"(length(s) <= 120 AND {like('s', S.POINTER_TAIL)})"
CANDIDATES = f"""
c0 AS (SELECT *, {strip("line")} AS s, "offset" + length(regexp_extract(line, {q(f"^{W}*")}, 0)) AS start FROM ln),
c1 AS (SELECT *, CASE WHEN s = '' THEN NULL WHEN {like("s", S.TOC)} THEN 'toc' WHEN starts_with(s, '고객권리안내문') THEN 'guide'
  WHEN {like("line", S.APPENDIX_PAREN)} THEN CASE WHEN {_POINTS} THEN NULL ELSE 'appendix' END
  WHEN {like("line", S.APPENDIX_PLAIN)} THEN CASE WHEN {_POINTS} THEN NULL ELSE 'appendix' END
  WHEN {like("line", S.PART)} THEN 'part' WHEN {like("line", S.ARTICLE)} THEN 'article' WHEN {legal_heading("s")} THEN 'legal_reference' WHEN starts_with(s, '보험용어 해설') THEN 'glossary' END AS section_type FROM c0),
c2 AS (SELECT document_id, page_number AS start_page, start::BIGINT AS start_char_offset, section_type, {clip("title", 500)} AS title FROM (SELECT *, CASE section_type WHEN 'part' THEN {_spaced_heading(S.PART)} WHEN 'article' THEN {_spaced_heading(S.ARTICLE)}
  WHEN 'appendix' THEN {strip("CASE WHEN " + like("line", S.APPENDIX_PAREN) + " THEN '( 별표 ' || regexp_extract(line, " + q(S.APPENDIX_PAREN) + ", 1) || ' ) ' || " + strip(f"regexp_extract(line, {q(S.APPENDIX_PAREN)}, 2)") + " ELSE '별표 ' || regexp_extract(line, " + q(S.APPENDIX_PLAIN) + ", 1) || ' ' || " + strip(f"regexp_extract(line, {q(S.APPENDIX_PLAIN)}, 2)") + " END")} ELSE s END AS title FROM c1 WHERE section_type IS NOT NULL)),
cd AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY document_id, start_char_offset ORDER BY start_page, title, section_type) = 1)
"""

MARKERS = f"""
m0 AS (SELECT document_id, unnest(string_split(full_text, chr(10))) AS line, unnest(range(len(string_split(full_text, chr(10))))) AS i FROM t),
m1 AS (SELECT document_id, i, {strip("line")} AS s, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", lead({strip("line")}) OVER (PARTITION BY document_id ORDER BY i) AS after FROM m0),
m2 AS (SELECT document_id, "offset", CASE WHEN {like("s", U.ONE_LINE)} THEN {q(U.ONE_LINE)} ELSE {q(U.TWO_LINES)} END AS p, s FROM m1 WHERE NOT {like("s", U.SKIPPED)} AND ({like("s", U.ONE_LINE)} OR ({like("s", U.TWO_LINES)} AND coalesce({like("after", U.SECOND_LINE)}, false)))),
m3 AS (SELECT document_id, "offset", {strip(f"CASE WHEN {like('s', U.ONE_LINE)} THEN regexp_extract(s, {q(U.ONE_LINE)}, 1) ELSE regexp_extract(s, {q(U.TWO_LINES)}, 1) END")} AS name, CASE WHEN {like("s", U.ONE_LINE)} THEN regexp_extract(s, {q(U.ONE_LINE)}, 2) ELSE regexp_extract(s, {q(U.TWO_LINES)}, 2) END AS variant FROM m2),
mk AS (SELECT document_id, "offset", name, variant FROM m3 QUALIFY (lag(name || '|' || variant) OVER (PARTITION BY document_id ORDER BY "offset")) IS DISTINCT FROM name || '|' || variant)
"""

_REST = "substr(full_text, \"offset\" + 1)"
_TAIL = "list_min(list_filter([" + f"CASE WHEN {like(_REST, U.TAIL_HEADING)} THEN instr({_REST}, regexp_extract({_REST}, {q(U.TAIL_HEADING)}, 0)) ELSE 0 END, " + ", ".join(f"instr({_REST}, {q(w)})" for w in U.TAIL_WORDS) + "], lambda x: x > 0))"
UNITS = f"""
u0 AS (SELECT mk.*, t.full_text, t.total_len, row_number() OVER w - 1 AS number, lead("offset") OVER w AS next FROM mk JOIN t USING (document_id) WINDOW w AS (PARTITION BY mk.document_id ORDER BY "offset")),
u1 AS (SELECT *, CASE WHEN next IS NULL THEN {_TAIL} - 1 + "offset" END AS tail FROM u0),
u2 AS (SELECT *, greatest("offset", coalesce(next, total_len) - 1) AS plain_end FROM u1),
un AS (SELECT document_id, document_id || '::pu::' || lpad(number::VARCHAR, 4, '0') AS policy_unit_id, name AS policy_unit_name, variant AS variant_name, "offset" AS start_char_offset,
  CASE WHEN next IS NULL AND tail - 1 >= "offset" AND tail - 1 <= total_len - 1 THEN tail - 1 ELSE plain_end END::BIGINT AS end_char_offset, (max(tail) OVER (PARTITION BY document_id))::BIGINT AS tail_cutoff FROM u2)
"""

_TAILS = f"list_filter(list_transform(tl, lambda x: {strip('x')}), lambda x: x <> '')"
_CLOSED = "(contains(head, ')') OR contains(head, '）'))"
_INNER = f"regexp_extract(fl, {q(f'^(제{W}*' + chr(92) + f'd+{W}*조)(.*)$')}, 2)"
VERDICTS = f"""
v0 AS (SELECT cd.*, t.full_text, t.total_len, coalesce(lead(start_char_offset) OVER (PARTITION BY cd.document_id ORDER BY start_char_offset), total_len) AS next FROM cd JOIN t USING (document_id)),
v1 AS (SELECT *, substr(full_text, start_char_offset + 1, next - start_char_offset) AS slice FROM v0),
v2 AS (SELECT *, {lines("slice")} AS sls FROM v1),
v3 AS (SELECT *, coalesce(sls[1], '') AS hl, coalesce(sls[2:], []) AS tl FROM v2),
v4 AS (SELECT *, {strip("hl")} AS head, {strip("array_to_string(tl, chr(10))")} AS body, {strip("string_split(slice, chr(10))[1]")} AS fl FROM v3),
v5 AS (SELECT v4.*, rg.region_type FROM v4 LEFT JOIN rg ON rg.document_id = v4.document_id AND rg.page_number = v4.start_page),
v6 AS (SELECT *, CASE WHEN region_type = 'appendix' AND section_type = 'article' THEN
   CASE WHEN {like(compact("head"), r"제\d+조제\d+항")} THEN 'clause_pin_reference' WHEN (contains(head, '(') OR contains(head, '（')) AND NOT {_CLOSED} THEN 'incomplete_paren_heading'
   WHEN {like("head", f"^제{W}*" + r"\d+" + f"{W}*조[（(]")} AND {_CLOSED} AND length(head) <= 78 THEN 'compact_paren_row'
   WHEN {any_of("substr(body, 1, 1400)", S.OPENERS)} OR length(body) >= 220 THEN NULL ELSE 'missing_clause_prose' END END AS pin FROM v5),
v7 AS (SELECT *, coalesce(min(CASE WHEN pin IS NULL THEN start_char_offset END) OVER (PARTITION BY document_id ORDER BY start_char_offset ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), total_len) AS body_end FROM v6),
mo AS (SELECT document_id, list("offset" ORDER BY "offset") AS marks FROM mk GROUP BY 1),
v8 AS (SELECT v7.*, coalesce(marks, []) AS marks, substr(full_text, start_char_offset + 1, least(body_end, coalesce(list_min(list_filter(coalesce(marks, []), lambda x: x >= start_char_offset AND x < body_end)), body_end)) - start_char_offset) AS own FROM v7 LEFT JOIN mo USING (document_id)),
v9 AS (SELECT *,
  (CASE section_type WHEN 'article' THEN {like("head", f"^제{W}*" + r"\d+" + f"{W}*조")} WHEN 'appendix' THEN {like("hl", S.APPENDIX_PAREN)} OR {like("hl", S.APPENDIX_PLAIN)} WHEN 'legal_reference' THEN {legal_heading("head")} ELSE false END
   AND {kept_chars("tl")} < {S.TOC_TAIL} AND len({_TAILS}) > 0 AND len(list_filter({_TAILS}, lambda x: NOT {like("x", S.POINTER_OR_NUMBER)})) = 0) AS toc_row,
  (section_type IN ('article', 'part', 'appendix', 'legal_reference', 'glossary') AND ((head <> '' AND length(head) <= 140 AND {like("head", S.POINTER_TAIL)}) OR coalesce({like(_TAILS + "[1]", S.POINTER)}, false))) AS pointer
  FROM v8),
v10 AS (SELECT *, CASE WHEN toc_row THEN 'toc_like_candidate_backstop' WHEN pointer THEN 'pointer_reference_heading_slice' WHEN region_type IN ('toc', 'guide', 'cover', 'summary') AND section_type IN ('article', 'part', 'appendix', 'legal_reference', 'glossary') THEN 'suppress_structure_on_front_matter:' || region_type
  WHEN section_type = 'appendix' AND {kept_chars("coalesce(" + lines("own") + "[2:], [])")} < {S.APPENDIX_BODY} THEN 'appendix_insufficient_substantive_body'
  WHEN section_type = 'legal_reference' AND {any_of("substr(slice, 1, 2200)", S.GUIDE_PHRASES)} THEN 'legal_blocked_guide_phrase'
  WHEN section_type = 'legal_reference' AND {like("head", S.LEGAL_POINTER)} THEN 'legal_blocked_heading_same_line_page_pointer'
  WHEN section_type = 'legal_reference' AND NOT (len(sls) >= 2 AND length(body) >= 40 AND ({any_of("body", S.LAWS)} OR {like("body", S.LAW_QUOTE)} OR {like("body", S.LAW_ARTICLE)} OR {like("body", S.LAW_KIND)})) THEN 'legal_blocked_missing_substantive_law_corpus'
  WHEN section_type = 'article' AND pin IS NOT NULL THEN 'appendix_article_' || pin
  WHEN section_type = 'article' AND length(fl) <= 220 AND {strip(_INNER)} <> '' AND ({like(compact(_INNER), S.INLINE_COMPACT)} OR {like(_INNER, S.INLINE_TAIL)}) THEN 'article_inline_clause_reference_heading' END AS blocked FROM v9)
"""

SECTIONS = f"""
s0 AS (SELECT *, row_number() OVER w - 1 AS number, coalesce(lead(start_char_offset) OVER w, total_len) AS nx FROM v10 WHERE blocked IS NULL WINDOW w AS (PARTITION BY document_id ORDER BY start_char_offset)),
s1 AS (SELECT *, document_id || '::sec::' || lpad(number::VARCHAR, 4, '0') AS section_id, CASE WHEN section_type = 'appendix' THEN coalesce(list_min(list_filter(marks, lambda x: x >= start_char_offset AND x < nx)), nx) ELSE nx END AS end_char_offset FROM s0),
s2 AS (SELECT document_id, section_id, section_type, title, start_page, start_char_offset, end_char_offset,
  CASE WHEN section_type = 'article' THEN last_value(CASE WHEN section_type = 'part' THEN section_id END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY start_char_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS parent_section_id,
  {strip("substr(full_text, start_char_offset + 1, end_char_offset - start_char_offset)")} AS text,
  CASE WHEN section_type IN ('part', 'article') AND region_type = 'policy_body' THEN 0.94 WHEN section_type IN ('part', 'article') AND region_type = 'unknown' THEN 0.84 ELSE 0.82 END AS assembly_confidence FROM s1),
s3 AS (SELECT s2.*, greatest(start_page, (SELECT max(page_number) FROM ps WHERE ps.document_id = s2.document_id AND ps.page_start <= CASE WHEN s2.end_char_offset > s2.start_char_offset THEN s2.end_char_offset - 1 ELSE s2.start_char_offset END)) AS end_page FROM s2),
sc AS (SELECT s3.*, un.policy_unit_id, un.policy_unit_name, un.variant_name FROM s3 LEFT JOIN un ON un.document_id = s3.document_id AND s3.start_char_offset BETWEEN un.start_char_offset AND un.end_char_offset AND (un.tail_cutoff IS NULL OR s3.start_char_offset < un.tail_cutoff))
"""

_LO = "CASE WHEN a = 0 AND instr(x, chr(10)) > 0 AND instr(x, chr(10)) < n AND instr(x, chr(10)) <= hard THEN instr(x, chr(10)) ELSE a + 1 END"


def chunk_spans(source: str, key: str, width: int = 2200, overlap: int = 250) -> str:
    """cs: {key}, chunk_index, a, b of texts x in `source`, by recursion over the chunks of all texts at once."""
    line = "length(regexp_extract(substr(x, lo, hard - lo + 1), '(?s)^(.*\\n)', 1))"
    paragraph = "length(regexp_extract(substr(x, greatest(lo - 1, 1), hard - greatest(lo - 1, 1) + 1), '(?s)^(.*\\n\\n)', 1))"
    step = f"""SELECT k, x, n, chunk_index, a, CASE WHEN hard >= n THEN n WHEN {paragraph} > 0 THEN greatest(lo - 1, 1) - 1 + {paragraph} WHEN {line} > 0 THEN lo - 1 + {line} ELSE hard END AS b
      FROM (SELECT *, {_LO} AS lo FROM (SELECT *, least(a + {width}, n) AS hard FROM (%s)))"""
    snap = "instr(substr(x, nx + 1, b - nx), chr(10))"
    return f"""
cs AS (
  WITH RECURSIVE r AS (
    {step % f"SELECT {key} AS k, x, length(x) AS n, 0 AS chunk_index, 0 AS a FROM {source} WHERE length(x) > 0"}
    UNION ALL
    {step % f'''SELECT k, x, n, chunk_index + 1 AS chunk_index, CASE WHEN m <= 0 THEN least(a + 1, n - 1) ELSE least(CASE WHEN ny >= b THEN a + 1 ELSE ny END, n - 1) END AS a FROM (
        SELECT *, CASE WHEN substr(x, nx, 1) <> chr(10) AND {snap} > 0 AND nx + {snap} < b THEN nx + {snap} ELSE nx END AS ny FROM (
          SELECT *, greatest(a + 1, b - least({overlap}, m)) AS nx FROM (SELECT *, b - a - 1 AS m FROM r WHERE b < n)))'''}
  ) SELECT k AS {key}, chunk_index, a, b FROM r
)"""


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def after(*parts: str) -> str:
    return "WITH " + ",".join((CORPUS, LAYOUT, *parts))
