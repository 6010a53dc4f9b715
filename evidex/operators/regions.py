"""Page regions: additive scores of nine labels from shallow signals of a page's text, and the best of them.

The order of the steps matters: the outline rules lift and cap scores before summary, cover and body signals are added, and the
cap of the table of contents on substantive pages comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import B, W, compact, split_lines, strip

# Markers and patterns that decide results.
ARTICLE_LINE = rf"^{W}*제{W}*\d+{W}*조{B}"
PART_ANYWHERE = rf"제{W}*\d+{W}*관{B}"
DOT_LEADER = r"\.{4,}"
PAGE_REFERENCE = rf"(?i)(?:[.．]{W}*\d{{1,4}}|\d{{1,4}}{W}*p){W}*$"
REFERENCE_SUBJECT = rf"제{W}*\d+{W}*조|별표|약관"
PAGE_TOKEN = rf"(?i)^(?:[.．]{W}*\d{{1,4}}|\d{{1,4}}{W}*p?)$"
APPENDIX_PAREN_HEAD = rf"^{W}*[(（]{W}*별표{W}*\d+{W}*[)）]"
APPENDIX_PLAIN_HEAD = rf"^{W}*별표{W}+\d+{W}+[^\s]"
APPENDIX_COMPACT_HEAD = rf"^{W}*별표{W}*\d+(?:{W}+[^\s]|[^\s])"
LEGAL_SPACED = rf"^{W}*약관에서{W}*인용(?:한|된){W}*법"
LEGAL_COMPACT = r"^약관에서인용(?:한|된)법"
RELATED_LAW = rf"^{W}*관련{W}*법규{W}*(?:$|[:：])"
TOC_MARK = rf"목{W}*차"

#: In order of declaration, which settles ties.
REGIONS = ["cover", "toc", "guide", "summary", "policy_body", "appendix", "legal_reference", "glossary", "unknown"]


def _count(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def _has(c: Column, *words: str) -> Column:
    found = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(c, F.lit(w))
    return found


def signals(pages: DataFrame) -> DataFrame:
    """pages with s (stripped text) and what is counted in its lines."""
    out = pages.withColumn("s", strip(F.coalesce("text", F.lit("")))).withColumn("ls", split_lines("s")).withColumn("sl", F.transform("ls", strip))
    sl = F.col("sl")
    long_line = lambda x: (F.length(x) >= 110) & ~(x.rlike(ARTICLE_LINE) & (F.length(x) < 85)) & ~x.rlike(PAGE_TOKEN)
    legal = lambda x: x.rlike(LEGAL_SPACED) | compact(x).rlike(LEGAL_COMPACT) | x.rlike(RELATED_LAW)
    kind = lambda x: F.when(x.rlike(APPENDIX_PAREN_HEAD), "heading_line:byeolpyo_paren").when(x.rlike(APPENDIX_PLAIN_HEAD), "heading_line:byeolpyo_plain").when(x.rlike(APPENDIX_COMPACT_HEAD), "heading_line:byeolpyo_plain_compact")
    n = F.length("s")
    return out.withColumns(
        {
            "n": n,
            "dots": _count(F.col("ls"), lambda x: x.rlike(DOT_LEADER)),
            "articles": _count(sl, lambda x: x.rlike(ARTICLE_LINE)),
            "rows": _count(sl, lambda x: (x != "") & (F.length(x) <= 140) & x.rlike(PAGE_REFERENCE) & x.rlike(REFERENCE_SUBJECT)),
            "heads": F.filter(F.transform("ls", kind), lambda x: x.isNotNull()),
            "legal": F.exists(sl, legal),
            "substantive": (_count(sl, long_line) >= 2) | (n > 9500) | (F.col("s").rlike(PART_ANYWHERE) & (n > 4500)),
        }
    )


def classify(pages: DataFrame) -> DataFrame:
    """document_id, page_number, region_type, confidence, evidence (sorted, distinct) of every page."""
    out = signals(pages)
    s, a, r, dots, n = (F.col(c) for c in ("s", "articles", "rows", "dots", "n"))
    zero = F.lit(0.0)
    add = lambda test, value: F.when(test, value).otherwise(zero)
    guide = _has(s, "고객권리안내문", "약관 이용") | F.contains(F.lower(s), F.lit("guide book"))
    glossary = F.startswith(s, F.lit("보험용어 해설")) | (_has(s, "보험용어") & _has(s, "해설"))
    marked = s.rlike(TOC_MARK)
    many = (a >= 4) & (n < 6000) & (r >= 3)
    heads = F.size("heads")
    outline = ~F.col("substantive") & (a >= 5)
    rows = ~F.col("substantive") & ((a >= 5) | ((a >= 3) & (r >= 5)) | (r >= 6))
    summary, cover = _has(s, "요약", "알아두세요", "주요내용"), (F.col("page_number") <= 2) & (n < 1600) & _has(s, "보험약관", "개정약관", "공시")
    part, long, body = s.rlike(PART_ANYWHERE), n > 3200, F.col("substantive")
    toc = add(dots >= 2, F.least(60.0 + 8.0 * dots, F.lit(95.0))) + add(marked, F.lit(55.0)) + add(many, F.lit(45.0)) + add(r >= 4, F.least(30.0 + 6.0 * r, F.lit(95.0)))
    toc = toc + add(outline, F.least(40.0 + 4.5 * a, F.lit(220.0))) + add(rows, F.lit(55.0))
    capped = lambda c: F.when(rows, F.least(c, F.lit(12.0))).otherwise(c)
    scores = {
        "cover": add(cover, F.lit(52.0)),
        "toc": F.when(body, F.least(toc, F.lit(40.0))).otherwise(toc),
        "guide": add(guide, F.lit(85.0)),
        "summary": add(summary, F.lit(48.0)),
        "policy_body": add(part, F.lit(62.0)) + add(long, F.lit(28.0)) + add(body, F.lit(72.0)),
        "appendix": capped(add(heads >= 1, F.least(38.0 + 14.0 * heads, F.lit(88.0)))),
        "legal_reference": capped(add(F.col("legal"), F.lit(80.0))),
        "glossary": capped(add(glossary, F.lit(78.0))),
        "unknown": zero,
    }
    token = lambda test, text: F.when(test, text if isinstance(text, Column) else F.lit(text))
    seen = F.array(
        token(guide, "keyword:guide_or_customer_rights"),
        token(F.col("legal"), "keyword:legal_reference_heading"),
        token(glossary, "keyword:glossary_heading"),
        token(dots >= 2, F.concat(F.lit("signal:dot_leader_lines:"), dots)),
        token(marked, "keyword:toc_marker"),
        token(many, F.concat(F.lit("signal:many_article_outline_lines:"), a)),
        token(r >= 4, F.concat(F.lit("signal:toc_page_reference_rows:"), r)),
        token(outline, F.concat(F.lit("signal:toc_outline_priority_boost:"), a)),
        token(rows, F.concat(F.lit("signal:toc_reference_row_priority:"), r, F.lit(":"), a)),
        token(summary, "keyword:summary_marker"),
        token(cover, "heuristic:early_short_cover_like"),
        token(part, "keyword:gwan_heading"),
        token(long, "heuristic:long_page"),
        token(body, "signal:policy_body_boost_substantive_clause_text"),
        token(body, "signal:toc_score_cap_when_substantive_clause_page"),
    )
    ranked = F.sort_array(F.array(*[F.struct(scores[k].alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("name")) for i, k in enumerate(REGIONS)]), False)
    out = out.withColumn("ranked", ranked).withColumn("seen", F.array_distinct(F.concat(F.array_compact(seen), F.slice("heads", 1, 5))))
    top, second = F.col("ranked")[0], F.col("ranked")[1]["score"]
    empty, none = s == "", top["score"] <= 0
    confidence = F.least(F.greatest(top["score"] / (top["score"] + second + 1e-6), F.lit(0.25)), F.lit(1.0))
    evidence = F.when(empty, F.array(F.lit("empty_page"))).when(none, F.array_append("seen", F.lit("fallback:unknown"))).otherwise(F.col("seen"))
    return out.select(
        "document_id",
        "page_number",
        F.when(empty | none, "unknown").otherwise(top["name"]).alias("region_type"),
        F.when(empty | none, 0.35).otherwise(confidence).alias("confidence"),
        F.array_sort(evidence).alias("evidence"),
    )
