"""Sections: heading candidates by line rules, filters that suppress false headings, and the slices of text between what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W_
from pyspark.sql import functions as F

from evidex.functions.text import BLANKS, W, after_first, clip, compact, four_places, left_blank, once, split_lines, strip
from evidex.operators.layout import lengths, lines, outline, text_lines, with_page, with_page_start
from evidex.operators.regions import LEGAL_COMPACT, LEGAL_SPACED, RELATED_LAW, classify
from evidex.operators.running import running
from evidex.operators.units import attach, markers, units
from evidex.sources.tables import stored

# Confidences, markers, patterns and limits that decide results.
CONFIDENCE = 0.82
TOC = rf"^[{W[1:-1]}\[［【(（]*목{W}*차[{W[1:-1]}\]］】)）]*$"
APPENDIX_PAREN = rf"^{W}*[(（]{W}*별표{W}*(\d+){W}*[)）]{W}*(.*)$"
APPENDIX_PLAIN = rf"^{W}*별표{W}*(\d+){W}*(.+)$"
PART = rf"^{W}*(제{W}*\d+{W}*관){W}*(.+)$"
ARTICLE = rf"^{W}*(제{W}*\d+{W}*조){W}*(.*)$"
POINTER_TAIL = rf"(?i)(?:[.．]{W}*\d{{1,4}}{W}*|\d{{1,4}}{W}*p{W}*)$"
POINTER = rf"(?i)^(?:[.．]{W}*\d{{1,4}}|\d{{1,4}}{W}*p)$"
POINTER_OR_NUMBER = rf"(?i)^(?:[.．]{W}*\d{{1,4}}|\d{{1,4}}{W}*p?)$"
LEGAL_NUMBER = rf"^관련법규{W}*\d"
GUIDE_HEADING, GLOSSARY_HEADING = "고객권리안내문", "보험용어 해설"
STRUCTURE = ["article", "part", "appendix", "legal_reference", "glossary"]
FRONT = ["toc", "guide", "cover", "summary"]
APPENDIX_BODY, TOC_TAIL = 100, 35
OPENERS = ["이 계약은", "회사는", "계약자는", "보험수익자는", "피보험자는"]
LAWS = ["민법", "상법", "보험업법", "금융소비자보호법", "조세특례제한법", "소비자기본법", "개인정보 보호법", "전자금융거래법", "보험업법 시행령", "약관의 규제에 관한 법률"]
GUIDE_PHRASES = ["보험약관 가이드", "보험약관 요약서", "약관을 쉽게 이용", "관련법규 168p"]
INLINE_COMPACT = r"[）)].*(?:에따른|에따라|에서정한|에의한|와관련|과관련|의보험금지급사유)|\)제\d+[항호]"
INLINE_TAIL = rf"[）)]{W}*제{W}*\d+{W}*[항호]"
LAW_QUOTE = r"[「【][^」』\n]{2,80}[」』]"
LAW_ARTICLE = rf"제{W}*\d+{W}*조{W}*[（(]?{W}*(?:민법|상법|보험업법|금융소비자보호법)"
LAW_KIND = rf"(?:법률|법령|시행령){W}*(?:제{W}*\d+{W}*조|제{W}*\d+{W}*호)"
LEGAL_POINTER = rf"(?i)(?:법·규정|법령){W}*\d{{1,4}}{W}*p?{W}*$"


def _any(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def legal_heading(s: Column) -> Column:
    return ~s.rlike(LEGAL_NUMBER) & (compact(s).rlike(LEGAL_COMPACT) | s.rlike(LEGAL_SPACED) | s.rlike(RELATED_LAW))


def line_rule(line: Column) -> Column:
    """struct(section_type, title, pattern) of the first rule that a line meets, or null."""
    s = strip(line)
    rule = lambda kind, title, pattern: F.struct(F.lit(kind).alias("section_type"), clip(strip(title), 500).alias("title"), F.lit(f"pattern:{pattern}").alias("pattern"))
    numbered = lambda p: F.regexp_extract(line, p, 1)
    rest = lambda p: strip(F.regexp_extract(line, p, 2))
    spaced = lambda p: F.regexp_replace(F.concat(compact(numbered(p)), F.lit(" "), rest(p)), f"{W}+", " ")
    pointer = (F.length(s) <= 120) & s.rlike(POINTER_TAIL)
    return (
        F.when(s == "", None)
        .when(s.rlike(TOC), rule("toc", s, "toc_heading"))
        .when(F.startswith(s, F.lit(GUIDE_HEADING)), rule("guide", s, "customer_rights_heading"))
        .when(line.rlike(APPENDIX_PAREN), F.when(~pointer, rule("appendix", F.concat(F.lit("( 별표 "), numbered(APPENDIX_PAREN), F.lit(" ) "), rest(APPENDIX_PAREN)), "appendix_paren")))
        .when(line.rlike(APPENDIX_PLAIN), F.when(~pointer, rule("appendix", F.concat(F.lit("별표 "), numbered(APPENDIX_PLAIN), F.lit(" "), rest(APPENDIX_PLAIN)), "appendix_plain")))
        .when(line.rlike(PART), rule("part", spaced(PART), "gwan_line"))
        .when(line.rlike(ARTICLE), rule("article", spaced(ARTICLE), "article_line"))
        .when(legal_heading(s), rule("legal_reference", s, "legal_reference_heading"))
        .when(F.startswith(s, F.lit(GLOSSARY_HEADING)), rule("glossary", s, "glossary_heading"))
    )


def candidates(pages: DataFrame) -> DataFrame:
    """document_id, candidate_id, section_type, title, start_page, start_char_offset, confidence, evidence of every heading line of pages, or of their lines."""
    ruled = (pages if "line" in pages.columns else lines(pages)).withColumn("r", line_rule(F.col("line"))).where("r is not null")
    at = (F.col("offset") + left_blank("line")).alias("start_char_offset")
    out = ruled.select("document_id", "r.section_type", "r.title", F.col("page_number").alias("start_page"), at, F.lit(CONFIDENCE).alias("confidence"), F.array("r.pattern", F.lit("generator:regex_rules_v1")).alias("evidence"))
    order = W_.partitionBy("document_id", "start_char_offset").orderBy("start_page", "title", "section_type")
    out = out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return out.withColumn("candidate_id", F.format_string("%s::cand::%010d", "document_id", "start_char_offset"))


# Tests of a candidate's slice. head, tail lines and body are columns made by `sliced`.


def substantive_chars(ls: Column) -> Column:
    """Characters of the lines that aren't page numbers."""
    kept = F.filter(F.transform(ls, strip), lambda x: (x != "") & ~x.rlike(POINTER_OR_NUMBER))
    return F.aggregate(kept, F.lit(0), lambda a, x: a + F.length(x))


def toc_like_row() -> Column:
    tail = F.filter(F.transform("tail_lines", strip), lambda x: x != "")
    only = (F.size(tail) > 0) & F.forall(tail, lambda x: x.rlike(POINTER_OR_NUMBER))
    kind, head = F.col("section_type"), F.col("head")
    heading = F.when(kind == "article", head.rlike(rf"^제{W}*\d+{W}*조")).when(kind == "appendix", F.col("head_line").rlike(APPENDIX_PAREN) | F.col("head_line").rlike(APPENDIX_PLAIN)).when(kind == "legal_reference", legal_heading(head) | compact(head).rlike(LEGAL_COMPACT)).otherwise(F.lit(False))
    return (F.size("slice_lines") > 0) & heading & (substantive_chars(F.col("tail_lines")) < TOC_TAIL) & only


def pointer_slice() -> Column:
    following = F.element_at(F.concat(F.filter(F.transform("tail_lines", strip), lambda x: x != ""), F.array(F.lit(""))), 1)
    head = F.col("head")
    pointing = (head != "") & (F.length(head) <= 140) & head.rlike(POINTER_TAIL)
    return (F.size("slice_lines") > 0) & F.col("section_type").isin(STRUCTURE) & (pointing | following.rlike(POINTER))


def appendix_article_reason() -> Column:
    """Why an article row of an appendix page isn't a heading, or null."""
    head, body = F.col("head"), F.col("body")
    opened = F.contains(head, F.lit("(")) | F.contains(head, F.lit("（"))
    closed = F.contains(head, F.lit(")")) | F.contains(head, F.lit("）"))
    reason = lambda r: F.lit(f"filter:appendix_article_{r}")
    return F.when(
        (F.col("section_type") == "article") & (F.size("slice_lines") > 0),
        F.when(compact(head).rlike(r"제\d+조제\d+항"), reason("clause_pin_reference"))
        .when(opened & ~closed, reason("incomplete_paren_heading"))
        .when(head.rlike(rf"^제{W}*\d+{W}*조[（(]") & closed & (F.length(head) <= 78), reason("compact_paren_row"))
        .when(_any(F.substring(body, 1, 1400), OPENERS) | (F.length(body) >= 220), None)
        .otherwise(reason("missing_clause_prose")),
    )


def legal_reason() -> Column:
    """Why a legal heading's slice isn't law text, or null."""
    s, head, body = F.col("slice"), F.col("head"), F.col("body")
    phrase = F.element_at(F.concat(F.filter(F.array(*map(F.lit, GUIDE_PHRASES)), lambda p: F.contains(F.substring(s, 1, 2200), p)), F.array(F.lit(""))), 1)
    early = compact(F.substring(s, 1, 1100))
    ladder = _any(early, ["약관에서인용된법령", "약관에서인용한법"]) & F.substring(s, 1, 520).rlike(rf"(?i)[.．]{W}*168|168{W}*p") & (F.contains(early, F.lit("보험용어해설")) | F.contains(F.substring(s, 1, 900), F.lit("보험용어 해설")))
    corpus = (F.size("slice_lines") >= 2) & (F.length(body) >= 40) & (_any(body, LAWS) | body.rlike(LAW_QUOTE) | body.rlike(LAW_ARTICLE) | body.rlike(LAW_KIND))
    reason = lambda r: F.lit(f"filter:legal_blocked_{r}")
    return (
        F.when(strip(s) == "", reason("empty_chunk"))
        .when(phrase != "", F.concat(reason("guide_phrase:"), phrase))
        .when(ladder, reason("pointer_glossary_toc_ladder"))
        .when(head.rlike(LEGAL_POINTER), reason("heading_same_line_page_pointer"))
        .when(compact(head).rlike(LEGAL_POINTER), reason("heading_compact_page_pointer"))
        .when(~corpus, reason("missing_substantive_law_corpus"))
    )


def inline_reference() -> Column:
    head = strip(F.substring_index("slice", "\n", 1))
    tail = strip(F.regexp_extract(head, rf"^(제{W}*\d+{W}*조)(.*)$", 2))
    return (F.length(head) <= 220) & (tail != "") & (compact(tail).rlike(INLINE_COMPACT) | tail.rlike(INLINE_TAIL))


def owned(found: DataFrame, line_table: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Lines (rank 2) and markers (rank 1) in the order of their places: document_id, at, rank, line, s, before, own.

    at: where a line's first letter or a marker's line stands; s: a line's characters, page numbers left out; before: their sum
    over all lines before; own: the start of the last row of found at or before. One pass along the lines of a document.
    """
    at = F.col("start_char_offset")
    events = line_table.select("document_id", (F.col("offset") + left_blank("line")).alias("at"), F.lit(2).alias("rank"), "line", substantive_chars(split_lines("line")).alias("s"))
    events = events.unionByName(found.select("document_id", at.cast("long").alias("at"), F.lit(0).alias("rank")), allowMissingColumns=True)
    if marked is not None:
        events = events.unionByName(marked.select("document_id", F.col("offset").alias("at"), F.lit(1).alias("rank")), allowMissingColumns=True)
    out = running(events, "at", ("rank",), sums={"before": F.coalesce("s", F.lit(0))}, lasts={"own": F.when(F.col("rank") == 0, F.col("at"))})
    return out.where("rank <> 0")


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, slice, and first (the first line's at, before and s) of lines gathered by keys. White space at the end of a slice may be less than in the text."""
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("_lines"), F.min(F.struct("at", "before", "s")).alias("first"))
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    return gathered.select(*keys, F.ltrim(text, F.lit(BLANKS)).alias("slice"), "first")


def _ends(found: DataFrame, texts: DataFrame, placed: DataFrame) -> DataFrame:
    """found (document_id, start_char_offset, pin, first, ...) with next_mark (the first marker from there on) and own_chars.

    own_chars are the characters, page numbers left out, of the lines after a candidate's own up to where an appendix's own text
    ends: the next candidate without a pin, or the first marker before it.
    """
    start, first = F.col("start_char_offset"), F.col("first")
    own = found.withColumns({"at": start, "rank": F.lit(0), "before": F.coalesce(first["before"], F.lit(0)), "own_s": F.when(first["at"] == start, first["s"])}).drop("first")
    marks = placed.where("rank = 1").select("document_id", "at", "rank", "before")
    whole = placed.where("rank = 2").groupBy("document_id").agg(F.sum("s").alias("before"))
    ends = whole.join(lengths(texts), "document_id").select("document_id", F.col("total_len").alias("at"), F.lit(3).alias("rank"), "before")
    events = own.unionByName(marks, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    rank, here = F.col("rank"), F.struct("at", "before")
    # what follows is what comes before in the other order, which Spark sums up in one pass
    ahead = W_.partitionBy("document_id").orderBy(F.desc("at"), F.desc("rank")).rowsBetween(W_.unboundedPreceding, -1)
    events = events.withColumns({"body": F.min(F.when((rank == 3) | ((rank == 0) & F.col("pin").isNull()), here)).over(ahead), "mark": F.min(F.when(rank == 1, here)).over(ahead)}).where("rank = 0")
    end = F.least("body", "mark")
    between = end["before"] - F.col("before") - F.coalesce("own_s", F.lit(0)) + substantive_chars(after_first(split_lines("head_line")))
    out = events.withColumns({"next_mark": F.col("mark.at"), "own_chars": F.when(end["at"] > start, between).otherwise(0)})
    return out.drop("at", "rank", "before", "own_s", "body", "mark")


def judged(found: DataFrame, regions: DataFrame, texts: DataFrame, marked: DataFrame, line_table: DataFrame | None = None) -> DataFrame:
    """Candidates with `emit`, `trace`, `assembly_confidence` and next_mark. Filters see the text up to the next candidate, whatever becomes of that.

    line_table: the lines, or what `owned` made of them, the candidates and the markers.
    """
    placed = text_lines(texts) if line_table is None else line_table
    placed = placed if "own" in placed.columns else owned(found, placed, marked)
    cut = _joined(placed.where("rank = 2 and own is not null"), "document_id", "own").withColumnRenamed("own", "start_char_offset")
    out = found.join(cut, ["document_id", "start_char_offset"], "left").withColumn("slice", F.coalesce("slice", F.lit("")))
    out = once(out, slice_lines=split_lines("slice"))
    out = once(out, head_line=F.element_at(F.concat("slice_lines", F.array(F.lit(""))), 1), tail_lines=after_first(F.col("slice_lines")))
    out = once(out, head=strip("head_line"), body=strip(F.array_join("tail_lines", "\n")))
    # of labels of a page that is there twice the last counts: the last by `position` where that is known, else the greatest
    label = F.struct(F.col("region_type"), F.col("confidence").alias("region_confidence"), F.col("evidence").alias("region_evidence"))
    last = F.max_by(label, F.struct("position", label)) if "position" in regions.columns else F.max(label)
    r = regions.groupBy("document_id", F.col("page_number").alias("start_page")).agg(last.alias("_r")).select("document_id", "start_page", "_r.*")
    out = out.join(r, ["document_id", "start_page"], "left")
    region, kind = F.col("region_type"), F.col("section_type")
    out = once(out, pin=F.when(region == "appendix", appendix_article_reason()), toc_row=toc_like_row(), pointer=pointer_slice(), legal=F.when(kind == "legal_reference", legal_reason()), inline=F.when(kind == "article", inline_reference()))
    out = _ends(out.drop("slice", "slice_lines", "tail_lines", "body"), texts, placed)
    thin = F.col("own_chars") < APPENDIX_BODY
    front, explicit = region.isin(FRONT), kind.isin("toc", "guide") & F.exists("evidence", lambda e: e.rlike("^pattern:(toc_heading|customer_rights_heading)"))
    token = lambda t: F.array(F.lit(f"filter:{t}"))
    seen = F.when(region.isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("page_region:"), region), F.concat(F.lit("page_region_confidence:"), four_places(F.col("region_confidence")))), F.transform("region_evidence", lambda e: F.concat(F.lit("region_evidence:"), e))))
    rated = F.array(F.concat(F.lit("candidate_rule_confidence:"), four_places(F.col("confidence"))))
    verdict = lambda emit, *trace: F.struct(F.lit(emit).alias("emit"), F.concat(*trace).alias("trace"))
    base = (
        F.when(F.col("toc_row"), verdict(False, rated, token("toc_like_candidate_backstop"), seen))
        .when(F.col("pointer"), verdict(False, rated, token("pointer_reference_heading_slice"), seen))
        .when(region.isNull(), verdict(True, rated, token("missing_region_default_keep")))
        .when(~front, verdict(True, rated, seen, token("not_front_matter_region_keep")))
        .when(kind.isin(STRUCTURE), verdict(False, rated, seen, F.array(F.concat(F.lit("filter:suppress_structure_on_front_matter:"), region))))
        .when(explicit, verdict(True, rated, seen, token("keep_explicit_toc_guide_heading")))
        .otherwise(verdict(False, rated, seen, token("suppress_non_structural_on_front_matter")))
    )
    out = once(out, base=base)
    later = (
        F.when((kind == "appendix") & thin, F.lit("filter:appendix_insufficient_substantive_body"))
        .when(kind == "legal_reference", F.col("legal"))
        .when((kind == "article") & F.col("pin").isNotNull(), F.col("pin"))
        .when((kind == "article") & F.col("inline"), F.lit("filter:article_inline_clause_reference_heading"))
    )
    out = out.withColumn("later", F.when(F.col("base.emit"), later))
    emit = F.col("base.emit") & F.col("later").isNull()
    lift = F.when(~emit, F.greatest(F.col("confidence") - 0.5, F.lit(0.0))).when(kind.isin("part", "article") & (region == "policy_body"), F.least(F.col("confidence") + 0.12, F.lit(1.0))).when(kind.isin("part", "article") & (region == "unknown"), F.least(F.col("confidence") + 0.02, F.lit(1.0))).otherwise(F.col("confidence"))
    trace = F.when(F.col("later").isNull(), F.col("base.trace")).otherwise(F.array_append("base.trace", F.col("later")))
    return out.select(*found.columns, emit.alias("emit"), trace.alias("trace"), lift.alias("assembly_confidence"), "next_mark")


def assemble(verdicts: DataFrame, texts: DataFrame, line_table: DataFrame | None = None) -> DataFrame:
    """Sections: the text from each accepted candidate to the next accepted one, an appendix at most to the first marker within."""
    placed = text_lines(texts) if line_table is None else line_table
    placed = placed if "own" in placed.columns else owned(verdicts, placed)
    by = W_.partitionBy("document_id").orderBy("start_char_offset")
    upto = by.rowsBetween(W_.unboundedPreceding, 0)
    start, kind = F.col("start_char_offset"), F.col("section_type")
    # a candidate that isn't accepted belongs to the accepted one before
    every = verdicts.select("document_id", start.alias("own"), F.last(F.when(F.col("emit"), start), True).over(upto).alias("_section")).where("_section is not null")
    kept = verdicts.where("emit").withColumns({"number": F.row_number().over(by) - 1, "next": F.lead("start_char_offset").over(by)}).join(lengths(texts), "document_id")
    end = F.coalesce("next", "total_len")
    kept = kept.withColumn("end_char_offset", F.when((kind == "appendix") & (F.col("next_mark") < end), F.col("next_mark")).otherwise(end))
    kept = kept.withColumn("section_id", F.format_string("%s::sec::%04d", "document_id", "number"))
    kept = kept.withColumn("part", F.last(F.when(kind == "part", F.col("section_id")), ignorenulls=True).over(upto))
    owners = every.join(kept.select("document_id", start.alias("_section"), F.col("end_char_offset").alias("_end")), ["document_id", "_section"])
    body = placed.where("rank = 2").join(owners, ["document_id", "own"]).where(F.col("at") < F.col("_end"))
    body = _joined(body, "document_id", "_section").select("document_id", F.col("_section").alias("start_char_offset"), F.col("slice").alias("text"))
    kept = kept.join(body, ["document_id", "start_char_offset"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    end = F.col("end_char_offset")
    kept = with_page(kept, texts, F.when(end > start, end - 1).otherwise(start), "page")
    return kept.select(
        "document_id",
        "section_id",
        "section_type",
        "title",
        "start_page",
        F.greatest("start_page", "page").alias("end_page"),
        "start_char_offset",
        "end_char_offset",
        F.when(kind == "article", F.col("part")).alias("parent_section_id"),
        strip("text").alias("text"),
        F.least(F.greatest("assembly_confidence", F.lit(0.0)), F.lit(1.0)).alias("assembly_confidence"),
        F.concat("trace", F.array(F.lit("assembly:substring_slice"), F.concat(F.lit("candidate_id:"), "candidate_id"))).alias("assembly_evidence"),
    )


def detect(pages: DataFrame, classifier=classify) -> DataFrame:
    """Sections of pages with their policy units. classifier: pages to (document_id, page_number, region_type, confidence, evidence)."""
    pages = stored(with_page_start(pages), "pages")
    texts = stored(outline(pages), "outline")
    line_table = stored(lines(pages, all_pages=True), "lines")
    marked = stored(markers(texts, line_table), "markers")
    found = stored(candidates(line_table), "candidates")
    placed = stored(owned(found, line_table, marked), "placed-lines")
    verdicts = stored(judged(found, stored(classifier(pages.drop("page_start")), "regions"), texts, marked, placed), "verdicts")
    return attach(assemble(verdicts, texts, placed), units(texts, marked, line_table))
