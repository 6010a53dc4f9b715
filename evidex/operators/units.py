"""Product variants (policy units): markers in the full text, the spans between them, and which section lies in which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W_
from pyspark.sql import functions as F

from evidex.functions.text import B, W, strip
from evidex.operators.layout import as_of, lengths, text_lines, with_pages

# Markers and patterns that decide results.
VARIANTS = "적립형|거치형|즉시형"
SKIPPED = rf"^제{W}*\d+{W}*(?:조|관){B}|^[(（]{W}*별표"
ONE_LINE = rf"^(.+)\(({VARIANTS})\){W}*약{W}*관{W}*$"
TWO_LINES = rf"^(.+)\(({VARIANTS})\){W}*$"
SECOND_LINE = rf"^약{W}*관{W}*$|^제{W}*1{W}*관"
TAIL_HEADING = rf"(?m)^{W}*(?:약관에서{W}*인용(?:한|된){W}*법(?:[\s·.]*규정|{W}*령)?|보험용어{W}*해설|관련{W}*법규)(?:{W}|$|[.:：])"
TAIL_WORDS = ["약관에서인용된법령", "약관에서인용한법·규정", "약관에서 인용한 법·규정", "약관에서 인용된 법령", "보험용어해설", "보험용어 해설", "관련법규"]


def markers(texts: DataFrame, line_table: DataFrame | None = None) -> DataFrame:
    """document_id, offset, name, variant of every marker in full texts (document_id, full_text) or their lines; repeats of the one before are dropped."""
    lines = text_lines(texts) if line_table is None else line_table
    s, behind = strip("line"), F.col("offset") + F.length("line") + 1
    likely = lines.select("document_id", "offset", s.alias("s"), behind.alias("_below")).where(~F.col("s").rlike(SKIPPED) & (F.col("s").rlike(ONE_LINE) | F.col("s").rlike(TWO_LINES)))
    # few lines are of either kind, so that a line meets the one below by where that begins
    below = lines.where(s.rlike(SECOND_LINE)).select("document_id", F.col("offset").alias("_below"), F.lit(True).alias("_second")).distinct()
    placed = likely.join(below, ["document_id", "_below"], "left")
    one, two = F.col("s").rlike(ONE_LINE), F.col("s").rlike(TWO_LINES) & F.coalesce("_second", F.lit(False))
    pick = lambda g: F.when(one, F.regexp_extract("s", ONE_LINE, g)).otherwise(F.regexp_extract("s", TWO_LINES, g))
    hits = placed.where(one | two).select("document_id", "offset", strip(pick(1)).alias("name"), pick(2).alias("variant"))
    by = W_.partitionBy("document_id").orderBy("offset")
    again = F.lag("name").over(by).eqNullSafe(F.col("name")) & F.lag("variant").over(by).eqNullSafe(F.col("variant"))
    return hits.withColumn("again", again).where(~F.col("again")).drop("again")


def tail_offset(text: Column, start: Column) -> Column:
    """The first place at or after `start` where matter common to all variants begins, or null."""
    rest = F.substr(text, start + 1)
    # a heading's match begins at a line's start, so the line of `start` itself counts from there
    found = [F.regexp_instr(rest, F.lit(TAIL_HEADING)), *[F.locate(w, rest) for w in TAIL_WORDS]]
    return F.array_min(F.filter(F.array(*found), lambda x: x > 0)).cast("long") - 1 + start


def units(texts: DataFrame, marked: DataFrame, line_table: DataFrame | None = None) -> DataFrame:
    """Policy units of full texts (document_id, full_text, total_len, starts), or of an outline and the lines: id, name, variant, both ends (inclusive) and their pages, and the document's tail cutoff."""
    by = W_.partitionBy("document_id").orderBy("offset")
    last = F.col("next").isNull()
    placed = marked.withColumns({"number": F.row_number().over(by) - 1, "next": F.lead("offset").over(by)}).join(lengths(texts), "document_id")
    # only the text from a document's last marker on is looked at
    lines = text_lines(texts) if line_table is None else line_table.select("document_id", "offset", "line")
    behind = lines.join(placed.where(last).select("document_id", F.col("offset").alias("_from")), "document_id").where("offset >= _from")
    behind = behind.groupBy("document_id", "_from").agg(F.array_sort(F.collect_list(F.struct("offset", "line"))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    tails = behind.withColumn("_text", text).select("document_id", (tail_offset(F.col("_text"), F.lit(0)) + F.col("_from")).alias("tail_cutoff"))
    joined = placed.join(tails, "document_id").withColumn("tail", F.when(last, F.col("tail_cutoff")))
    end = F.greatest(F.col("offset"), F.least(F.coalesce(F.col("next"), F.col("total_len")) - 1, F.col("total_len") - 1))
    joined = joined.withColumn("plain_end", end)
    cut = F.col("tail") - 1
    end = F.when(last & (cut >= F.col("offset")) & (cut <= F.col("total_len") - 1), cut).otherwise(F.col("plain_end"))
    joined = joined.withColumn("end_offset", end)
    joined = with_pages(joined.drop("total_len"), texts, {"start_page": "offset", "end_page": "end_offset"})
    return joined.select(
        "document_id",
        F.format_string("%s::pu::%04d", "document_id", "number").alias("policy_unit_id"),
        F.col("name").alias("policy_unit_name"),
        F.col("variant").alias("variant_name"),
        "start_page",
        F.col("offset").alias("start_char_offset"),
        "end_page",
        F.col("end_offset").alias("end_char_offset"),
        "tail_cutoff",
    )


def attach(sections: DataFrame, unit_table: DataFrame) -> DataFrame:
    """sections with policy_unit_id, policy_unit_name, variant_name of the unit that holds their start; none from the tail cutoff on. Units of a document follow one another."""
    names = ("policy_unit_id", "policy_unit_name", "variant_name")
    u = unit_table.select("document_id", F.col("start_char_offset").alias("u_start"), F.col("end_char_offset").alias("u_end"), "tail_cutoff", *names)
    at = F.col("start_char_offset")
    held = as_of(sections.drop(*names), at, u, "u_start", "_u")
    inside = (at <= F.col("_u.u_end")) & (F.col("_u.tail_cutoff").isNull() | (at < F.col("_u.tail_cutoff")))
    return held.withColumns({n: F.when(inside, F.col(f"_u.{n}")) for n in names}).drop("_u")
