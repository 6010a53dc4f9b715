"""Full text of a document, where its pages and lines stand in it, and the way back from an offset to a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.operators.running import running


def with_page_start(pages: DataFrame) -> DataFrame:
    """Adds page_start: where a page begins in the pages' texts joined by line breaks. Pages that share a number stand in the order of their texts."""
    if "page_start" in pages.columns:
        return pages
    out = running(pages, "page_number", ("text",), sums={"page_start": F.length("text") + 1}, span=256)
    return out.withColumn("page_start", F.col("page_start").cast("long"))


def outline(pages: DataFrame) -> DataFrame:
    """document_id, page_number, start of every page, and total_len, the length of the document's full text."""
    placed = with_page_start(pages).select("document_id", "page_number", F.col("page_start").alias("start"), (F.col("page_start") + F.length("text")).alias("_end"))
    return placed.join(placed.groupBy("document_id").agg(F.max("_end").alias("total_len")), "document_id").drop("_end")


def as_outline(texts: DataFrame) -> DataFrame:
    """The outline of full texts (document_id, total_len, starts); an outline as it is."""
    if "starts" not in texts.columns:
        return texts
    return texts.select("document_id", "total_len", F.explode("starts").alias("s")).select("document_id", "s.page_number", "s.start", "total_len")


def lengths(texts: DataFrame) -> DataFrame:
    """document_id, total_len of an outline or of full texts."""
    return texts.select("document_id", "total_len") if "starts" in texts.columns else texts.groupBy("document_id").agg(F.max("total_len").alias("total_len"))


def full_text(pages: DataFrame) -> DataFrame:
    """document_id, full_text, total_len, starts (page and its start, in order)."""
    gathered = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<page_number: int, start: bigint>>").alias("starts"))
    walked = F.aggregate(
        "p",
        zero,
        lambda a, x: F.struct((a["at"] + F.length(x["text"]) + 1).alias("at"), F.concat(a["starts"], F.array(F.struct(x["page_number"].cast("int").alias("page_number"), a["at"].alias("start")))).alias("starts")),
    )
    return gathered.select("document_id", text.alias("full_text"), F.length(text).cast("long").alias("total_len"), walked["starts"].alias("starts"))


def page_at(offset: Column, starts: Column, total_len: Column) -> Column:
    """The page of an offset: the last that starts at or before it, after clamping it into the text. For an offset or two of a document; many are looked up by with_page."""
    inside = F.least(F.greatest(offset, F.lit(0)), F.greatest(total_len - 1, F.lit(0)))
    return F.element_at(F.filter(starts, lambda s: s["start"] <= inside), -1)["page_number"]


def as_of(rows: DataFrame, at: Column, marks: DataFrame, mark_at: str, name: str) -> DataFrame:
    """rows (document_id, ...) with `name`: a struct of the columns of the last of marks (document_id, mark_at, ...) that stands at or before `at`, or null.

    Both are sorted together by place within a document and looked through once.
    """
    held = F.struct(*[F.col(c) for c in marks.columns if c != "document_id"])
    both = rows.withColumns({"_at": at.cast("long"), "_row": F.lit(1)}).unionByName(marks.select("document_id", F.col(mark_at).cast("long").alias("_at"), F.lit(0).alias("_row"), held.alias("_mark")), allowMissingColumns=True)
    return running(both, "_at", ("_row",), lasts={name: F.col("_mark")}).where("_row = 1").drop("_at", "_row", "_mark")


def with_page(rows: DataFrame, texts: DataFrame, offset: Column, name: str) -> DataFrame:
    """rows (document_id, ...) of documents in texts with the page of an offset as column `name`. texts: an outline, or full texts with starts.

    Offsets before the text count as its beginning, those behind it as its last character.
    """
    pages = as_outline(texts).where("start < total_len or start = 0")
    return as_of(rows, F.greatest(offset, F.lit(0)), pages.drop("total_len"), "start", "_page").withColumn(name, F.col("_page.page_number")).drop("_page")


def with_pages(rows: DataFrame, texts: DataFrame, offsets: dict[str, str]) -> DataFrame:
    """As with_page for several offset columns at once: new column to offset column. Equal rows become one."""
    asked = rows.select("*", F.posexplode(F.array(*[F.col(c).cast("long") for c in offsets.values()])).alias("_which", "_offset"))
    found = with_page(asked, texts, F.col("_offset"), "_found")
    return found.groupBy(*rows.columns).agg(*[F.max(F.when(F.col("_which") == k, F.col("_found"))).alias(name) for k, name in enumerate(offsets)])


def text_lines(texts: DataFrame) -> DataFrame:
    """document_id, offset, line of the full texts, split at \\n."""
    cut = texts.select("document_id", F.posexplode(F.split("full_text", "\n")).alias("_i", "line"))
    return running(cut, "_i", sums={"offset": F.length("line") + 1}, span=1024).select("document_id", F.col("offset").cast("long").alias("offset"), "line")


def lines(pages: DataFrame, all_pages: bool = False) -> DataFrame:
    """document_id, page_number, line_no, offset (of the line in the full text), line. Split at \\n; an empty page has none, or with all_pages one, as in the full text."""
    placed = with_page_start(pages) if all_pages else with_page_start(pages).where("text <> ''")
    cut = placed.select("document_id", "page_number", "page_start", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = W.partitionBy("document_id", "page_number", "page_start").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    offset = F.col("page_start") + F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    return cut.select("document_id", "page_number", "line_no", offset.alias("offset"), "line")
