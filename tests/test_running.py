"""Running columns by segments against plain windows, and long documents over many tasks."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.operators import chunking, layout, regions, sections, units
from evidex.operators.running import running
from evidex.sources import readers

PROSE = "회사는 보험기간 중 피보험자에게 약관에서 정한 사유가 생긴 때에 보험수익자에게 약정한 보험금을 지급합니다. " * 3


def test_against_plain_windows(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "c"]), at, rng.randrange(3), rng.choice([None, *range(5)]), at % 7 or None) for at in rng.sample(range(-50, 3000), 900)]
    rows += [("b", None, 0, 4, 1), ("only", 5, 0, None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "document_id string, at long, tie int, v int, w long, i int").repartition(5)
    by = W.partitionBy("document_id").orderBy("at", "tie")
    behind = by.rowsBetween(1, W.unboundedFollowing)
    plain = df.withColumns(
        {
            "total": F.coalesce(F.sum("v").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"),
            "number": (F.row_number().over(by) - 1).cast("long"),
            "last": F.last("w", True).over(by.rowsBetween(W.unboundedPreceding, 0)),
            "next": F.first("w", True).over(behind),
            "following": F.lead("i").over(by),
        }
    )
    want = sorted(map(tuple, plain.collect()), key=repr)
    for span in (1, 7, 100, 1 << 40):
        found = running(df, "at", ("tie",), {"total": F.col("v"), "number": F.lit(1)}, {"last": F.col("w")}, {"next": F.col("w"), "following": F.col("i")}, span=span)
        assert sorted(map(tuple, found.select(*plain.columns).collect()), key=repr) == want


def test_names_that_are_there_already(spark):
    """A made column takes the place of one of its name."""
    df = spark.createDataFrame([("a", i, 9) for i in range(5)], "document_id string, at long, total int")
    got = running(df, "at", sums={"total": F.col("at")}, span=2).orderBy("at").collect()
    assert [r.total for r in got] == [0, 0, 1, 3, 6]


def test_one_document_is_many_tasks(spark):
    """Lines of one document are dealt over all tasks, and sections, units and chunks are those of short segments and of one."""
    texts = [f"제{i}관 총칙\n제{i}조 (목적)\n" + "\n".join(f"{PROSE} {i} {j}" for j in range(30)) for i in range(1, 60)]
    texts[20] = "무배당 연금보험(적립형) 약관\n" + texts[20]
    texts[40] = "무배당 연금보험(거치형)\n약 관\n" + texts[40]
    pages = spark.createDataFrame([("doc", i, t, len(t), "test") for i, t in enumerate(texts, 1)], readers.PAGE)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = layout.lines(pages, all_pages=True)
        placed = running(lines, "offset", nexts={"after": F.col("line")}, span=4096)
        assert placed.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    found = sections.detect(pages).orderBy("start_char_offset").collect()
    assert [r.section_id for r in found] == [f"doc::sec::{k:04d}" for k in range(2 * 59)]
    assert found[3].text.startswith("제2조 (목적)") and found[3].text.endswith("2 29") and found[3].parent_section_id == "doc::sec::0002"
    assert {r.variant_name for r in found} == {None, "적립형", "거치형"}


def test_lines_of_pages_are_lines_of_the_text(spark):
    """Empty pages, pages that share a number, and pages without any line break."""
    rows = [("a", 1, "x\n\ny"), ("a", 2, ""), ("a", 3, "z\n"), ("a", 3, "b"), ("b", 5, ""), ("c", 1, "one")]
    pages = spark.createDataFrame([(d, p, t, len(t), "t") for d, p, t in rows], readers.PAGE)
    of_pages = {(r.document_id, r.offset, r.line) for r in layout.lines(pages, all_pages=True).collect()}
    of_texts = {(r.document_id, r.offset, r.line) for r in layout.text_lines(layout.full_text(pages)).collect()}
    assert of_pages == of_texts and ("a", 6, "b") in of_pages
    asked = spark.createDataFrame([(d, o) for d in "abc" for o in (-3, 0, 1, 4, 5, 6, 8, 9, 99)], "document_id string, o long")
    by = [{(r.document_id, r.o): r.page for r in layout.with_page(asked, t, F.col("o"), "page").collect()} for t in (layout.outline(pages), layout.full_text(pages))]
    assert by[0] == by[1] and by[0]["a", 99] == 3 and by[0]["b", 99] == 5


def test_labels_of_a_repeated_page(spark):
    """The last label counts, whole."""
    text = "제1조 (목적)\n" + PROSE
    pages = spark.createDataFrame([("d", 1, text, len(text), "t")], readers.PAGE)
    label = "document_id string, page_number int, region_type string, confidence double, evidence array<string>, position int"
    for first, last, emit in (("toc", "policy_body", True), ("policy_body", "toc", False)):
        given = spark.createDataFrame([("d", 1, first, 0.9, ["x"], 0), ("d", 1, last, 0.1, ["y"], 1)], label)
        texts, lines = layout.outline(pages), layout.lines(pages, all_pages=True)
        (got,) = sections.judged(sections.candidates(lines), given, texts, units.markers(texts, lines), lines).collect()
        assert got.emit == emit and f"page_region:{last}" in got.trace and "region_evidence:y" in got.trace


def test_sections_are_numbered_by_place(spark):
    """Ids of more than 9,999 sections don't sort as numbers do."""
    n = 10_002
    rows = spark.range(n).selectExpr("'d' document_id", "format_string('d::sec::%04d', id) section_id", "'article' section_type", "'t' title", "1 start_page", "1 end_page", "id * 10 start_char_offset", "id * 10 + 5 end_char_offset", "cast(null as string) parent_section_id", "'body' text", "cast(null as string) policy_unit_id", "cast(null as string) policy_unit_name", "cast(null as string) variant_name")
    got = {r.section_id: r.chunk_id for r in chunking.chunks(rows).select("section_id", "chunk_id").collect()}
    assert len(got) == n and all(got[f"d::sec::{k:04d}"] == f"d::chunk::{k:04d}::000" for k in range(n))
