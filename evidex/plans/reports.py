"""Reports for people from small, already aggregated results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SHOWN = 50


def _table(rows: list[tuple], head: tuple) -> list[str]:
    cell = lambda v: "(none)" if v is None else str(v).replace("\n", " ").replace("|", "\\|")
    return [f"| {' | '.join(head)} |", f"| {' | '.join('---' for _ in head)} |", *(f"| {' | '.join(map(cell, r))} |" for r in rows)]


def listed(pages: list[Row], most: int = SHOWN) -> str:
    """Suspicious pages as p3(empty), ..., the rest as a number."""
    shown = ", ".join(f"p{p['page_number']}({p['reason']})" for p in pages[:most])
    return (shown + (f" … (+{len(pages) - most} more)" if len(pages) > most else "")) or "(none)"


def ingestion_report(per_document: DataFrame, corpus: DataFrame, suspicious: DataFrame, most: int = 1000) -> str:
    """Markdown over the corpus and up to `most` documents, those with the most low pages first, and how many more there are."""
    total = corpus.first()
    ordered = per_document.orderBy(F.desc("low_pages"), "document_id")
    worst, more = _first(ordered, most)
    pages: dict[str, list] = {}
    for r in suspicious.join(ordered.limit(most).select("document_id"), "document_id").orderBy("document_id", "page_number").collect():
        pages.setdefault(r["document_id"], []).append(r)
    lines = ["# Ingestion quality report", "", *_table(list(total.asDict().items()), ("Metric", "Value")), "", "## Per document", ""]
    for r in worst:
        fields = [(k, f"{v:.2f}" if k == "avg_chars" else v) for k, v in r.asDict().items() if k != "document_id"]
        lines += [f"### `{r['document_id']}`", "", *_table([*fields, ("suspicious_pages", listed(pages.get(r["document_id"], [])))], ("Field", "Value")), ""]
    lines += more
    return "\n".join(lines).rstrip() + "\n"


def run_summary_text(totals: DataFrame, counts: DataFrame, most: int = 1000) -> str:
    """A chunking run for a terminal, from run_totals and run_summary: totals, then up to `most` keys of each kind and how many more there are."""
    t = totals.first()
    lines = ["chunking run", f"  documents_processed: {t['documents_processed']}", f"  total_chunks: {t['total_chunks']}", f"  average_chars_per_chunk: {t['average_chars']:.1f}", f"  max_chars_per_chunk: {t['max_chars']}"]
    for kind, title in (("document", "chunks_per_document"), ("section_type", "chunks_by_section_type"), ("variant", "chunks_by_variant_name")):
        rows, more = _first(counts.where(counts["kind"] == kind).orderBy("key"), most)
        lines += [f"  {title}:", *(f"    - {r['key']}: {r['n']}" for r in rows), *more]
    return "\n".join(lines) + "\n"


def _first(rows: DataFrame, most: int) -> tuple[list[Row], list[str]]:
    """The first rows, and a line that says how many are left out, if any are."""
    shown = rows.limit(most).collect()
    left = rows.count() - most if len(shown) == most else 0
    return shown, [f"… (+{left} more)"] if left > 0 else []


def chunk_report(inspected: DataFrame, groups: DataFrame, largest: DataFrame) -> str:
    lines = ["# Chunk report", "", *_table(list(inspected.first().asDict().items()), ("Metric", "Value")), ""]
    for kind in ("section_type", "variant", "strategy"):
        rows, more = _first(groups.where(groups["kind"] == kind).orderBy("key"), 1000)
        lines += [f"## By {kind}", "", *_table([(r["key"], r["n"]) for r in rows], (kind, "chunks")), *more, ""]
    return "\n".join([*lines, "## Largest", "", *_table([tuple(r) for r in largest.collect()], ("document", "chunk", "type", "characters"))]) + "\n"


def evaluation_report(per_query: DataFrame, summary: DataFrame) -> str:
    """Markdown: the rates, a row a query, and what the queries that failed found. A query passes if it hit within rank 5 and all hits met the filters. A query set is a bounded list."""
    rows = [r.asDict() for r in per_query.orderBy("id").collect()]
    first = lambda r: next((f"rank {k}" for k in (1, 3, 5) if r[f"pass_at_{k}"]), "no")
    passed = lambda r: r["pass_at_5"] and r["all_filters_matched"]
    total = summary.first()
    rates = ", ".join(f"**hit@{k}:** {total[f'hit_at_{k}']:.3f}" for k in (1, 3, 5))
    lines = ["# Evaluation", "", f"{total['total_queries']} queries, {rates}", "", *_table([(r["id"], "passed" if passed(r) else "failed", first(r), r["all_filters_matched"]) for r in rows], ("Query", "Result", "Hit within", "Filters met")), ""]
    for r in rows:
        if not passed(r):
            lines += [f"## {r['id']}", "", r["note"], "", *_table([(i, *x) for i, x in enumerate(zip(r["top_types"], r["top_titles"]), 1)], ("Rank", "Type", "Title")), ""]
    return "\n".join(lines).rstrip() + "\n"


def hit_lines(hits: list[Row]) -> str:
    """Ranked hits for a terminal: score to four places, <null> for what is missing, 240 characters of text."""
    out = []
    for h in hits:
        text = h["text"].replace("\n", " ")
        text = text[:237] + "..." if len(text) > 240 else text
        out.append(f"[{h['rank']}] {h['score']:.4f} {h['section_title']} ({h['section_type']}) {h['variant_name'] or '<null>'} p{h['page_start']}-{h['page_end']}\n    {text}")
    return "\n".join(out) + "\n"


def staging_preview(row: Row) -> str:
    """What was inferred for a staged file, as a table of fields."""
    if row["reason"]:
        return f"## {row['filename']}\n\nstatus: skipped, {row['reason']}\n\n"
    fields = [(n, f["value"], f["confidence"], f["evidence"], "yes" if f["needs_review"] else "") for n, f in row["inference"].items()]
    lines = [f"## {row['filename']}", "", f"status: ok, id {row['entry_document_id']}, from {row['entry_source_file']}", "", *_table(fields, ("Field", "Value", "Confidence", "Evidence", "Review"))]
    return "\n".join([*lines, "", *[row["entry_notes"], ""] * bool(row["entry_notes"])]) + "\n"


def bundle_json(bundle: dict) -> str:
    return json.dumps(bundle, ensure_ascii=False, indent=2) + "\n"
