"""Command line: python -m evidex <command> ...; folders are read and written by Spark."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from evidex.functions.embedders import Embedder, ModularEmbedder, SentenceTransformerEmbedder
from evidex.operators import chunking, evaluation, quality, sections
from evidex.plans import evaluation_run, ingest_run, reports, service, staging_run
from evidex.sources import folders, readers, writers


def _embedder(name: str | None) -> Embedder:
    return SentenceTransformerEmbedder(name) if name else ModularEmbedder()


def _pages(spark: SparkSession, folder: str):
    return readers.documents(spark, folder).selectExpr("explode(pages) p").select("p.*")


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "sections":
        print(f"{writers.write_artifacts(sections.detect(_pages(spark, a.documents)), a.out, 'sections')} files")
    elif a.command == "chunks":
        found, config = readers.artifacts(spark, a.sections, "sections"), chunking.ChunkingConfig(a.max_chars, a.overlap_chars)
        made = chunking.chunks(found, config)
        documents = found.select("document_id").distinct()
        writers.write_artifacts(made, a.out, "chunks", documents=documents, config=config)
        print(reports.run_summary_text(chunking.run_totals(documents, made), chunking.run_summary(documents, made)), end="")
    elif a.command == "inspect":
        made = readers.artifacts(spark, a.chunks, "chunks")
        print(reports.chunk_report(chunking.inspection(made, limits=readers.chunk_limits(spark, a.chunks)), chunking.inspection_groups(made), chunking.largest(made)), end="")
    elif a.command == "quality":
        found = _pages(spark, a.documents)
        per = quality.document_quality(readers.documents(spark, a.documents), found)
        print(reports.ingestion_report(per, quality.corpus_quality(per), quality.suspicious_pages(found)), end="")
    elif a.command == "index":
        print(json.dumps(writers.build_index(readers.artifacts(spark, a.chunks, "chunks", required=True), a.index, _embedder(a.model))))
    elif a.command == "search":
        facets = {"document_id": a.document_id, "insurer": a.insurer, "product_type": a.product_type, "product_name": a.product_name, "policy_unit_name": a.policy_unit, "variant_name": a.variant, "include_section_types": a.include_type, "exclude_section_types": a.exclude_type}
        filters = {k: v for k, v in facets.items() if v} | {"use_default_section_type_excludes": not a.all_types}
        status, body = service.context(spark, {"query": a.query, "index_dir": a.index, "top_k": a.top_k, "dedupe_section": a.dedupe_section, "filters": filters}, _embedder(a.model))
        print(reports.bundle_json(body), end="")
        return 0 if status == 200 else 1
    elif a.command == "ingest":
        print(f"{ingest_run.ingest(spark, a.manifest, a.root, a.out)} documents")
    elif a.command == "evaluate":
        per = evaluation_run.evaluate(spark, a.index, a.queries, _embedder(a.model))
        report = reports.evaluation_report(per, evaluation.summary(per))
        if a.report:
            folders.replace(os.path.dirname(os.path.abspath(a.report)), os.path.basename(a.report), report.encode())
        print(report, end="")
        return 0 if a.allow_misses or per.where("not pass_at_5 or not all_filters_matched").isEmpty() else 1
    elif a.command == "stage":
        out = staging_run.stage(spark, a.inbox, a.root, apply=a.apply)
        failed = 0
        for row in out.orderBy("path").toLocalIterator():
            print(reports.staging_preview(row), end="")
            failed += bool(row["reason"])
        if not a.apply:
            print("preview only: nothing was copied or written")
        return 3 if failed else 0
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidex", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        return c

    command("sections", "documents", "out")
    c = command("chunks", "sections", "out")
    c.add_argument("--max-chars", type=int, default=2200)
    c.add_argument("--overlap-chars", type=int, default=250)
    command("inspect", "chunks")
    command("quality", "documents")
    command("index", "chunks", "index").add_argument("--model")
    c = command("search", "index", "query")
    for name in ("--document-id", "--insurer", "--product-type", "--product-name", "--policy-unit", "--variant", "--model"):
        c.add_argument(name)
    for name in ("--include-type", "--exclude-type"):
        c.add_argument(name, action="append")
    c.add_argument("--all-types", action="store_true", help="search section types too that are left out unless told otherwise")
    c.add_argument("--top-k", type=int, default=5)
    c.add_argument("--dedupe-section", action="store_true")
    command("ingest", "manifest", "root", "out")
    c = command("evaluate", "index", "queries")
    for name in ("--report", "--model"):
        c.add_argument(name)
    c.add_argument("--allow-misses", action="store_true", help="exit with 0 although a query failed")
    c = command("stage", "inbox", "root")
    c.add_argument("--apply", action="store_true")
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"evidex {a.command}").getOrCreate()
    try:
        return run(spark, a)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
