"""Filtered similarity search over an index of chunks with vectors, for one query or many, and citations of the hits.

An index has one row per chunk: row_idx, the chunk's metadata and `embedding`. Scores are dot products in double precision of
vectors of length one. Ties go to the smaller row_idx. Each task keeps its own best rows before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.functions.text import casefold
from evidex.sources.folders import uri
from evidex.sources.tables import shared_path

#: Section types that searches leave out unless told otherwise.
DEFAULT_EXCLUDED = ("toc", "cover", "guide", "summary")

QUERY_BLOCK = 1024
#: Rows of an index that meet a block of queries at a time, and pairs of the two that are scored at a time.
ROWS_AT_ONCE, MET = 1024, 1 << 16
#: By how much a matrix product may differ from the exact sum.
CLOSE = 1e-6


@dataclass(frozen=True)
class SearchFilters:
    document_id: str | None = None
    insurer: str | None = None
    product_type: str | None = None
    product_name: str | None = None
    policy_unit_name: str | None = None
    variant_name: str | None = None
    include_section_types: frozenset[str] | None = None
    exclude_section_types: frozenset[str] = field(default_factory=frozenset)
    use_default_section_type_excludes: bool = True

    def predicate(self) -> Column:
        """What rows pass. An include set replaces the default exclusions; the exclude set always holds."""
        kind = F.col("section_type")
        test = F.lit(True)
        if self.include_section_types is not None:
            test = kind.isin(*sorted(self.include_section_types)) if self.include_section_types else F.lit(False)
        elif self.use_default_section_type_excludes:
            test = ~kind.isin(*DEFAULT_EXCLUDED)
        if self.exclude_section_types:
            test = test & ~kind.isin(*sorted(self.exclude_section_types))
        if self.document_id is not None:
            test = test & (F.col("document_id") == self.document_id)
        for name in ("insurer", "product_type"):
            if (value := getattr(self, name)) is not None:
                test = test & (casefold(name) == casefold(F.lit(value)))
        if self.product_name is not None:
            test = test & F.contains(casefold(F.coalesce("product_name", F.lit(""))), casefold(F.lit(self.product_name)))
        for name in ("policy_unit_name", "variant_name"):
            if (value := getattr(self, name)) is not None:
                test = test & F.contains(casefold(name), casefold(F.lit(value)))
        return F.coalesce(test, F.lit(False))

    def snapshot(self) -> dict:
        sets = {"include_section_types": None if self.include_section_types is None else sorted(self.include_section_types), "exclude_section_types": sorted(self.exclude_section_types)}
        names = ("document_id", "insurer", "product_type", "product_name", "policy_unit_name", "variant_name")
        return {n: getattr(self, n) for n in names} | sets | {"use_default_section_type_excludes": self.use_default_section_type_excludes}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(index: DataFrame, vector: list[float] | Column, top_k: int = 5, filters: SearchFilters = SearchFilters(), dedupe_section: bool = False) -> DataFrame:
    """The best rows with rank (from 1) and score; at least one is asked for, whatever top_k says."""
    q = vector if isinstance(vector, Column) else F.array(*[F.lit(float(v)) for v in vector])
    scored = index.where(filters.predicate()).withColumn("score", dot(F.col("embedding"), q))
    k = max(top_k, 1)
    if dedupe_section:
        # sections meet by number and score alone; the k rows that are left, a bounded broadcast, find their texts again
        best = scored.groupBy("section_id").agg(F.max(F.struct("score", (-F.col("row_idx")).alias("i"))).alias("r"))
        first = best.select((-F.col("r.i")).alias("row_idx"), "r.score").orderBy(F.desc("score"), "row_idx").limit(k).select("row_idx")
        scored = scored.join(F.broadcast(first), "row_idx", "left_semi")
    best = scored.orderBy(F.desc("score"), "row_idx").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "row_idx")))


class _Block:
    """A block of queries and, of all index rows seen so far, at most top_k of each: their scores, numbers and sections."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows[c].combine_chunks()
        self.ids, self.top = column("query_id"), column("top_k").to_numpy()
        self.vectors = column("vector").flatten().to_numpy().reshape(len(rows), -1)
        self.section = np.array(column("dedupe_section").to_pylist(), bool)
        asked = list(zip(*(column(c).to_pylist() for c in ("insurer", "product_type", "variant_name"))))
        self.wanted = sorted(set(asked), key=repr)
        self.which = np.array([self.wanted.index(x) for x in asked])
        self.least = np.full(len(rows), -np.inf)
        none = np.zeros(0, np.int64)
        self.held = (none, np.zeros(0), none, np.zeros(0, object))

    def meet(self, row_idx: np.ndarray, sections: np.ndarray, facets: list[np.ndarray], vectors: np.ndarray) -> None:
        found_q, found_r = [], []
        code = np.unique(sections.astype(str), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        for f, (insurer, kind, variant) in enumerate(self.wanted):
            fine = np.ones(len(row_idx), bool)
            for want, have in ((insurer, facets[0]), (kind, facets[1])):
                fine &= True if want is None else have == want
            if variant is not None:
                fine &= np.array([v is not None and variant in v for v in facets[2]], bool)
            rows = order[fine[order]]
            if not len(rows):
                continue
            first = np.flatnonzero(np.append(True, code[rows][1:] != code[rows][:-1]))
            for section in (False, True):
                for k in np.unique(self.top[(self.which == f) & (self.section == section)]):
                    asking = np.flatnonzero((self.which == f) & (self.section == section) & (self.top == k))
                    scores = self.vectors[asking] @ vectors[rows].T
                    best = np.maximum.reduceat(scores, first, axis=1) if section else scores
                    least = np.partition(best, -k, axis=1)[:, -k] if best.shape[1] >= k else np.full(len(asking), -np.inf)
                    # products of matrices differ a little from sums in order, which decide below
                    q, r = np.nonzero(scores >= np.maximum(least, self.least[asking])[:, None] - CLOSE)
                    found_q.append(asking[q])
                    found_r.append(rows[r])
        if not found_q or not sum(map(len, found_q)):
            return
        q, r = np.concatenate(found_q), np.concatenate(found_r)
        for i in range(0, len(q), MET):
            self._keep(q[i : i + MET], r[i : i + MET], row_idx, sections, vectors)

    def _keep(self, q: np.ndarray, r: np.ndarray, row_idx: np.ndarray, sections: np.ndarray, vectors: np.ndarray) -> None:
        score = np.zeros(len(q))
        for d in range(vectors.shape[1]):
            score += vectors[r, d] * self.vectors[q, d]
        q, score, rows, names = (np.concatenate(x) for x in zip(self.held, (q, score, row_idx[r], sections[r])))
        own = np.where(self.section[q], np.unique(names.astype(str), return_inverse=True)[1], -1 - rows)
        order = np.lexsort((rows, -score, own, q))
        first = np.append(True, (q[order][1:] != q[order][:-1]) | (own[order][1:] != own[order][:-1]))[: len(order)]
        best = order[first]
        best = best[np.lexsort((rows[best], -score[best], q[best]))]
        begins = np.flatnonzero(np.append(True, q[best][1:] != q[best][:-1]))
        place = np.arange(len(best)) - np.repeat(begins, np.diff(np.append(begins, len(best))))
        kept = best[place < self.top[q[best]]]
        full = best[place == self.top[q[best]] - 1]
        self.least[q[full]] = score[full]
        self.held = (q[kept], score[kept], rows[kept], names[kept])


def _best_of_part(folder: str):
    """For mapInArrow over (row_idx, section_id, insurer, product_type, variant_name, embedding): query_id, row_idx, section_id, score, top_k, dedupe_section of the rows of a task that may be among a query's best, at most top_k a query.

    Blocks of queries lie as files in `folder`. The task's rows are read once; a run of them meets one block after the other, and
    a row is looked at closely only if it reaches the last place that the query has so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
        blocks: list[_Block] = []
        for b in batches:
            for i in range(0, len(b), ROWS_AT_ONCE):
                part = b.slice(i, ROWS_AT_ONCE)
                blocks = blocks or [_Block(t) for t in (pq.read_table(f, filesystem=store) for f in files) if len(t)]
                facets = [np.array(part.column(i).to_pylist(), object) for i in (2, 3, 4)]
                vectors = part.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                for block in blocks:
                    block.meet(part.column(0).to_numpy(zero_copy_only=False), np.asarray(part.column(1).to_pylist(), object), facets, vectors)
        for block in blocks:
            q, score, row_idx, sections = block.held
            columns = [block.ids.take(pa.array(q)), pa.array(row_idx), pa.array(sections, pa.string()), pa.array(score), pa.array(block.top[q]), pa.array(block.section[q])]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "row_idx", "section_id", "score", "top_k", "dedupe_section"])

    return run


def search_many(index: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """Hits of many queries (id, vector, top_k, dedupe_section and nullable insurer, product_type, variant_name): query id, rank, score and the index's columns.

    Queries are written in blocks of about `block`; the index is read once, whatever their number. Each task hands on at most
    top_k rows of a query with their exact scores, which are ranked together.
    """
    facets = ("insurer", "product_type", "variant_name")
    asked = queries.select(F.col("id").alias("query_id"), F.transform("vector", lambda v: v.cast("double")).alias("vector"), F.greatest("top_k", F.lit(1)).alias("top_k"), F.coalesce(F.col("dedupe_section").cast("boolean"), F.lit(False)).alias("dedupe_section"), *[casefold(c).alias(c) for c in facets])
    eligible = index.where(SearchFilters().predicate())
    rows = eligible.select("row_idx", "section_id", *[casefold(c).alias(c) for c in facets], "embedding")
    folder = shared_path(index.sparkSession, "queries")
    asked.repartition(max(1, -(-asked.count() // block)), "query_id").write.parquet(folder)
    asked = index.sparkSession.read.schema(asked.schema).parquet(folder)
    kinds = dict(asked.dtypes) | dict(index.dtypes)
    met = rows.mapInArrow(_best_of_part(uri(folder)), f"query_id {kinds['query_id']}, row_idx {kinds['row_idx']}, section_id string, score double, top_k {kinds['top_k']}, dedupe_section boolean")
    order = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), "row_idx")
    own = F.when(F.col("dedupe_section"), F.col("section_id")).otherwise(F.col("row_idx").cast("string"))
    first = met.withColumn("_n", F.row_number().over(order("query_id", own))).where("_n = 1").drop("_n", "section_id")
    # only a query's last hits meet the index again
    hits = first.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= F.col("top_k"))
    return hits.join(eligible.drop("embedding"), "row_idx").select("query_id", *[c for c in index.columns if c != "embedding"], "top_k", "dedupe_section", "score", "rank")


CITED = ["chunk_id", "section_id", "section_title", "section_type", "document_id", "insurer", "product_type", "insurer_display_name", "product_type_display_name", "product_display_name", "policy_unit_name", "variant_name", "page_start", "page_end", "char_start", "char_end"]


def citations(hits: DataFrame) -> DataFrame:
    """citation_id (C1, C2, ...), metadata, score and text of ranked hits."""
    return hits.select(F.concat(F.lit("C"), F.col("rank")).alias("citation_id"), *CITED, "score", "text")
