"""The retrieval service without a web server: calls that return (status, body), and the whole build from pages to an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.embedders import Embedder, ModularEmbedder
from evidex.functions.text import prefixed
from evidex.operators import chunking, identity, search, sections
from evidex.sources.tables import stored
from evidex.sources.writers import build_index, read_index


def build(pages: DataFrame, folder: str, embedder: Embedder, config: chunking.ChunkingConfig = chunking.ChunkingConfig()) -> dict:
    """Sections, chunks and the index of pages; returns the index's config."""
    return build_index(chunking.chunks(sections.detect(pages), config), folder, embedder)


def query_text(spark: SparkSession, text: str) -> str:
    return spark.range(1).select(prefixed(F.lit(text), "query")).first()[0]


def citation_context(spark: SparkSession, folder: str, query: str, embedder: Embedder, filters: search.SearchFilters = search.SearchFilters(), top_k: int = 5, dedupe_section: bool = False) -> dict:
    """query, filters, top_k, dedupe_section and citations C1, C2, ... Nothing eligible, or an index of another model: ValueError."""
    index, config = read_index(spark, folder)
    if embedder.model_name != config["model_name"]:
        raise ValueError(f"embedder model {embedder.model_name!r} does not match index config model {config['model_name']!r}")
    vector = embedder.query(query_text(spark, query))
    if len(vector) != config["embedding_dim"]:
        raise ValueError(f"query embedding dim {len(vector)} != index dim {config['embedding_dim']}")
    # top_k rows at most
    cited = [r.asDict() for r in search.citations(search.search(index, [float(v) for v in vector], top_k, filters, dedupe_section)).collect()]
    if not cited:
        raise ValueError("no chunks matched metadata and section filters; widen filters or rebuild the index")
    return {"query": query, "filters": filters.snapshot(), "top_k": top_k, "dedupe_section": dedupe_section, "citations": sorted(cited, key=lambda c: int(c["citation_id"][1:]))}


def health() -> tuple[int, dict]:
    return 200, {"status": "ok"}


def options(spark: SparkSession, folder: str, most: int = 10_000) -> tuple[int, dict]:
    """The values that searches can filter by, the first `most` of each kind, as a menu shows them; `more` says how many of a kind are left out."""
    if not folder.strip():
        return 422, {"detail": "index_dir must be non-empty"}
    try:
        index, _ = read_index(spark, folder.strip())
    except FileNotFoundError as e:
        return 404, {"detail": str(e)}
    found = stored(identity.filter_options(index), "options")
    counts = {r["dimension"]: r["count"] for r in found.groupBy("dimension").count().collect()}
    names = ("insurers", "product_types", "product_names", "variant_names", "policy_unit_names")
    # each task keeps its own first values; `most` of a kind come to the driver
    first = {n: found.where(F.col("dimension") == n).orderBy("value").limit(most).collect() for n in names}
    menus = {n: [{"value": r["value"], "label": r["label"]} for r in rows] for n, rows in first.items()}
    more = {d: n - most for d, n in counts.items() if n > most}
    return 200, menus | ({"more": more} if more else {})


def context(spark: SparkSession, request: dict, embedder: Embedder | None = None, runner: Callable[..., dict] = citation_context) -> tuple[int, dict]:
    """A request (query, index_dir, filters, top_k 1 to 100, dedupe_section) answered; an empty include list is none."""
    query, folder, k = (request.get("query") or "").strip(), (request.get("index_dir") or "").strip(), request.get("top_k", 5)
    if not query or not folder or not isinstance(k, int) or not 1 <= k <= 100:
        return 422, {"detail": "query and index_dir must be non-empty and top_k in 1 to 100"}
    raw = dict(request.get("filters") or {})
    include, exclude = raw.pop("include_section_types", None), raw.pop("exclude_section_types", None)
    try:
        filters = search.SearchFilters(**{n: v.strip() if isinstance(v, str) else v for n, v in raw.items()}, include_section_types=frozenset(include) if include else None, exclude_section_types=frozenset(exclude or ()))
        return 200, runner(spark, folder, query, embedder or ModularEmbedder(), filters, k, bool(request.get("dedupe_section", False)))
    except FileNotFoundError as e:
        return 404, {"detail": str(e)}
    except (ValueError, TypeError) as e:
        return 400, {"detail": str(e)}
    except OSError as e:
        return 500, {"detail": f"index read failed: {e}"}
    except Exception:
        return 500, {"detail": "retrieval failed"}
