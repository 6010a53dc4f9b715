"""Embedding of passages and queries by a pluggable model, passages by Spark in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

#: Characters (or what an embedder counts) of a padded batch, by how much lengths in it may differ, and below which all go together.
CELLS, SLACK, SHORT = 1 << 17, 1.25, 64


class Embedder(Protocol):
    """model_name; passages: texts to rows of unit length; query: a text to a vector of unit length."""

    model_name: str

    def passages(self, texts: list[str]) -> np.ndarray: ...

    def query(self, text: str) -> np.ndarray: ...


class ModularEmbedder:
    """The built-in stand-in: eight dimensions by modular arithmetic over a text's characters, the same on every machine."""

    model_name = "modular-8"
    dim = 8

    def _unit(self, rows: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        return (rows / np.where(norm > 0, norm, 1)).astype(np.float32)

    def passages(self, texts: list[str]) -> np.ndarray:
        sums = np.array([sum(map(ord, t)) for t in texts], np.int64).reshape(-1, 1)
        return self._unit((sums + 31 * np.arange(self.dim)) % 251 / 250)

    def query(self, text: str) -> np.ndarray:
        return self._unit(((len(text) + 13 * np.arange(self.dim)) % 251 / 250)[None, :])[0]


class SentenceTransformerEmbedder:
    """A sentence-transformers model, loaded once a worker; only where that library is installed."""

    def __init__(self, model_name: str = "intfloat/multilingual-e5-small", batch_size: int = 32):
        self.model_name, self.batch_size, self._model = model_name, batch_size, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def _encode(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.model_name)
        return np.asarray(self._model.encode(texts, batch_size=self.batch_size, normalize_embeddings=True), np.float32)

    def passages(self, texts: list[str]) -> np.ndarray:
        return self._encode(texts)

    def query(self, text: str) -> np.ndarray:
        return self._encode([text])[0]


def by_length(lengths: np.ndarray, cells: int = CELLS, slack: float = SLACK) -> Iterator[np.ndarray]:
    """Places of texts in batches of like length, longest first: at most `cells` once padded to the longest (or one text), which is at most `slack` times the shortest, or SHORT."""
    order = np.argsort(-lengths, kind="stable")
    begin = 0
    while begin < len(order):
        longest = max(int(lengths[order[begin]]), 1)
        end = begin + max(1, cells // longest)
        if longest > SHORT:
            end = min(end, begin + int(np.searchsorted(-lengths[order[begin:]], -longest / slack, side="right")))
        yield order[begin : max(end, begin + 1)]
        begin = max(end, begin + 1)


def with_embedding(rows: DataFrame, embedder: Embedder, text: str = "text", profile: ResourceProfile | None = None, cells: int = CELLS) -> DataFrame:
    """rows with `embedding` (array<float>) of a text column; null is the empty text.

    Within an Arrow batch, texts of like length go to the model together, so that little is padded, and their vectors come back in
    the rows' order. An embedder may state `length(text)`, else characters count. profile: resources of the tasks that embed, such
    as a GPU each, where the cluster schedules by stage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = getattr(embedder, "length", len)
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            vectors: list[np.ndarray | None] = [None] * len(texts)
            for part in by_length(np.fromiter(map(length, texts), np.int64, len(texts)), cells):
                for i, v in zip(part.tolist(), embedder.passages([texts[i] for i in part])):
                    vectors[i] = np.asarray(v, np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))]), profile=profile)
