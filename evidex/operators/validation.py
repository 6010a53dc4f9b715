"""Rules that rows of artifacts must meet, compiled to one array of violations a row.

Rows hold their fields as text, as JSON writes them, so that a wrong type is told from a missing value. A violation is
`<field>:<what>`: missing, not_an_integer, not_a_number, below_<least>, not_one_of. Whole numbers may be written as text or with
a fraction of zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and bounds that decide results.
SECTION_TYPES = ("guide", "toc", "part", "article", "appendix", "legal_reference", "glossary", "unknown")


@dataclass(frozen=True)
class Model:
    """Fields that must be there; of whole numbers the least value, None where any will do; numbers; fields of few values."""

    required: tuple[str, ...]
    integers: dict[str, int | None] = field(default_factory=dict)
    numbers: tuple[str, ...] = ()
    choices: dict[str, tuple[str, ...]] = field(default_factory=dict)


MODELS = {
    "sections": Model(
        ("document_id", "section_id", "section_type", "title", "start_page", "end_page", "start_char_offset", "end_char_offset"),
        {"start_page": 1, "end_page": 1, "start_char_offset": 0, "end_char_offset": 0},
        ("assembly_confidence",),
        {"section_type": SECTION_TYPES},
    ),
    "chunks": Model(
        ("document_id", "chunk_id", "section_id", "section_type", "section_title", "chunk_index", "text", "page_start", "page_end", "char_start", "char_end", "char_count", "token_estimate", "chunking_strategy", "source_section_char_start", "source_section_char_end"),
        {"chunk_index": 0, "page_start": 1, "page_end": 1, "char_start": 0, "char_end": 0, "char_count": 0, "token_estimate": 0, "source_section_char_start": 0, "source_section_char_end": 0},
        (),
        {"section_type": SECTION_TYPES},
    ),
    "pages": Model(("document_id", "page_number", "text", "char_count", "extraction_method"), {"page_number": 1, "char_count": 0}),
    "documents": Model(("document_id", "page_count", "total_char_count"), {"page_count": 0, "total_char_count": 0}),
}


def whole_number(text: Column) -> Column:
    """The whole number that a text states, or null."""
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("long"), F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.cast("long")))


def violations(of: Column, model: Model) -> Column:
    """What a struct of text fields does not meet, in the order of its rules."""
    said: list[Column] = [F.when(of[name].isNull(), F.lit(f"{name}:missing")) for name in model.required]
    for name, least in model.integers.items():
        number = whole_number(of[name])
        below = F.lit(None) if least is None else F.when(number < least, F.lit(f"{name}:below_{least}"))
        said.append(F.when(of[name].isNotNull() & number.isNull(), F.lit(f"{name}:not_an_integer")).otherwise(below))
    said += [F.when(of[name].isNotNull() & of[name].try_cast("double").isNull(), F.lit(f"{name}:not_a_number")) for name in model.numbers]
    said += [F.when(~F.trim(of[name]).isin(*values), F.lit(f"{name}:not_one_of")) for name, values in model.choices.items()]
    return F.array_compact(F.array(*said))


def typed(of: Column, schema: str) -> Column:
    """A struct of text fields as a struct of a schema's types; arrays stay as they are."""
    made = []
    for one in schema.split(", "):
        name, kind = one.split(" ", 1)
        value = whole_number(of[name]).cast(kind) if kind in ("int", "bigint") else of[name].try_cast(kind) if kind == "double" else of[name]
        made.append(value.alias(name))
    return F.struct(*made)


def as_text(schema: str) -> str:
    """A schema with its numbers as text."""
    return ", ".join(f"{name} {'string' if kind in ('int', 'bigint', 'double') else kind}" for name, kind in (x.split(" ", 1) for x in schema.split(", ")))


def validated(rows: DataFrame, kind: str) -> DataFrame:
    """rows of text fields with their violations."""
    return rows.withColumn("violations", violations(F.struct(*rows.columns), MODELS[kind]))
