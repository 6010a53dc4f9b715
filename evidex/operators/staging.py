"""Metadata of staged files inferred from their names and the text of their first pages, by ordered rules.

Each inference is a struct (value, confidence, needs_review, evidence) column over `filename` and `head_text`. What several rules
look at is computed once a row (text.once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import W, date_segment, hash8, key_segment, once, single_spaced, split_lines, strip

# Keywords in their order, slugs, patterns.
INSURERS = [("삼성생명", "samsunglife", "high"), ("삼성", "samsunglife", "medium"), ("교보생명", "kyobolife", "high"), ("교보", "kyobolife", "medium"), ("미래에셋생명", "miraeassetlife", "high"), ("미래에셋", "miraeassetlife", "medium")]
DOCUMENT_TYPES = [("보험약관", "policy_terms", "high"), ("약관", "policy_terms", "medium")]
TYPE_WORDS = [("변액연금", "variable_annuity", "변액연금"), ("종신보험|밸런스종신", "whole_life", "종신"), ("암보험|암치료보험", "cancer", "cancer_product_keywords"), ("개인연금|연금보험", "annuity", "연금_product_keywords")]
NAME_WORDS = ["간편통합암보험", "통합암보험", "인터넷암보험", "암치료보험", "변액연금보험", "밸런스종신보험", "교보로연금보험", "개인연금", "연금보험", "종신보험", "암보험"]
SLUGS = ["easy_integrated_cancer_insurance", "integrated_cancer_insurance", "internet_cancer_insurance", "cancer_treatment_insurance", "variable_annuity_insurance", "balance_whole_life_insurance", "kyobo_ro_annuity_insurance", "personal_pension", "annuity_insurance", "whole_life_insurance", "cancer_insurance"]
DISCLAIMER = "저축(연금) 목적"
GENERIC = ["보험약관", "목 차", "목차", "고객권리안내문"]
GENERIC_START = ["본 상품은 보장성보험으로", "목차", "목 차"]
GUIDE_BOOK = "약관 이용 guide book"
TOC_LEAD = rf"[.\x{{b7}}\x{{2024}}\x{{2025}}\x{{2026}}‧…．{W[1:-1]}]"
ISO = r"(20\d{2})-(\d{2})-(\d{2})"
DOTTED = r"(20\d{2})\.(\d{2})\.(\d{2})"
COMPACT = r"(20\d{2})(\d{2})(\d{2})"
KOREAN = rf"(\d{{4}})년{W}*(\d{{1,2}})월{W}*(\d{{1,2}})일"
YEAR_MONTH = r"\((\d{2})(\d{2})\)"
HANGUL = "[가-힣]"


def inference(value: Column | str, confidence: Column | str, review: Column | bool, evidence: Column | str) -> Column:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(text(value).alias("value"), text(confidence).alias("confidence"), (F.lit(review) if isinstance(review, bool) else review).alias("needs_review"), text(evidence).alias("evidence"))


UNKNOWN = ("", "unknown", True, "none")

#: Leaders and page numbers at the end of a line, each begun where no such stands before it: one pass, whatever the line's length.
TOC_TRAIL = rf"(?<!{TOC_LEAD})(?<!{TOC_LEAD}{{3}}\d{{1,4}})(?:{TOC_LEAD}{{3,}}+\d{{1,4}}+)++{W}*+$"


def _whole() -> Column:
    return F.concat(F.col("filename"), F.lit("\n"), F.col("head_text"))


def hay() -> Column:
    """File name and head text, as `_whole` made them."""
    return F.col("_hay")


def _by_keyword(rules: list[tuple[str, str, str]]) -> Column:
    out = inference(*UNKNOWN)
    for word, value, confidence in reversed(rules):
        out = F.when(F.contains(hay(), F.lit(word)), inference(value, confidence, confidence != "high", f"keyword:{word}")).otherwise(out)
    return out


def insurer() -> Column:
    return _by_keyword(INSURERS)


def document_type() -> Column:
    return _by_keyword(DOCUMENT_TYPES)


def language() -> Column:
    return F.when(F.col("head_text").rlike(HANGUL), inference("ko", "medium", True, "heuristic:hangul_present")).otherwise(inference(*UNKNOWN))


def dataset_split() -> Column:
    return inference("unassigned", "low", True, "default:unassigned")


def _disclaimer(line: Column) -> Column:
    # the first word holds no white space, so it is looked for first
    return F.contains(line, F.lit(DISCLAIMER.split(" ")[0])) & F.contains(single_spaced(line), F.lit(DISCLAIMER))


def _type_of(text: Column) -> Column:
    """struct(type, hint) of the first rule whose words stand in the text, or null."""
    out = F.lit(None).cast("struct<type: string, hint: string>")
    for words, kind, hint in reversed(TYPE_WORDS):
        out = F.when(text.rlike(words), F.struct(F.lit(kind).alias("type"), F.lit(hint).alias("hint"))).otherwise(out)
    return out


def _kept() -> Column:
    """The head text without disclaimer lines."""
    return F.array_join(F.filter(split_lines("head_text"), lambda x: ~_disclaimer(x)), "\n")


def product_type() -> Column:
    """By name and file name first (_first), then by the head text without disclaimer lines (_second)."""
    named, first, second = strip("_name"), F.col("_first"), F.col("_second")
    sure = F.when(named != "", "high").otherwise("medium")
    return (
        F.when(first.isNotNull(), inference(first["type"], sure, named == "", F.concat(F.lit("product_signal:"), first["hint"], F.lit(":primary"))))
        .when(second.isNotNull(), inference(second["type"], "medium", True, F.concat(F.lit("product_signal:"), second["hint"], F.lit(":filtered_text"))))
        .otherwise(inference(*UNKNOWN))
    )


def _generic(line: Column) -> Column:
    """Of a line with single spaces: boilerplate, no title."""
    starts = F.exists(F.array(*map(F.lit, GENERIC_START)), lambda p: F.startswith(line, p))
    return F.contains(line, F.lit(DISCLAIMER)) | line.isin(*GENERIC) | F.contains(line, F.lit("고객권리안내문")) | F.contains(F.lower(line), F.lit(GUIDE_BOOK)) | starts


def without_toc_trail(name: Column) -> Column:
    return strip(F.regexp_replace(strip(name), TOC_TRAIL, ""))


def stem() -> Column:
    """The file name without its last extension."""
    return F.regexp_replace("filename", r"(?<=.)\.[^.]+$", "")


def _titles() -> Column:
    """Of the first 40 lines that aren't blank, with single spaces: those that may be a title."""
    lines = F.transform(F.slice(F.filter(split_lines("head_text"), lambda x: x.rlike(rf"[^{W[1:-1]}]")), 1, 40), single_spaced)
    return F.filter(lines, lambda x: ~_generic(x))


def _hits() -> Column:
    """struct(w, x) of the titles x that hold a keyword w, by keyword and then by line."""
    words = F.array(*map(F.lit, NAME_WORDS))
    return F.flatten(F.transform(words, lambda w: F.transform(F.filter("_titles", lambda x: F.contains(x, w)), lambda x: F.struct(w.alias("w"), x.alias("x")))))


def product_name() -> Column:
    hit, long = F.get("_hits", F.lit(0)), F.get(F.filter("_titles", lambda x: F.length(x) >= 6), F.lit(0))
    final = lambda c: F.substring(without_toc_trail(c), 1, 200)
    return (
        F.when(hit.isNotNull(), inference(final(hit["x"]), "high", False, F.concat(F.lit("pdf_text:keyword:"), hit["w"])))
        .when(long.isNotNull(), inference(final(long), "medium", True, "pdf_text:first_non_generic_line"))
        .when(stem() != "", inference(final(stem()), "low", True, "filename:stem_fallback"))
        .otherwise(inference(*UNKNOWN))
    )


def product_slug(name: Column, kind: Column) -> Column:
    s = single_spaced(name)
    latin = key_segment(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))
    out = F.when(latin.isNotNull(), inference(latin, "medium", True, "slug:ascii_normalized")).otherwise(inference(F.concat(kind, F.lit("_"), F.substring(F.sha2(s, 256), 1, 8)), "low", True, "slug:hash8_fallback"))
    for word, slug in reversed(list(zip(NAME_WORDS, SLUGS))):
        out = F.when(F.contains(s, F.lit(word)), inference(slug, "high", False, f"slug:keyword:{word}")).otherwise(out)
    return out


def _dates_found() -> Column:
    """Array of struct(rank, text_only, iso, order, evidence, confidence): every date found, in order of preference."""

    def found(source: Column, pattern: str, groups: tuple, tag: str, confidence: str, rank: int, place: bool) -> Column:
        def one(m: Column) -> Column:
            y, mo, d = groups(m)
            iso = F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(mo, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
            valid = F.when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull() & (y.cast("int") >= 1), iso)
            named = F.contains(F.col("filename"), m) if place else F.lit("filename" in tag)
            where = F.when(named, ":filename").otherwise(":text") if place else F.lit("")
            return F.struct(F.lit(rank).alias("rank"), F.when(named, 0).otherwise(1).alias("text_only"), valid.alias("iso"), F.concat(F.lit(f"pattern:{tag}"), where).alias("evidence"), F.lit(confidence).alias("confidence"))

        return F.transform(F.regexp_extract_all(source, F.lit(f"({pattern})"), F.lit(1)), one)

    by = lambda p: lambda m: tuple(F.regexp_extract(m, p, g) for g in (1, 2, 3))
    full = lambda yy: F.concat(F.when(yy <= "69", "20").otherwise("19"), yy)
    month = lambda m: (full(F.substring(m, 2, 2)), F.substring(m, 4, 2), F.lit("01"))
    token = lambda m: (full(F.substring(m, 1, 2)), F.substring(m, 3, 2), F.substring(m, 5, 2))
    name, text = F.col("filename"), F.col("head_text")
    # digits of exactly six, whatever stands about them
    sixes = F.transform(F.filter(F.split(name, "[^0-9]+"), lambda t: F.length(t) == 6), lambda t: t)
    lists = [
        found(hay(), ISO, by(ISO), "YYYY-MM-DD", "high", 0, True),
        found(hay(), DOTTED, by(DOTTED), "YYYY.MM.DD", "high", 0, True),
        found(hay(), COMPACT, by(COMPACT), "YYYYMMDD", "high", 0, True),
        found(text, KOREAN, by(KOREAN), "korean_yyyymmdd", "medium", 1, False),
        found(hay(), YEAR_MONTH, month, "YYMM_parens_inferred_day_01", "low", 2, True),
        found(F.array_join(sixes, " "), r"\d{6}", token, "YYMMDD:filename_token", "medium", 1, False),
    ]
    valid = F.filter(F.concat(*lists), lambda c: c["iso"].isNotNull())
    # among equals for a date the first found stays: `order` is its place
    placed = F.transform(valid, lambda c, i: F.struct(c["rank"].alias("rank"), c["text_only"].alias("text_only"), c["iso"].alias("iso"), i.alias("order"), c["evidence"].alias("evidence"), c["confidence"].alias("confidence")))
    return F.array_sort(placed)


def _best_dates() -> Column:
    """Array of struct(iso, evidence, confidence): of the dates found, the first of each."""
    isos = F.transform("_found", lambda c: c["iso"])
    # a lambda's variable holds the dates, so that they are listed once
    first = F.get(F.transform(F.array(isos), lambda seen: F.filter("_found", lambda c, i: F.array_position(seen, c["iso"]) == i + 1)), F.lit(0))
    return F.transform(first, lambda c: F.struct(c["iso"].alias("iso"), c["evidence"].alias("evidence"), c["confidence"].alias("confidence")))


def date_candidates(files: DataFrame) -> DataFrame:
    """files (filename, head_text, ...) with dates: array of struct(iso, evidence, confidence), the best of each date found, in order of preference."""
    found = once(once(files, _hay=_whole()), _found=_dates_found())
    return once(found, dates=_best_dates()).drop("_hay", "_found")


def effective_date(found: Column) -> Column:
    c = F.get(found, F.lit(0))
    return F.when(F.size(found) > 0, inference(c["iso"], c["confidence"], (c["confidence"] != "high") | F.contains(c["evidence"], F.lit("inferred_day_01")), c["evidence"])).otherwise(inference(*UNKNOWN))


FIELDS = ["insurer", "document_type", "product_type", "effective_date", "product_name", "product_slug", "language", "dataset_split"]


def inferred(files: DataFrame) -> DataFrame:
    """files (filename, head_text, ...) with an inference column for each of FIELDS, and dates."""
    out = once(files, _hay=_whole(), _titles=_titles(), _kept=_kept())
    out = once(out, _hits=_hits(), _found=_dates_found())
    # fields that a later step looks at are columns of their own: Spark's pruning of nested columns loses them behind a generator
    out = once(out, product_name=product_name(), _name=product_name()["value"], dates=_best_dates())
    named = strip("_name")
    first = _type_of(F.concat_ws("\n", F.when(named != "", named), F.when(F.col("filename") != "", F.col("filename"))))
    out = once(out, _first=first, _second=_type_of(F.concat_ws("\n", "_kept", "filename")))
    out = once(out, insurer=insurer(), document_type=document_type(), language=language(), dataset_split=dataset_split(), effective_date=effective_date(F.col("dates")), product_type=product_type(), _type=product_type()["value"])
    out = once(out, product_slug=product_slug(F.col("_name"), F.col("_type")))
    return out.drop("_hay", "_titles", "_kept", "_hits", "_found", "_name", "_first", "_second", "_type")


def entries(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Manifest entries of files (filename, head_text, content_hash, and columns to keep): reason is '' for those that pass; others have nulls."""
    out = inferred(files)
    reason = F.when(hash8("content_hash").isNull(), "content_hash_not_sha256").otherwise("")
    for field in ("effective_date", "product_type", "document_type", "insurer"):
        reason = F.when(strip(f"{field}.value") == "", f"{field}_not_inferred").otherwise(reason)
    out = out.withColumn("reason", reason)
    fine = F.col("reason") == ""
    value = lambda n: F.col(f"{n}.value")
    key = F.concat_ws("_", *[key_segment(value(n)) for n in ("insurer", "product_type", "product_slug", "document_type")], date_segment(value("effective_date")), hash8("content_hash"))
    review = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"{n}.needs_review"), F.lit(n)) for n in FIELDS])))
    out = out.withColumns({"review": review, "key": key})
    kept = {"document_id": F.col("key"), **{n: value(n) for n in FIELDS}, "source_file": F.concat(F.lit("data/raw/manual/"), "key", F.lit(".pdf")), "original_filename": F.col("filename"), "content_hash": F.col("content_hash"), "collection_method": F.lit("manual_inbox_rules"), "notes": F.when(F.size("review") > 0, F.concat(F.lit("rule_extract_needs_review:"), F.array_join("review", ","))).otherwise("")}
    inference_map = F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*FIELDS))
    return out.select(*keep, "filename", "reason", *[F.when(fine, c).alias(f"entry_{n}") for n, c in kept.items()], F.when(fine, inference_map).alias("inference"))
