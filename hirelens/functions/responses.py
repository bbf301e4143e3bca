"""Stored classification responses: JSON that may be fenced or wrapped in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import RESPONSE_FIELDS
from .binding import computed_once
from .text import as_column


def unfence(content: Column | str) -> Column:
    """Trim, and drop code fences and their language tag."""
    text = F.coalesce(as_column(content), F.lit(""))
    bare = F.regexp_replace(text, r"(?iU)\A\s*`{3,}\s*(?:json\s*)?|\s*`*\s*\z", "")
    trimmed = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    return F.when(F.rlike(text, F.lit(r"(?U)\A\s*```")), bare).otherwise(trimmed)


def with_parsed(responses: DataFrame, content: str = "content", into: str = "parsed") -> DataFrame:
    """Add the variant of the whole text, else of its outermost braces, else null."""
    text = computed_once(responses, {"_text": unfence(content)})
    braces = F.nullif(F.regexp_extract("_text", r"(?s)\{.*\}", 0), F.lit(""))
    parsed = F.coalesce(F.try_parse_json("_text"), F.try_parse_json(braces))
    return computed_once(text, {into: parsed}).drop("_text")


def response_error(parsed: Column | str) -> Column:
    """Why a response is unusable; null when it is fine. Fields are named in sorted order."""
    value = as_column(parsed)
    kind = F.schema_of_variant(value)
    absent = [
        F.when(F.try_variant_get(value, f"$.{name}", "variant").isNull(), F.lit(name))
        for name in sorted(RESPONSE_FIELDS)
    ]
    missing = F.nullif(F.concat_ws(", ", *absent), F.lit(""))
    skills_kind = F.schema_of_variant(F.try_variant_get(value, "$.skills", "variant"))
    return (
        F.when(value.isNull(), "not JSON")
        .when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
        .when(missing.isNotNull(), F.concat(F.lit("missing fields: "), missing))
        .when(~F.coalesce(F.startswith(skills_kind, F.lit("ARRAY")), F.lit(False)), "skills is no list")
    )


def response_text(parsed: Column | str, field: str) -> Column:
    return F.try_variant_get(as_column(parsed), f"$.{field}", "string")


def response_skills(parsed: Column | str) -> Column:
    return F.try_variant_get(as_column(parsed), "$.skills", "array<string>")
