"""Presentation helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ..fixed_values import COMPANY_TYPE_LABELS, TAXONOMY_V1_TO_V2
from .text import as_column


def long_date(day: Column | str) -> Column:
    return F.date_format(as_column(day), "MMMM d, yyyy")


def paragraphs(text: Column | str) -> Column:
    return F.split(as_column(text), "\n\n")


def placeholder(value: Column | str, mark: str = "N/A") -> Column:
    """Missing values get their mark only when they are shown."""
    return F.coalesce(F.nullif(as_column(value).cast("string"), F.lit("")), F.lit(mark))


def _looked_up(value: Column | str, mapping: Mapping[str, str]) -> Column:
    table = F.create_map(*(F.lit(item) for pair in mapping.items() for item in pair))
    return F.try_element_at(table, F.trim(as_column(value)))


def taxonomy_2(category: Column | str) -> Column:
    """The version 2 name of a version 1 category; version 2 names stay, any other value is null."""
    known = F.trim(as_column(category)).isin(*TAXONOMY_V1_TO_V2.values())
    return F.coalesce(_looked_up(category, TAXONOMY_V1_TO_V2), F.when(known, F.trim(as_column(category))))


def company_type_label(kind: Column | str) -> Column:
    """The four-way label of a register company type; other types are shown as they are."""
    return F.coalesce(_looked_up(kind, COMPANY_TYPE_LABELS), as_column(kind))
