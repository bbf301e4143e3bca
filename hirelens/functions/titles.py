"""Title relevance filters and workplace type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import BROAD_TITLE, MOBILITY_TITLE, ONBOARD_TITLE, RESEARCH_TITLE
from .text import as_column

TITLE_PATTERNS = {"broad": BROAD_TITLE, "mobility": MOBILITY_TITLE, "onboard": ONBOARD_TITLE, "research": RESEARCH_TITLE}


def title_relevant(title: Column | str, variant: str) -> Column:
    """A missing title is not relevant."""
    return F.coalesce(F.rlike(as_column(title), F.lit("(?iU)" + TITLE_PATTERNS[variant])), F.lit(False))


def workplace_from_flags(hybrid: Column | str, remote: Column | str) -> Column:
    return F.when(as_column(hybrid), "hybrid").when(as_column(remote), "remote").otherwise("onsite")


def workplace_from_text(*texts: Column | str) -> Column:
    """Read from the location and the offices; arrays are allowed."""
    text = F.lower(F.concat_ws(" ", *map(as_column, texts)))
    return (
        F.when(F.contains(text, F.lit("hybrid")), "hybrid")
        .when(F.contains(text, F.lit("remote")), "remote")
        .otherwise("onsite")
    )
