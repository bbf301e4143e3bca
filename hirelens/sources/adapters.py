"""The extension point: a source is a schema, a row exploder and a normaliser."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from .. import schemas
from . import greenhouse, lever, smartrecruiters


@dataclass(frozen=True)
class Adapter:
    schema: str
    explode: Callable[[DataFrame], DataFrame]
    normalise: Callable[..., DataFrame]


ADAPTERS: dict[str, Adapter] = {
    lever.ATS: Adapter(schemas.LEVER_RAW, lever.explode_postings, lever.normalise),
    greenhouse.ATS: Adapter(schemas.GREENHOUSE_RAW, greenhouse.explode_postings, greenhouse.normalise),
    smartrecruiters.ATS: Adapter(
        schemas.SMARTRECRUITERS_RAW, smartrecruiters.explode_postings, smartrecruiters.normalise
    ),
}


def register_adapter(ats: str, adapter: Adapter) -> None:
    """Add a source without touching the others."""
    if ats in ADAPTERS:
        raise ValueError(f"an adapter for {ats} exists")
    ADAPTERS[ats] = adapter


def normalise_landed(landed: DataFrame, ats: str, company: str, collected_at: str) -> DataFrame:
    adapter = ADAPTERS[ats]
    return adapter.normalise(adapter.explode(landed), company, collected_at)


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All postings, duplicates kept; columns a source lacks are null."""
    result = first
    for other in others:
        result = result.unionByName(other, allowMissingColumns=True)
    return result
