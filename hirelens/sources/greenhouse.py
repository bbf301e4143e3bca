"""Greenhouse job boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import iso_to_utc_text
from ..functions.text import (
    blank_to_null, cleaned, first_or_blank, glued_items, glued_list, html_texts,
)
from ..functions.titles import workplace_from_text

ATS = "Greenhouse"


def explode_postings(landed: DataFrame) -> DataFrame:
    """One row per job of an envelope, with its place in the payload; other columns of the envelope stay with its jobs."""
    beside = [name for name in landed.columns if name not in ("jobs", "meta", "odd_items")]
    jobs = landed.select(*beside, F.posexplode("jobs").alias("ordinal", "job")).filter("job IS NOT NULL")
    return jobs.select(*beside, "ordinal", "job.*")


def wrong_totals(landed: DataFrame, *beside: str) -> DataFrame:
    """Envelopes whose declared total differs from the jobs they hold; no list holds none."""
    held = F.coalesce(F.array_size("jobs"), F.lit(0))
    return landed.filter(F.col("meta.total") != held).select(
        *beside, F.col("meta.total").alias("declared"), held.alias("held")
    )


def normalise(raw: DataFrame, company: str | Column, collected_at: str | Column, beside: Sequence[str] = ()) -> DataFrame:
    """Postings in the common schema; columns of `raw` named in `beside` go along."""
    company_name = F.lit(company) if isinstance(company, str) else company
    stamp = F.lit(collected_at) if isinstance(collected_at, str) else collected_at
    flat = raw.withColumn("_place", F.col("location.name")).drop("location")
    fields = cleaned(flat, {
        "job_id": "id", "job_title": "title", "location": "_place", "source_url": "absolute_url",
        "_departments": glued_list("departments.name"), "_offices": glued_list("offices.name"),
        "language": "language", "job_reference": "requisition_id", "internal_job_id": "internal_job_id",
        "updated_at": "updated_at", "application_deadline": "application_deadline",
    })
    read = html_texts(fields, {"description": "content"}).withColumns({
        "departments": F.array_distinct(glued_items("_departments")),
        "offices": F.array_distinct(glued_items("_offices")),
    })
    return read.select(
        company_name.alias("company"),
        "job_id",
        "job_title",
        "location",
        F.array_compact(F.array(blank_to_null("location"))).alias("all_locations"),
        F.lit("").alias("country_code"),
        first_or_blank("departments").alias("team"),
        F.array_join("departments", ", ").alias("department"),
        F.lit("").alias("commitment"),
        workplace_from_text("location", "offices").alias("workplace_type"),
        "description",
        F.lit(None).cast("map<string,string>").alias("salary_range"),
        iso_to_utc_text("first_published").alias("posting_date"),
        "source_url",
        F.col("source_url").alias("apply_url"),
        F.lit("API").alias("collection_method"),
        F.lit(ATS).alias("ats"),
        stamp.alias("collected_at"),
        "language",
        "job_reference",
        "internal_job_id",
        "updated_at",
        "application_deadline",
        "offices",
        *beside,
    )
