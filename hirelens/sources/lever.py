"""Lever postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import epoch_to_utc_text, iso_to_utc_text
from ..functions.text import blank_to_null, cleaned, glued_items, glued_list, html_texts

ATS = "Lever"


def explode_postings(landed: DataFrame) -> DataFrame:
    """Lever landings already hold one posting per row."""
    return landed


def _created(stamp: str) -> Column:
    """Milliseconds, as usual, or an ISO text."""
    text = F.col(stamp).cast("string")
    return F.when(text.rlike(r"\A-?[0-9.]+(E[0-9]+)?\z"), epoch_to_utc_text(text.try_cast("double").cast("bigint"), milliseconds=True)).otherwise(iso_to_utc_text(text))


def normalise(raw: DataFrame, company: str | Column, collected_at: str | Column, beside: Sequence[str] = ()) -> DataFrame:
    """Postings in the common schema; columns of `raw` named in `beside` go along."""
    company_name = F.lit(company) if isinstance(company, str) else company
    stamp = F.lit(collected_at) if isinstance(collected_at, str) else collected_at
    flat = raw.select("*", "categories.*").drop("categories")
    fields = cleaned(flat, {
        "job_id": "id", "job_title": "text", "_place": "location", "_places": glued_list("allLocations"),
        "country_code": "country", "team": "team", "department": "department",
        "commitment": "commitment", "workplace_type": "workplaceType",
        "_plain": "descriptionPlain", "source_url": "hostedUrl", "apply_url": "applyUrl",
    })
    # The HTML description is only read where there is no plain one.
    read = html_texts(fields, {"_rich": F.when(F.col("_plain") == "", F.col("description"))})
    listed = read.withColumn("all_locations", glued_items("_places"))
    return listed.select(
        company_name.alias("company"),
        "job_id",
        "job_title",
        F.coalesce(blank_to_null("_place"), F.array_join("all_locations", ", ")).alias("location"),
        "all_locations",
        "country_code",
        "team",
        "department",
        "commitment",
        "workplace_type",
        F.coalesce(blank_to_null("_plain"), F.col("_rich")).alias("description"),
        F.col("salaryRange").alias("salary_range"),
        _created("createdAt").alias("posting_date"),
        "source_url",
        "apply_url",
        F.lit("API").alias("collection_method"),
        F.lit(ATS).alias("ats"),
        stamp.alias("collected_at"),
        *beside,
    )
