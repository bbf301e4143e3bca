"""SmartRecruiters: summary pages, then one detail object per summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import AD_SECTIONS
from ..functions.dates import iso_to_utc_text
from ..functions.text import blank_to_null, clean_text, cleaned, html_texts, join_parts, url_base
from ..functions.titles import workplace_from_flags

ATS = "SmartRecruiters"


def page_summaries(pages: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Summary ids in page order, up to the first empty page or the stated total; then the first `max_jobs`, if given.

    Both stops come from one aggregate over the pages. `ordinal` holds the order; only a cut sorts, as a top-k.
    """
    if max_jobs is not None and max_jobs < 1:
        raise ValueError("max_jobs must be at least 1")
    stops = pages.agg(F.struct(
        F.min(F.when(F.size("content") == 0, F.col("offset"))).alias("empty"),
        F.min(F.when(F.col("offset") + F.size("content") >= F.col("totalFound"), F.col("offset"))).alias("full"),
    ).alias("stops")).scalar()
    kept = pages.filter(
        (F.col("offset") < F.coalesce(stops["empty"], F.lit(2**62)))
        & (F.col("offset") <= F.coalesce(stops["full"], F.lit(2**62)))
    )
    summaries = kept.select("offset", F.posexplode("content").alias("position", "summary")).filter("summary IS NOT NULL").select(
        (F.col("offset") + F.col("position")).alias("ordinal"), F.col("summary.id").alias("id")
    )
    return summaries if max_jobs is None else summaries.orderBy("ordinal").limit(max_jobs)


def blank_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries without an id; any such row makes a strict run fail."""
    return summaries.filter(clean_text("id") == "")


def details_in_order(summaries: DataFrame, details: DataFrame) -> DataFrame:
    """Details of the listed summaries, keeping the summary order in `ordinal`. A repeated detail counts once (the first by
    content); summaries without one are `missing_details`."""
    cleaned_ids = details.withColumn("_detail_id", clean_text("id"))
    rank = F.row_number().over(Window.partitionBy("_detail_id").orderBy(F.to_json(F.struct(*details.columns))))
    once = cleaned_ids.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    ids = summaries.select("ordinal", clean_text("id").alias("_summary_id"))
    return ids.join(once, F.col("_summary_id") == F.col("_detail_id")).drop("_summary_id", "_detail_id")


def missing_details(summaries: DataFrame, details: DataFrame) -> DataFrame:
    """Summaries whose detail did not land."""
    landed = details.select(clean_text("id").alias("_detail_id")).distinct()
    return summaries.join(landed, clean_text(summaries["id"]) == F.col("_detail_id"), "left_anti")


def explode_postings(landed: DataFrame) -> DataFrame:
    return landed


def flattened(raw: DataFrame, beside: Sequence[str] = ()) -> DataFrame:
    """Every leaf of a detail object as a column of its own."""
    sections = [
        F.col(f"jobAd.sections.{section}.{part}").alias(f"_{part}_{section}")
        for section in AD_SECTIONS for part in ("title", "text")
    ]
    return raw.select(
        "id", "name", "releasedDate", "postingUrl", "applyUrl", "refNumber", "location.*",
        F.col("function.label").alias("_function"), F.col("department.label").alias("_department"),
        F.col("typeOfEmployment.label").alias("_employment"), F.col("experienceLevel.label").alias("_level"),
        F.col("industry.label").alias("_industry"), F.col("language.code").alias("_language"), *sections, *beside,
    )


def normalise(raw: DataFrame, company: str | Column, collected_at: str | Column, beside: Sequence[str] = ()) -> DataFrame:
    """Postings in the common schema; columns of `raw` named in `beside` go along."""
    company_name = F.lit(company) if isinstance(company, str) else company
    stamp = F.lit(collected_at) if isinstance(collected_at, str) else collected_at
    flat = flattened(raw, [*beside, *([] if isinstance(company, str) else [company_name.alias("_company")])])
    titles = {f"_title_{section}": f"_title_{section}" for section in AD_SECTIONS}
    texts = {f"_text_{section}": f"_text_{section}" for section in AD_SECTIONS}
    fields = cleaned(flat, {
        "job_id": "id", "job_title": "name", "_full": "fullLocation", "_city": "city",
        "_region": "region", "country_code": "country", "_posting": "postingUrl",
        "apply_url": "applyUrl", "_function": "_function", "_department": "_department",
        "commitment": "_employment", "experience_level": "_level",
        "_industry": "_industry", "_language": "_language", "job_reference": "refNumber", **titles,
    })
    # Named sections in their order, each under its title; sections without text are left out.
    blocks = [
        F.when(F.col(f"_text_{section}") != "",
               F.concat_ws("\n", blank_to_null(f"_title_{section}"), F.col(f"_text_{section}")))
        for section in AD_SECTIONS
    ]
    read = html_texts(fields, texts).withColumn(
        "_place", F.coalesce(blank_to_null("_full"), join_parts("_city", "_region", "country_code"))
    )
    return read.select(
        (company_name if isinstance(company, str) else F.col("_company")).alias("company"),
        "job_id",
        "job_title",
        F.col("_place").alias("location"),
        F.array_compact(F.array(blank_to_null("_place"))).alias("all_locations"),
        "country_code",
        F.col("_function").alias("team"),
        F.col("_department").alias("department"),
        "commitment",
        workplace_from_flags("hybrid", "remote").alias("workplace_type"),
        F.concat_ws("\n\n", *blocks).alias("description"),
        F.lit(None).cast("map<string,string>").alias("salary_range"),
        iso_to_utc_text("releasedDate").alias("posting_date"),
        F.coalesce(blank_to_null("_posting"), url_base("apply_url")).alias("source_url"),
        "apply_url",
        F.lit("API").alias("collection_method"),
        F.lit(ATS).alias("ats"),
        stamp.alias("collected_at"),
        F.col("_language").alias("language"),
        "job_reference",
        F.col("_function").alias("function"),
        "experience_level",
        F.col("_industry").alias("industry"),
        *beside,
    )
