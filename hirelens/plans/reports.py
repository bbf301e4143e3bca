"""Salary and classification reports over a posting dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.binding import computed_once
from ..functions.responses import response_error, response_skills, response_text, with_parsed
from ..functions.salary import with_any_salary, with_salary_range
from ..functions.text import strip_tags
from ..functions.titles import title_relevant
from ..operators.joins import one_to_one_left, salary_with_fallback, suffixed_left_join
from ..operators.search import salary_order, sort_extracted, with_salary

RANGE_REPORT = (
    "job_id", "job_title", "location", "source_url", "salary_min", "salary_max",
    "salary_currency", "salary_period", "salary_snippet", "salary_source",
)
BOARD_REPORT = (
    "id", "title", "location_name", "absolute_url", "salary_min", "salary_max",
    "salary_currency", "salary_snippet", "salary_source",
)
FALLBACK_TAG = "levels_fyi"


def salary_report(postings: DataFrame, reading: str) -> DataFrame:
    """Postings that state a range, dearest first within each currency."""
    priced = with_salary_range(postings, "description", reading, stated_only=True)
    return sort_extracted(priced.select(*RANGE_REPORT), salary_order("job_id"), "job_id")


def board_salaries(raw_jobs: DataFrame, entries: DataFrame, fallback_tag: str = FALLBACK_TAG) -> DataFrame:
    """Raw board jobs with the salary of their text, else of the closest reference title.

    The title filter runs before any text is read.
    """
    relevant = raw_jobs.filter(title_relevant("title", "broad"))
    plain = computed_once(relevant, {"_plain": strip_tags("content")})
    posted = with_any_salary(plain, "_plain", "_post").drop("_plain")
    full = salary_with_fallback(
        posted, "title", entries, fallback_tag, titles=relevant.select("title")
    )
    return full.withColumn("location_name", F.col("location.name"))


def board_salary_report(raw_jobs: DataFrame, entries: DataFrame) -> DataFrame:
    priced = with_salary(board_salaries(raw_jobs, entries))
    return sort_extracted(priced.select(*BOARD_REPORT), salary_order("id"), "id")


UNKNOWN_JOB = "no posting with this job id"


def ingest_responses(responses: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable classifications, and failures with their reason; one bad response stops nothing.

    Company, title and page come from the posting, whatever the response says. A response of a job that is not among the
    postings is a failure as well.
    """
    parsed = computed_once(with_parsed(responses, into="_parsed"), {"error": response_error("_parsed")})
    failures = parsed.filter("error IS NOT NULL").select("job_id", "error")
    labels = parsed.filter("error IS NULL").select(
        "job_id",
        response_text("_parsed", "role_profile").alias("role_profile"),
        response_skills("_parsed").alias("skills"),
        response_text("_parsed", "functional_area").alias("functional_area"),
    )
    truth = postings.select(
        "job_id", "company", F.col("job_title").alias("title"), F.col("source_url").alias("career_page_url")
    )
    unknown = labels.join(truth, "job_id", "left_anti").select("job_id", F.lit(UNKNOWN_JOB).alias("error"))
    return truth.join(labels, "job_id"), failures.unionByName(unknown)


def classification_report(postings: DataFrame, classifications: DataFrame, reading: str) -> DataFrame:
    """Classifications with the salary their posting states; a repeated job id on either side is an error when the rows are read."""
    salaries = with_salary_range(postings, "description", reading)
    wanted = ("job_id", "location", "salary_min", "salary_max", "salary_currency", "salary_period",
              "salary_snippet", "salary_source")
    return one_to_one_left(classifications, salaries.select(*wanted), "job_id")


def board_classification_report(classifications: DataFrame, salaries: DataFrame) -> DataFrame:
    return suffixed_left_join(
        classifications, salaries, ["id", "absolute_url"], ("_taxonomy", "_salary")
    )
