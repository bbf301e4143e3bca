"""Explicit schemas as DDL: raw payloads per source, the normalised posting, silver and gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

NAMED = "STRUCT<name STRING>"
LABELLED = "STRUCT<label STRING>"
SECTION = "STRUCT<title STRING, text STRING>"


LEVER_RAW = (
    "id STRING, text STRING, createdAt STRING, country STRING, workplaceType STRING, "
    "categories STRUCT<location STRING, allLocations ARRAY<STRING>, team STRING, "
    "department STRING, commitment STRING>, descriptionPlain STRING, description STRING, "
    "hostedUrl STRING, applyUrl STRING, salaryRange MAP<STRING, STRING>"
)

GREENHOUSE_JOB = (
    "STRUCT<id STRING, title STRING, first_published STRING, updated_at STRING, "
    "absolute_url STRING, content STRING, language STRING, requisition_id STRING, "
    "application_deadline STRING, internal_job_id STRING, "
    f"location {NAMED}, departments ARRAY<{NAMED}>, offices ARRAY<{NAMED}>>"
)
GREENHOUSE_RAW = f"jobs ARRAY<{GREENHOUSE_JOB}>, meta STRUCT<total BIGINT>"

SMARTRECRUITERS_PAGE = (
    "offset BIGINT, content ARRAY<STRUCT<id STRING>>, totalFound BIGINT"
)
SMARTRECRUITERS_RAW = (
    "id STRING, name STRING, releasedDate STRING, postingUrl STRING, applyUrl STRING, "
    "refNumber STRING, location STRUCT<fullLocation STRING, city STRING, region STRING, "
    "country STRING, hybrid BOOLEAN, remote BOOLEAN>, "
    f"function {LABELLED}, department {LABELLED}, typeOfEmployment {LABELLED}, "
    f"experienceLevel {LABELLED}, industry {LABELLED}, language STRUCT<code STRING>, "
    f"jobAd STRUCT<sections STRUCT<companyDescription {SECTION}, jobDescription {SECTION}, "
    f"qualifications {SECTION}, additionalInformation {SECTION}>>"
)

POSTING = (
    "company STRING, job_id STRING, job_title STRING, location STRING, "
    "all_locations ARRAY<STRING>, country_code STRING, team STRING, department STRING, "
    "commitment STRING, workplace_type STRING, description STRING, "
    "salary_range MAP<STRING, STRING>, posting_date STRING, source_url STRING, "
    "apply_url STRING, collection_method STRING, ats STRING, collected_at STRING, "
    "language STRING, job_reference STRING, function STRING, experience_level STRING, "
    "industry STRING, internal_job_id STRING, updated_at STRING, application_deadline STRING, "
    "offices ARRAY<STRING>"
)

RESPONSE = ("job_id STRING, source_response STRING, content STRING")

SILVER = {
    "company": (
        "company_id STRING NOT NULL, name STRING, website_url STRING, career_page_url STRING, "
        "company_type STRING, data_source_status STRING"
    ),
    "company_location": (
        "location_id STRING NOT NULL, company_id STRING, country STRING, city STRING, is_hq BOOLEAN"
    ),
    "job_posting": (
        "job_id STRING NOT NULL, company_id STRING, title STRING, department STRING, "
        "employment_type STRING, job_location STRING, seniority_level STRING, salary_min DOUBLE, "
        "salary_max DOUBLE, salary_currency STRING, raw_description STRING NOT NULL, "
        "posted_date DATE, scraped_date DATE NOT NULL, source_url STRING NOT NULL, "
        "source_platform STRING, extraction_confidence DOUBLE"
    ),
    "category": (
        "category_id STRING NOT NULL, main_type STRING, sub_type STRING, taxonomy_version INT"
    ),
    "job_category": (
        "job_id STRING NOT NULL, category_id STRING NOT NULL, confidence_score DOUBLE"
    ),
    "skill": ("skill_id STRING NOT NULL, skill_name STRING, skill_type STRING"),
    "job_skill": ("job_id STRING NOT NULL, skill_id STRING NOT NULL"),
    "scrape_log": (
        "scrape_id STRING NOT NULL, company_id STRING, scrape_date DATE, jobs_found BIGINT, "
        "status STRING, error_message STRING"
    ),
}

GOLD_TREND = (
    "snapshot_id STRING NOT NULL, scrape_id STRING, category_id STRING, company_id STRING, "
    "is_total BOOLEAN, job_count BIGINT, snapshot_date DATE"
)


def conform(table: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, in its order and types."""
    wanted = StructType.fromDDL(ddl)
    return table.select(*(F.col(field.name).cast(field.dataType) for field in wanted.fields))
