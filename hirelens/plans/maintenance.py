"""Keeping the posting table current: upsert, status refresh, retention, silver rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.skills import seniority
from ..functions.text import blank_to_null


def latest_per_key(rows: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """One row per key. `newest` should order every pair of differing rows.

    The rank filter also runs before the shuffle, so thousands of copies of a key leave a task as one.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def newest_by_date(rows: DataFrame, date: str, keys: Sequence[str]) -> list[Column]:
    """Later date first; then every other column, so the choice never depends on row order.

    Maps have no order; their entries, sorted by key, stand for them.
    """
    def comparable(name: str, kind: str) -> Column:
        if kind.startswith("map<"):
            return F.to_json(F.array_sort(F.map_entries(name)))
        return F.to_json(F.struct(name)) if "map<" in kind else F.col(name)

    others = [F.desc_nulls_last(comparable(name, kind)) for name, kind in rows.dtypes if name != date and name not in keys]
    return [F.desc_nulls_last(date), *others]


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Last writer wins by date; the batch wins a tie. Applying a batch twice changes nothing.

    The caller writes the result beside the table and swaps; nothing is read and overwritten at once.
    """
    both = current.withColumn("_batch", F.lit(0)).unionByName(
        batch.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    newest, *others = newest_by_date(batch, date, keys)
    order = [newest, F.desc("_batch"), *others]
    return latest_per_key(both, keys, order).drop("_batch")


def refresh_status(
    previous: DataFrame, collected: DataFrame, succeeded: DataFrame, key: str, company: str, checked: Column
) -> DataFrame:
    """Status of every posting known before or seen now.

    Seen now, with or without a company: active. Unseen: removed, but only for companies whose run succeeded;
    for the others the old status and date stay. A posting collected under several companies takes the smallest
    name. `previous` has status and last_checked. Nothing is deleted.
    """
    now = collected.groupBy(key).agg(F.min(company).alias("_now_company")).withColumn("_now", F.lit(True))
    ran = succeeded.select(F.col(company).alias("_ran")).distinct()
    merged = previous.join(now, key, "full_outer").withColumn(
        company, F.coalesce(F.col(company), F.col("_now_company"))
    ).withColumn("_seen", F.coalesce("_now", F.lit(False)))
    judged = merged.join(ran, F.col(company) == F.col("_ran"), "left")
    gone = F.col("_ran").isNotNull() & ~F.col("_seen")
    status = F.when(F.col("_seen"), "active").when(gone, "removed").otherwise(F.col("status"))
    last = F.when(F.col("_seen") | gone, checked).otherwise(F.col("last_checked"))
    return judged.withColumns({"status": status, "last_checked": last}).drop("_now_company", "_now", "_ran", "_seen")


def expire(statuses: DataFrame, today: Column, unseen_days: int, unavailable_days: int) -> DataFrame:
    """Age the statuses: an active posting not checked for `unseen_days` is unavailable, a removed or unavailable one
    older than `unavailable_days` is expired. Rows without a date stay as they are."""
    age = F.datediff(today, F.col("last_checked"))
    status = F.when((F.col("status") == "active") & (age > unseen_days), "unavailable")
    status = F.when(F.col("status").isin("removed", "unavailable") & (age > unavailable_days), "expired").otherwise(status)
    return statuses.withColumn("status", F.coalesce(status, F.col("status")))


def _scrape_id(company: str, scrape_date: Column, run: Column | None) -> Column:
    """The id of a company's run; `run` tells several runs of a day apart."""
    return F.sha2(F.concat_ws("~", company, scrape_date.cast("string"), *([] if run is None else [run.cast("string")])), 256)


def failed_run_log(failures: DataFrame, company: str, error: str, scrape_date: Column, run: Column | None = None) -> DataFrame:
    """Log rows of failed runs: no job, and the first message (by text) where a company has several."""
    first = failures.groupBy(company).agg(F.min(error).alias("error_message"))
    return first.select(
        _scrape_id(company, scrape_date, run).alias("scrape_id"), F.col(company).alias("company_id"), scrape_date.alias("scrape_date"),
        F.lit(0).cast("bigint").alias("jobs_found"), F.lit("failed").alias("status"), "error_message",
    )


def run_log(batch: DataFrame, company: str, scrape_date: Column, run: Column | None = None) -> DataFrame:
    """Log rows of a successful run, one per company, counted in one pass."""
    counted = batch.groupBy(company).agg(F.count(F.lit(1)).alias("jobs_found"))
    return counted.select(
        _scrape_id(company, scrape_date, run).alias("scrape_id"),
        F.col(company).alias("company_id"), scrape_date.alias("scrape_date"), "jobs_found",
        F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"),
    )


def silver_postings(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Normalised postings as silver rows: blanks become nulls, ids derive from the source URL.

    The extraction confidence is the share of the fields below that the payload gave.
    """
    judged = ("job_title", "location", "description", "posting_date", "department", "commitment")
    given = [F.when(F.coalesce(F.trim(name), F.lit("")) != "", 1).otherwise(0) for name in judged if name in postings.columns]
    confidence = F.round(sum(given, F.lit(0)) / len(judged), 4)
    known = companies.select("company_id", F.col("name").alias("company"))
    priced = {"salary_min", "salary_max", "salary_currency"} <= set(postings.columns)
    salary = [
        F.col(name) if priced else F.lit(None).cast(kind).alias(name)
        for name, kind in (("salary_min", "double"), ("salary_max", "double"), ("salary_currency", "string"))
    ]
    return postings.join(known, "company", "left").select(
        F.sha2("source_url", 256).alias("job_id"), "company_id",
        F.col("job_title").alias("title"),
        blank_to_null("department").alias("department"),
        blank_to_null("commitment").alias("employment_type"),
        blank_to_null("location").alias("job_location"),
        seniority("job_title", "experience_level" if "experience_level" in postings.columns else None)
        .alias("seniority_level"),
        *salary,
        F.col("description").alias("raw_description"),
        F.substring("posting_date", 1, 10).try_cast("date").alias("posted_date"),
        F.substring("collected_at", 1, 10).try_cast("date").alias("scraped_date"),
        "source_url", F.col("ats").alias("source_platform"), confidence.cast("double").alias("extraction_confidence"),
    )


def silver_categories(labels: DataFrame, version: int) -> DataFrame:
    """Category rows from (main_type, sub_type), each once, with an id that a rerun repeats."""
    return labels.select("main_type", "sub_type").distinct().select(
        category_id("main_type", "sub_type", version).alias("category_id"), "main_type", "sub_type", F.lit(version).alias("taxonomy_version")
    )


def category_id(main_type: str, sub_type: str, version: int) -> Column:
    return F.sha2(F.concat_ws("~", F.lit(str(version)), F.coalesce(F.col(main_type), F.lit("")), F.coalesce(F.col(sub_type), F.lit(""))), 256)


def silver_job_categories(labels: DataFrame, version: int) -> DataFrame:
    """(job_id, main_type, sub_type, confidence_score) as bridge rows; a repeated label keeps its best score."""
    keyed = labels.select("job_id", category_id("main_type", "sub_type", version).alias("category_id"), "confidence_score")
    return keyed.groupBy("job_id", "category_id").agg(F.max("confidence_score").alias("confidence_score"))


def skill_id(name: Column | str) -> Column:
    return F.sha2(F.lower(F.trim(name)), 256)


def silver_skills(skills: DataFrame, kind: str = "technical") -> DataFrame:
    """Skill rows from (skill_name), names that differ in case or outer blanks once."""
    named = skills.where(F.trim("skill_name") != "").groupBy(skill_id("skill_name").alias("skill_id"))
    return named.agg(F.min(F.trim("skill_name")).alias("skill_name")).withColumn("skill_type", F.lit(kind))


def silver_job_skills(postings: DataFrame, key: str, skills: str) -> DataFrame:
    """Bridge rows from an array of skill names."""
    each = postings.select(F.col(key).alias("job_id"), F.explode(skills).alias("_name")).where(F.trim("_name") != "")
    return each.select("job_id", skill_id("_name").alias("skill_id")).distinct()


def silver_locations(companies: DataFrame) -> DataFrame:
    """(company_id, country, city, is_hq) as location rows; the id comes from company, country and city."""
    place = F.concat_ws("~", "company_id", F.coalesce("country", F.lit("")), F.coalesce("city", F.lit("")))
    keyed = companies.select(F.sha2(place, 256).alias("location_id"), "company_id", "country", "city", "is_hq")
    return keyed.groupBy("location_id", "company_id", "country", "city").agg(F.bool_or("is_hq").alias("is_hq"))


def drop_old_partitions(spark: SparkSession, root: str, column: str, keep_from: str) -> list[str]:
    """Delete raw-content partitions dated before `keep_from`; silver keeps the source URL.

    Only folders are listed on the driver, one per collection date; no data is read.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith(f"{column}=") and name.split("=", 1)[1] < keep_from:
            fs.delete(status.getPath(), True)
            dropped.append(name)
    return sorted(dropped)
