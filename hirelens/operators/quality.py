"""Checks on batches and keys. Default is to split off bad rows; strict mode raises."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType

from ..fixed_values import REQUIRED_FIELDS

ACCURACY_SAMPLE, ACCURACY_TARGET = 20, 0.9


def require_columns(table: DataFrame, columns: Iterable[str]) -> None:
    """Schema check only: no job runs."""
    missing = sorted(set(columns) - set(table.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def is_missing(table: DataFrame, field: str) -> Column:
    """Null, blank, empty or zero, by the field's type; an absent column is always missing."""
    if field not in table.columns:
        return F.lit(True)
    kind, value = table.schema[field].dataType, F.col(field)
    if isinstance(kind, (ArrayType, MapType)):
        hollow = F.size(value) == 0
    elif isinstance(kind, NumericType):
        hollow = value == 0
    elif isinstance(kind, BooleanType):
        hollow = ~value
    else:
        hollow = value.cast("string") == ""
    return value.isNull() | hollow


def missing_fields(table: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> Column:
    """Names of a row's missing fields, in the order of `fields`."""
    return F.array_compact(F.array(*(F.when(is_missing(table, f), F.lit(f)) for f in fields)))


def split_required(
    table: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS
) -> tuple[DataFrame, DataFrame]:
    marked = table.withColumn("missing_fields", missing_fields(table, fields))
    complete = F.size("missing_fields") == 0
    return marked.filter(complete).drop("missing_fields"), marked.filter(~complete)


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys seen more than once. Counts combine before the shuffle, so a hot key is one row per task."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def surplus_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows repeat an earlier key."""
    return duplicate_keys(table, keys).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def validate_batch(
    batch: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS, ordinal: str | None = None
) -> None:
    """All or nothing, for one collection run: raise on the first kind of defect found."""
    if batch.isEmpty():
        raise ValueError("the source returned no postings")
    _, bad = split_required(batch, fields)
    ordered = bad.orderBy(ordinal) if ordinal else bad
    first = ordered.limit(1).collect()
    if first:
        place = f" {first[0][ordinal]}" if ordinal else ""
        names = ", ".join(first[0]["missing_fields"])
        raise ValueError(f"posting record{place} is missing: {names}")
    repeated = duplicate_keys(batch, ["company", "job_id"]).limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate {repeated[0]['company']} job id: {repeated[0]['job_id']}")


def quality_summary(
    postings: DataFrame, job_id: str, description: str, posting_date: str, location: str, team: str
) -> DataFrame:
    """Measures of a batch in one pass, as (measure, value) rows.

    A null description counts as held and blank places count as places, as in the prototype.
    """
    measures = {
        "total_jobs": F.count(F.lit(1)),
        "unique_job_ids": F.count_distinct(F.col(job_id)),
        "jobs_with_descriptions": F.count_if(F.coalesce(F.col(description) != "", F.lit(True))),
        "jobs_with_posting_dates": F.count(posting_date),
        "distinct_locations": F.count_distinct(F.col(location)),
        "distinct_teams": F.count_distinct(F.col(team)),
    }
    wide = postings.agg(*(value.alias(name) for name, value in measures.items()))
    pairs = ", ".join(f"'{name}', {name}" for name in measures)
    return wide.selectExpr(f"stack({len(measures)}, {pairs}) AS (measure, value)")


def outside_domain(table: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """Rows whose value is not in the list; nulls are not judged."""
    return table.filter(~F.col(column).isin(*allowed))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is set but unknown to the parent."""
    keys = parent.select(F.col(parent_key).alias("_parent_key")).distinct()
    linked = child.filter(F.col(child_key).isNotNull())
    return linked.join(keys, linked[child_key] == keys["_parent_key"], "left_anti")


def cascade_delete(child: DataFrame, child_key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """The child rows that remain when their parents in `deleted` go."""
    keys = deleted.select(F.col(deleted_key).alias("_gone_key")).distinct()
    return child.join(keys, child[child_key] == keys["_gone_key"], "left_anti")


def field_accuracy(
    truth: DataFrame, collected: DataFrame, key: str, fields: Sequence[str],
    sample: int = ACCURACY_SAMPLE, target: float = ACCURACY_TARGET,
) -> DataFrame:
    """Per field: the share of truth rows whose collected value agrees, and whether that passes.

    Truth rows that were not collected count against every field; `collected_share` has them too.
    """
    found = collected.select(
        F.col(key), *(F.col(field).alias(f"_got_{field}") for field in fields),
        F.lit(True).alias("_found"),
    )
    agree = {
        field: F.col("_found").isNotNull() & F.col(field).eqNullSafe(F.col(f"_got_{field}"))
        for field in fields
    }
    totals = truth.join(found, key, "left").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_found").alias("n_found"),
        *(F.count_if(same).alias(f"_ok_{field}") for field, same in agree.items()),
    )
    pairs = ", ".join(f"'{field}', _ok_{field}" for field in fields)
    long = totals.selectExpr("n", "n_found", f"stack({len(fields)}, {pairs}) AS (field, n_correct)")
    accuracy, coverage = F.col("n_correct") / F.col("n"), F.col("n_found") / F.col("n")
    return long.select(
        "field", "n", "n_correct",
        F.round(accuracy, 4).alias("accuracy"),
        F.round(coverage, 4).alias("collected_share"),
        ((F.col("n") >= sample) & (accuracy >= target) & (coverage >= target)).alias("accepted"),
    )


def confusion_counts(labelled: DataFrame, truth: str, predicted: str) -> DataFrame:
    return labelled.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def binary_scores(labelled: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, precision and recall of a 0/1 prediction, in one pass."""
    actual, guess = F.col(truth) == 1, F.col(predicted) == 1
    counts = labelled.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(actual & guess).alias("true_positive"),
        F.count_if(~actual & guess).alias("false_positive"),
        F.count_if(actual & ~guess).alias("false_negative"),
        F.count_if(~actual & ~guess).alias("true_negative"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.round(F.try_divide(part, whole), 6)

    hit = F.col("true_positive")
    return counts.select(
        "*",
        share(hit + F.col("true_negative"), F.col("n")).alias("accuracy"),
        share(hit, hit + F.col("false_positive")).alias("precision"),
        share(hit, hit + F.col("false_negative")).alias("recall"),
    )


def source_coverage(register: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Register rows with their last attempt and the gaps an audit asks about.

    `register` has status and exclusion_reason; `log` has scrape_date, status and error_message.
    """
    attempt = F.struct("scrape_date", "scrape_id")
    last = log.groupBy(key).agg(
        F.max("scrape_date").alias("last_attempt"),
        F.max_by("status", attempt).alias("last_status"),
        F.max_by("error_message", attempt).alias("last_error"),
        F.count(F.lit(1)).alias("attempts"),
    )
    excluded = F.col("source_status") == "excluded"
    gap = (
        F.when(F.nullif(F.col("source_status"), F.lit("")).isNull(), "no status")
        .when(excluded & F.nullif(F.col("exclusion_reason"), F.lit("")).isNull(), "no exclusion reason")
        .when(~excluded & F.col("last_attempt").isNull(), "never attempted")
    )
    return register.join(last, key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).withColumn("gap", gap)


def trace_audit(postings: DataFrame, by: str, fields: Mapping[str, str]) -> DataFrame:
    """Per group: rows, rows lacking each trace field, and rows that can be traced in full."""
    lacking = {name: is_missing(postings, column) for name, column in fields.items()}
    whole = ~F.greatest(*lacking.values()) if len(lacking) > 1 else ~next(iter(lacking.values()))
    return postings.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(flag).alias(f"no_{name}") for name, flag in lacking.items()),
        F.count_if(whole).alias("traceable"),
    )
