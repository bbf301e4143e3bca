"""Counts, distributions and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import TREND_MIN_PERIODS, TREND_MIN_RECORDS
from ..functions.salary import salary_band


def counts(table: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the total and the rows that meet each condition, in one pass."""
    return table.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(test).alias(name) for name, test in conditions.items())
    )


def distinct_counts(table: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return table.agg(*(count(F.col(name)).alias(f"distinct_{name}") for name in columns))


def value_counts(table: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, null included, most frequent first."""
    counted = table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.asc_nulls_last(column))


def postings_per(table: DataFrame, column: str, key: str) -> DataFrame:
    """Distinct postings per value; a posting with several values counts once under each."""
    return table.groupBy(column).agg(F.count_distinct(F.col(key)).alias("n_postings"))


def skill_demand(pairs: DataFrame, skill: str, key: str, total: Column) -> DataFrame:
    """Distinct postings per skill and their share of `total` postings."""
    return postings_per(pairs, skill, key).withColumn("share", F.round(F.col("n_postings") / total, 6))


def distributions(table: DataFrame, dimensions: Sequence[str], key: str | None = None) -> DataFrame:
    """One count table per dimension, as (dimension, value, n). Pass `key` for distinct postings.

    Each dimension is its own small aggregate over pairs, planned as one grouping-sets pass.
    """
    count = F.count(F.lit(1)) if key is None else F.count_distinct(F.col(key))
    sets = [[F.col(name)] for name in dimensions]
    grouped = table.groupingSets(sets, *(F.col(name) for name in dimensions)).agg(
        count.alias("n"), F.grouping_id().alias("_set")
    )
    width = len(dimensions)
    name = value = None
    for index, dimension in enumerate(dimensions):
        # grouping_id has a zero bit for the one column that is grouped.
        mine = F.col("_set") == ((1 << width) - 1) - (1 << (width - 1 - index))
        text = F.col(dimension).cast("string")
        name = F.when(mine, dimension) if name is None else name.when(mine, dimension)
        value = F.when(mine, text) if value is None else value.when(mine, text)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def category_snapshot(
    labels: DataFrame, category: str, company: str, key: str, scrape_id: Column, snapshot_date: Column
) -> DataFrame:
    """Distinct postings per (category, company) and per category.

    `is_total` tells the rows over all companies from those of a missing company. The snapshot id
    is derived from the run, the category and the company, so a rerun yields the same rows.
    """
    grouped = labels.groupingSets(
        [[F.col(category), F.col(company)], [F.col(category)]], F.col(category), F.col(company)
    ).agg(F.count_distinct(F.col(key)).alias("job_count"), (F.grouping(company) == 1).alias("is_total"))
    natural = F.concat_ws(
        "~", scrape_id.cast("string"), F.coalesce(F.col(category).cast("string"), F.lit("")),
        F.when(F.col("is_total"), "*").otherwise(F.coalesce(F.col(company).cast("string"), F.lit(""))),
    )
    return grouped.select(
        F.sha2(natural, 256).alias("snapshot_id"), scrape_id.alias("scrape_id"),
        F.col(category).alias("category_id"), F.col(company).alias("company_id"),
        "job_count", snapshot_date.alias("snapshot_date"), "is_total",
    )


def period_counts(table: DataFrame, dimensions: Sequence[str], date: str, period: str) -> DataFrame:
    start = F.date_trunc(period, F.col(date)).cast("date").alias("period")
    return table.filter(F.col(date).isNotNull()).groupBy(*dimensions, start).agg(F.count(F.lit(1)).alias("n"))


def gated_trend(
    table: DataFrame, dimensions: Sequence[str], date: str, period: str, basis: str = "posting_date",
    min_periods: int = TREND_MIN_PERIODS, min_records: int = TREND_MIN_RECORDS,
) -> DataFrame:
    """Counts per period for groups with enough evidence; one `insufficient_data` row for the others.

    Periods below `min_records` do not count as evidence and are not shown.
    """
    grouped = period_counts(table, dimensions, date, period)
    strong = F.col("n") >= min_records
    # The window sees one row per period, never the postings.
    group = Window.partitionBy(*dimensions)
    marked = grouped.withColumns({
        "n_periods": F.count_if(strong).over(group),
        "_first": F.row_number().over(group.orderBy("period")),
    })
    enough = F.col("n_periods") >= min_periods
    shown = marked.filter((enough & strong) | (~enough & (F.col("_first") == 1)))
    return shown.select(
        *dimensions,
        F.when(enough, F.col("period")).alias("period"),
        F.when(enough, F.col("n")).alias("n"),
        "n_periods",
        F.when(enough, "trend").otherwise("insufficient_data").alias("state"),
        F.lit(basis).alias("date_basis"),
    )


def calendar_counts(table: DataFrame, dimensions: Sequence[str], date: str, period: str) -> DataFrame:
    """Counts of every period from a group's first one to the last one of the table; periods without records count 0.

    Only counted periods are spread over the calendar, never records.
    """
    counted = period_counts(table, dimensions, date, period)
    last = counted.agg(F.max("period").alias("last")).scalar()
    step = F.expr("interval 3 months" if period == "quarter" else f"interval 1 {period}")
    spans = counted.groupBy(*dimensions).agg(F.min("period").alias("_from"))
    empty = spans.select(*dimensions, F.explode(F.sequence("_from", last, step)).alias("period"), F.lit(0).cast("bigint").alias("n"))
    return counted.unionByName(empty).groupBy(*dimensions, "period").agg(F.sum("n").alias("n"))


def growth(
    table: DataFrame, dimensions: Sequence[str], date: str, period: str,
    min_periods: int = TREND_MIN_PERIODS, min_records: int = TREND_MIN_RECORDS,
) -> DataFrame:
    """Change of every calendar period against the one before it, for groups with enough evidence; one `insufficient_data` row for
    the others.

    A period without records is a zero: it is a fall from the period before, and what follows it has no relative change.
    """
    group = Window.partitionBy(*dimensions)
    counted = calendar_counts(table, dimensions, date, period).withColumns({
        "previous": F.lag("n").over(group.orderBy("period")),
        "n_periods": F.count_if(F.col("n") >= min_records).over(group),
        "_first": F.row_number().over(group.orderBy("period")),
    })
    enough = F.col("n_periods") >= min_periods
    change = F.round(F.try_divide(F.col("n") - F.col("previous"), F.col("previous")), 6)
    direction = (
        F.when(F.col("n") > F.col("previous"), "up")
        .when(F.col("n") < F.col("previous"), "down")
        .when(F.col("n") == F.col("previous"), "flat")
    )
    shown = {"period": F.col("period"), "n": F.col("n"), "previous": F.col("previous"), "change": change, "direction": direction}
    return counted.filter(enough | (F.col("_first") == 1)).select(
        *dimensions, *(F.when(enough, value).alias(name) for name, value in shown.items()), "n_periods",
        F.when(enough, "trend").otherwise("insufficient_data").alias("state"),
    )


def salary_bands(table: DataFrame, amount: str, units: Sequence[str]) -> DataFrame:
    """Postings per band; currencies and pay periods stay apart."""
    priced = table.filter(F.col(amount).isNotNull())
    return priced.groupBy(*units, salary_band(amount).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def run_rates(log: DataFrame, by: Sequence[str], success: str = "success") -> DataFrame:
    good = F.col("status") == success
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(good).alias("succeeded"),
        F.round(F.avg(good.cast("int")), 6).alias("success_rate"),
    )


def comparison(pairs: DataFrame, row: str, column: str, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct postings per (row, column): wide for a short list of columns, long otherwise."""
    if columns is None:
        return pairs.groupBy(row, column).agg(F.count_distinct(F.col(key)).alias("n_postings"))
    # Distinct first, then a plain pivoted count, which combines before its shuffle.
    unique = pairs.filter(F.col(column).isin(*columns)).select(row, column, key).distinct()
    wide = unique.groupBy(row).pivot(column, list(columns)).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=list(columns))


def listed_comparison(lists: DataFrame, items: str, row: str, places: DataFrame, column: str, key: str) -> DataFrame:
    """`comparison` in long form, of rows (key, items) with a list each and of places (key, column).

    The lists of a posting, and its places, become one each by its key before they meet. So items are not copied to a row each until all
    that is left to do is a count, which combines before its shuffle.
    """
    own = lists.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(items))).alias("_items"))
    held = places.groupBy(F.col(key).alias("_key")).agg(F.collect_set(F.struct(column)).alias("_places"))
    pairs = own.join(held, F.col(key) == F.col("_key")).select(F.explode("_items").alias(row), "_places").select(row, F.inline("_places"))
    return pairs.groupBy(row, column).agg(F.count(F.lit(1)).alias("n_postings"))
