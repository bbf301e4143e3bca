"""The company register: lookups, new-company checks and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import Row

from ..functions.text import contains_keyword
from ..session import written

REQUIRED = ("name", "website_url", "career_page_url", "company_type", "data_source_status")
UNIQUE = ("name", "website_url", "career_page_url")


class NotFound(LookupError):
    """No row has the wanted key."""


def find_one(table: DataFrame, key: str, value) -> Row:
    rows = table.filter(F.col(key) == F.lit(value)).limit(1).collect()
    if not rows:
        raise NotFound(f"{key} not found: {value}")
    return rows[0]


def by_name(companies: DataFrame, name: str = "name") -> DataFrame:
    return companies.orderBy(name)


def check_new_companies(new: DataFrame, existing: DataFrame, ordinal: str) -> DataFrame:
    """Trimmed rows with a `reject_reason`, null for those that may be added, as if the rows were added one by one.

    Blank fields are judged first, then name, website and careers page in that order. A value is taken when the register has
    it or when an earlier row that was itself added brings it; rejected rows block nobody.

    Which rows are added is found by rounds over the rows that share a value with another one: rows that come first in all
    their values are added, rows that share a value with them are rejected, and the rest goes on. A round settles at
    least the first open row of every group of rivals, so there are as many rounds as the longest chain of rivals has links.
    Each round is written; values of which nobody else has anything never enter one.

    `ordinal` numbers the rows without repeats.
    """
    trimmed = new.withColumns({field: F.regexp_replace(F.col(field), r"(?U)\A\s+|\s+\z", "") for field in REQUIRED})
    blank = None
    for field in REQUIRED:
        hollow = F.coalesce(F.col(field), F.lit("")) == ""
        text = F.lit(f"{field} must not be empty")
        blank = F.when(hollow, text) if blank is None else blank.when(hollow, text)
    judged = trimmed.withColumn("_blank", blank)
    disputed = written(_disputed_values(judged.filter("_blank IS NULL"), existing, ordinal), "rivals")
    owners = _owners(disputed, ordinal)
    used = disputed.join(owners, ["_place", "_value"], "left").filter(F.col("_taken") | (F.col("_owner") < F.col(ordinal)))
    worst = used.groupBy(F.col(ordinal).alias("_row")).agg(F.min("_place").alias("_worst"))
    conflict = F.element_at(F.array(*(F.lit(f"company already exists with {field}") for field in UNIQUE)), F.col("_worst") + 1)
    checked = judged.join(worst, F.col(ordinal) == F.col("_row"), "left")
    reason = F.coalesce(F.col("_blank"), F.when(F.col("_worst").isNotNull(), conflict))
    return checked.withColumn("reject_reason", reason).select(*new.columns, "reject_reason")


def _values(table: DataFrame, *kept: str) -> DataFrame:
    """The unique fields of each row as rows (_place, _value)."""
    each = F.array(*(F.struct(F.lit(place).alias("_place"), F.col(field).alias("_value")) for place, field in enumerate(UNIQUE)))
    return table.select(*kept, F.inline(each))


def _disputed_values(rows: DataFrame, existing: DataFrame, ordinal: str) -> DataFrame:
    """(ordinal, _place, _value, _taken): values that several rows or the register have, and whether the register does."""
    offered = _values(rows, ordinal).withColumn("_n", F.lit(1))
    known = _values(existing).select(F.lit(None).cast(rows.schema[ordinal].dataType).alias(ordinal), "_place", "_value", F.lit(0).alias("_n"))
    # Offers and register values are counted together; only values in dispute meet the rows again.
    counted = offered.unionByName(known).groupBy("_place", "_value").agg(F.sum("_n").alias("_rows"), F.bool_or(F.col("_n") == 0).alias("_taken"))
    marked = counted.filter((F.col("_rows") > 1) | (F.col("_taken") & (F.col("_rows") > 0))).drop("_rows")
    return offered.drop("_n").join(marked, ["_place", "_value"])


def _owners(disputed: DataFrame, ordinal: str) -> DataFrame:
    """(_place, _value, _owner): the row of the batch that is added with each disputed value."""
    pair = F.collect_list(F.struct("_place", "_value")).alias("_values")
    open_rows = disputed.groupBy(ordinal).agg(F.bool_or("_taken").alias("_out"), pair).filter("NOT _out")
    found = []
    while True:
        values = open_rows.select(ordinal, F.size("_values").alias("_size"), F.inline("_values"))
        # The first row of a value is the only one that can be added with it; it must be first in all its values.
        first = values.groupBy("_place", "_value").agg(F.min(F.struct(F.col(ordinal).alias("_owner"), "_size")).alias("_first"))
        first = first.select("_place", "_value", "_first.*")
        added = first.groupBy("_owner").agg(F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_all")).filter("_n = _all").select("_owner")
        owners = written(first.drop("_size").join(added, "_owner", "left_semi"), "owners")
        found.append(owners)
        met = values.join(owners, ["_place", "_value"], "left")
        left = met.groupBy(ordinal).agg(F.bool_or(F.col("_owner").isNotNull()).alias("_out"), pair).filter("NOT _out")
        open_rows = written(left, "open")
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, found)


def search_companies(companies: DataFrame, keyword: str = "", kind: str = "All",
                     name: str = "name", type_column: str = "company_type") -> DataFrame:
    found = companies.filter(contains_keyword(keyword, name))
    return found if kind == "All" else found.filter(F.col(type_column) == kind)


def company_postings(postings: DataFrame, key: str, company_id) -> DataFrame:
    return postings.filter(F.col(key) == F.lit(company_id))


def open_positions(companies: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """Postings per company, zero kept. Counting comes before the join, so no company is hot in it."""
    counts = postings.groupBy(key).agg(F.count(F.lit(1)).alias("open_positions"))
    return companies.join(counts, key, "left").withColumn(
        "open_positions", F.coalesce("open_positions", F.lit(0))
    )

