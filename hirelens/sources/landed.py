"""Readers of landed files. Schemas are given, never inferred; bad rows stay visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import Row, StructType

from ..fixed_values import ANALYSIS_COLUMNS
from ..functions.binding import computed_once
from ..functions.markup import unescape_entities
from ..functions.salary import with_any_salary
from ..functions.text import blank_to_null, title_tokens
from ..schemas import GREENHOUSE_RAW, LEVER_RAW, POSTING, RESPONSE, SMARTRECRUITERS_PAGE, SMARTRECRUITERS_RAW
from .variants import CORRUPT, envelopes, fields_of, is_object, items_of, objects, variant_documents

def spread(scan: DataFrame) -> DataFrame:
    """Share out a scan of few files before costly work per row.

    A large input has more splits than there are cores and stays as it is, without a shuffle.
    Only for plain scans, whose partitions are known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def split_malformed(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that could be read, and the raw text of the others.

    A field of another shape than declared, such as a text where an object is usual, reads as null and leaves the rest of its
    row, and the other items of its envelope, as they are. Text that is no JSON, documents without the list they should hold and
    items that are no objects are set apart.
    """
    return landed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), landed.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_lever(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A top-level array of postings: one row each, with its place as `ordinal`."""
    return objects(spark, path, LEVER_RAW, multi_line)


def read_greenhouse(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Envelopes of jobs with a declared total; jobs that are no objects stand in `odd_items`."""
    return envelopes(spark, path, "jobs", GREENHOUSE_RAW, multi_line)


def read_smartrecruiters_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Summary pages; summaries that are no objects stand in `odd_items`."""
    return envelopes(spark, path, "content", SMARTRECRUITERS_PAGE, multi_line)


def read_smartrecruiters_details(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Detail objects, one a row, with its place in its document as `ordinal`."""
    return objects(spark, path, SMARTRECRUITERS_RAW, multi_line)


def held_columns(schema: str | None) -> list[str]:
    """The keys in a description of objects as schema_of_variant_agg gives it."""
    if schema is None or not schema.startswith("OBJECT"):
        return []
    # The description reads like DDL but for the name of the outer type.
    return StructType.fromDDL("r " + schema.replace("OBJECT<", "STRUCT<"))["r"].dataType.names


def dataset_shape(records: DataFrame) -> Row:
    """Of a variant column v, in one aggregate whose state is a schema, not rows: `n` objects, `n_odd` other values, and the `schema`
    that merges all objects."""
    good = is_object(F.col("v"))
    return records.withColumn("_object", F.when(good, F.col("v"))).agg(
        F.count_if(good).alias("n"), F.count_if(~good).alias("n_odd"), F.expr("schema_of_variant_agg(_object)").alias("schema")
    ).first()


def missing_columns(schema: str | None) -> list[str]:
    """Analysis columns that no record holds, sorted."""
    return sorted(set(ANALYSIS_COLUMNS) - set(held_columns(schema)))


def read_postings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A dataset of normalised postings: not empty, objects only, the analysis columns among the keys that its records hold, text ids.

    A record need not have every column, but a column that no record has is missing.
    """
    records = variant_documents(spark, path, multi_line).select(F.explode(F.coalesce(items_of(F.col("v")), F.array("v"))).alias("v"))
    shape = dataset_shape(records)
    if shape["n_odd"]:
        raise ValueError(f"{shape['n_odd']} records under {path} are no objects")
    if not shape["n"]:
        raise ValueError(f"no postings under {path}")
    if missing := missing_columns(shape["schema"]):
        raise ValueError(f"missing columns: {missing}")
    return records.select(*fields_of(F.col("v"), POSTING))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE).json(path)


def salary_reference(lines: DataFrame, value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """Titled salaries of a pipe-delimited page: cell 0 is the title, the rest the salary text.

    Lines without a salary are dropped. Blanks inside a line stay as they are. `ordinal` gives the line order.
    """
    bare = unescape_entities(F.regexp_replace("_raw", "<[^>]+>", " "))
    trimmed = F.regexp_replace(bare, r"(?U)\A\s+|\s+\z", "")
    held = computed_once(lines.select(F.col(ordinal), F.col(value).alias("_raw")), {"_line": trimmed})
    cells = F.filter(
        F.transform(F.split("_line", r"\|"), lambda cell: F.trim(cell)), lambda cell: cell != ""
    )
    celled = computed_once(held.filter("_line <> ''"), {"_cells": cells})
    delimited = F.size("_cells") >= 2
    title = F.when(delimited, F.try_element_at("_cells", F.lit(1))).otherwise(F.col("_line"))
    rest = F.array_join(F.slice("_cells", 2, F.greatest(F.size("_cells"), F.lit(1))), " ")
    titled = celled.select(
        F.col(ordinal),
        title.alias("title_text"),
        F.when(delimited, rest).otherwise(F.col("_line")).alias("_salary_text"),
    )
    priced = with_any_salary(titled, "_salary_text", stated_only=True).drop("_salary_text")
    return priced.withColumn("title_tokens", title_tokens("title_text"))


def source_platform(endpoint: Column | str, hosts: dict[str, str]) -> Column:
    """Posting platform by endpoint host; a plain careers page is a custom site."""
    column = F.col(endpoint) if isinstance(endpoint, str) else endpoint
    host = F.lower(F.coalesce(F.regexp_extract(column, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))
    named = None
    for fragment, name in hosts.items():
        hit = F.endswith(host, F.lit(fragment))
        named = F.when(hit, name) if named is None else named.when(hit, name)
    return named.when(blank_to_null(host).isNull(), None).otherwise("Custom site")
