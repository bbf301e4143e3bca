"""Writers. Every one replaces or appends whole outputs; none reads the path it overwrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed_values import PLATFORM_HOSTS
from ..schemas import GOLD_TREND, SILVER, conform
from .landed import source_platform
from .register_values import REGISTER_ROWS, SOURCE_ROWS


def write_records(records: DataFrame, path: str) -> None:
    """UTF-8 JSON lines. The new output is complete beside the old one before it takes its place."""
    _swapped_in(records.sparkSession, path, lambda staged: records.write.option("ignoreNullFields", False).json(staged))


def _swapped_in(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside `path`, then swap. Wherever a run stops, one complete copy is left: the old one as `path` or, between the
    two renames, as `path.old`, which the next run puts back before it does anything else."""
    fs, root = _file_system(spark, path)
    staged, previous = root.suffix(".new"), root.suffix(".old")
    if not fs.exists(root) and fs.exists(previous):
        _rename(fs, previous, root)
    for leftover in (staged, previous):
        fs.delete(leftover, True)
    write(staged.toString())
    if fs.exists(root):
        _rename(fs, root, previous)
    _rename(fs, staged, root)
    fs.delete(previous, True)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def write_results(results: DataFrame, path: str) -> bool:
    """Classification results; an empty table writes nothing and leaves the old output."""
    if results.isEmpty():
        return False
    write_records(results, path)
    return True


def write_silver(table: DataFrame, name: str, root: str) -> None:
    _swapped_in(table.sparkSession, f"{root}/silver/{name}", lambda staged: conform(table, SILVER[name]).write.parquet(staged))


def read_silver(spark: SparkSession, name: str, root: str) -> DataFrame:
    return spark.read.schema(SILVER[name]).parquet(f"{root}/silver/{name}")


def append_log(log: DataFrame, root: str) -> None:
    conform(log, SILVER["scrape_log"]).write.mode("append").parquet(f"{root}/silver/scrape_log")


def write_trend_snapshot(snapshot: DataFrame, root: str) -> None:
    """One partition per snapshot date and run; writing a run again replaces that run only."""
    (
        conform(snapshot, GOLD_TREND).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date", "scrape_id")
        .parquet(f"{root}/gold/category_trend_snapshot")
    )


def read_trend_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(GOLD_TREND).parquet(f"{root}/gold/category_trend_snapshot")


def load_register(spark: SparkSession, root: str) -> DataFrame:
    """Full refresh of the company register."""
    rows = spark.createDataFrame(REGISTER_ROWS, SILVER["company"])
    write_silver(rows, "company", root)
    return read_silver(spark, "company", root)


def load_source_register(spark: SparkSession, root: str) -> DataFrame:
    """Where each company's postings come from: class of source, risk, confidence, platform."""
    surveyed = spark.createDataFrame(
        SOURCE_ROWS, "name STRING, source_class STRING, access_risk STRING, confidence STRING"
    )
    companies = load_register(spark, root).select(
        "company_id", "name", "data_source_status",
        F.col("career_page_url").alias("endpoint"),
        source_platform("career_page_url", PLATFORM_HOSTS).alias("source_platform"),
    )
    register = companies.join(surveyed, "name", "left")
    _swapped_in(spark, f"{root}/silver/source_register", lambda staged: register.write.parquet(staged))
    return spark.read.parquet(f"{root}/silver/source_register")
