"""Session helpers shared by tests, the bench and stand-alone jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "hirelens", cores: int | str = "*") -> SparkSession:
    """A single-machine session. On a cluster, pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all machines see: the one the session names in spark.checkpoint.dir.

    A single-machine session without one gets a scratch folder; any other session is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def written(table: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and read them from there: cuts lineage, survives lost executors."""
    path = f"{shared_folder(table.sparkSession).rstrip('/')}/steps/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
