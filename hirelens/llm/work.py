"""Intermediate tables in the folder that all machines share, and the query register.

A written table cuts lineage: a lost executor costs at most the stage that reads it. Tables go below
`spark.checkpoint.dir`; where that is unset, a single-machine session gets a scratch folder and any
other session is refused, because executors could not see one.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What tasks run travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_scratch: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    key = context.applicationId
    if key not in _scratch:
        _scratch[key] = tempfile.mkdtemp(prefix="spark-")
    return _scratch[key]


#: Bytes of an Arrow batch between the JVM and Python while a step is written. Both sides hold a batch or two for each core.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of `BATCH_BYTES` at most for what is run inside; a session that asks for smaller ones keeps them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    digits = before.lower().removesuffix("b")
    if digits.isdigit() and 0 < int(digits) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(name, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and read them from there."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def held_out(fold: int, folds: int, doc_id: str = "doc_id") -> Column:
    """Whether a document's labels are kept from learning; rows without an id always are."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(True))


def broadcast_if_small(frame: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A written table of a few short columns, to be sent to all tasks if it has at most `rows` rows; a larger one meets the
    other side in a shuffle join with the same result."""
    return F.broadcast(frame) if frame.count() <= rows else frame
