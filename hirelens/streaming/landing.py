"""Collection drops as a file stream, kept as the newest row per key.

A micro-batch only appends its own newest rows as a delta, so its cost follows the drop and not
the table. Reading merges the base with the deltas after it; `compact` folds them into a new base
from time to time. Deltas are named after their stream and batch, so a replayed batch replaces its
own delta, and a base or delta without its success marker is not there yet.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.maintenance import latest_per_key, newest_by_date

SEQUENCE = "_sequence"


class MergedTable:
    """`base/<sequence>` holds all rows up to a sequence, `delta/<sequence>-<batch>` one drop each."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], date: str) -> None:
        self.spark, self.root, self.keys, self.date = spark, root, list(keys), date
        self._new_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new_path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> dict[str, int]:
        """Names with their sequence; only folders are listed."""
        folder = self._new_path(f"{self.root}/{kind}")
        if not self._fs.exists(folder):
            return {}
        names = [item.getPath().getName() for item in self._fs.listStatus(folder)]
        return {
            name: int(name.split("-", 1)[0])
            for name in names if self._fs.exists(self._new_path(f"{self.root}/{kind}/{name}/_SUCCESS"))
        }

    def _parts(self) -> tuple[list[str], int]:
        """Paths to read, and the highest sequence among them."""
        bases, deltas = self._complete("base"), self._complete("delta")
        upto = max(bases.values(), default=-1)
        paths = [f"{self.root}/base/{name}" for name, number in bases.items() if number == upto]
        paths += [f"{self.root}/delta/{name}" for name, number in deltas.items() if number > upto]
        return paths, max([upto, *deltas.values()])

    def _merged(self, rows: DataFrame) -> DataFrame:
        """The later date wins, then the later drop, then the greater row."""
        newest, *others = newest_by_date(rows.drop(SEQUENCE), self.date, self.keys)
        return latest_per_key(rows, self.keys, [newest, F.desc(SEQUENCE), *others])

    def read(self) -> DataFrame | None:
        paths, _ = self._parts()
        if not paths:
            return None
        return self._merged(self.spark.read.parquet(*paths)).drop(SEQUENCE)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add a drop. Adding the same batch again replaces it in place."""
        _, last = self._parts()
        known = [name for name in self._complete("delta") if name.split("-", 1)[1] == batch]
        name = known[0] if known else f"{last + 1:010d}-{batch}"
        numbered = rows.withColumn(SEQUENCE, F.lit(int(name.split("-", 1)[0])).cast("bigint"))
        self._merged(numbered).write.mode("overwrite").parquet(f"{self.root}/delta/{name}")

    def compact(self) -> None:
        """Fold the deltas into a new base. What the base before last held is dropped, so that a
        reader of the last one is not disturbed."""
        paths, upto = self._parts()
        bases = self._complete("base")
        if not paths or upto in bases.values():
            return
        self._merged(self.spark.read.parquet(*paths)).write.mode("overwrite").parquet(
            f"{self.root}/base/{upto:010d}"
        )
        before = max(bases.values(), default=-1)
        for kind in ("base", "delta"):
            for name, number in self._complete(kind).items():
                if number < before or (kind == "delta" and number <= before):
                    self._fs.delete(self._new_path(f"{self.root}/{kind}/{name}"), True)


def start_landing(
    spark: SparkSession, drops: str, schema: StructType | str, table: MergedTable, checkpoint: str,
    files_per_batch: int | None = None, compact_every: int = 50,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Drain the drops that are there. `prepare` may normalise each micro-batch first."""

    def apply(batch: DataFrame, number: int) -> None:
        table.append(prepare(batch) if prepare else batch, f"{stream_id(spark, checkpoint)}-{number}")
        if (number + 1) % compact_every == 0:
            table.compact()

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.json(drops).writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity a stream keeps across restarts, from its own checkpoint."""
    text = spark.read.text(f"{checkpoint}/metadata").first()["value"]
    return json.loads(text)["id"]
