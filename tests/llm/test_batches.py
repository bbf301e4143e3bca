"""What a written step hands to Python at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from hirelens.llm import work


def test_written_steps_hand_over_small_batches(spark):
    texts = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["size"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    sizes = [row["size"] for row in work.written(texts.mapInArrow(size, "size long"), "sizes").collect()]
    assert sum(sizes) >= 40 << 20 and max(sizes) <= work.BATCH_BYTES + (2 << 20)
    assert spark.conf.get(name) == before
