"""Envelopes stay dealt over the session's number of partitions, however few bytes they have."""

from hirelens.plans.catalog import sources


def test_envelopes_are_not_merged_into_fewer_partitions(spark):
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sources.board_envelopes(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == asked > 1
