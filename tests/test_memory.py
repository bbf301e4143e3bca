"""Steps that hold little at once, against the plain forms of the same work."""

from hirelens.operators.aggregates import comparison, listed_comparison
from pyspark.sql import functions as F


def test_listed_comparison_counts_as_comparison_does(spark):
    lists = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "b", "c"]), (2, ["a"]), (3, []), (4, None), (None, ["a"]), (5, ["c"])], "key long, items array<string>")
    places = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, None), (3, "x"), (None, "x"), (6, "z")], "key long, place string")
    found = listed_comparison(lists, "items", "item", places, "place", "key")
    pairs = lists.select("key", F.explode("items").alias("item")).join(places, "key")
    wanted = comparison(pairs, "item", "place", "key")
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_skills_are_not_copied_to_a_row_each_before_the_last_join(spark):
    import __spark_entry__
    plan = __spark_entry__.queries()["skill_company_long"](spark, __spark_entry__.SMOKE_DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(") < plan.index("Join")
