from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from hirelens.plans import maintenance as m
from hirelens.streaming.landing import MergedTable, start_landing

DDL = "url string, title string, seen string"


def rows(table):
    return {tuple(row) for row in table.collect()}


def test_upsert_is_idempotent_and_prefers_the_batch(spark):
    current = spark.createDataFrame([("a", "old", "2026-01-01"), ("b", "old", "2026-03-01")], DDL)
    batch = spark.createDataFrame([("a", "new", "2026-01-01"), ("b", "late", "2026-02-01"), ("c", "x", "2026-01-01"), ("c", "y", "2026-01-01")], DDL)
    once = m.upsert(current, batch, ["url"], "seen")
    expected = {("a", "new", "2026-01-01"), ("b", "old", "2026-03-01"), ("c", "y", "2026-01-01")}
    assert rows(once) == expected
    assert rows(m.upsert(once, batch, ["url"], "seen")) == expected


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    table = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS key", "id AS day")
    latest = m.latest_per_key(table, ["key"], m.newest_by_date(table, "day", ["key"]))
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    assert latest.count() == 2001 and latest.filter("key = 0").first()["day"] == 2997


def test_failed_runs_expire_nothing(spark):
    previous = spark.createDataFrame(
        [("a", "W", "active", date(2026, 1, 1)), ("b", "W", "active", date(2026, 1, 1)), ("c", "S", "active", date(2026, 1, 1))],
        "url string, company string, status string, last_checked date")
    now = spark.createDataFrame([("a", "W"), ("d", "W")], "url string, company string")
    succeeded = spark.createDataFrame([("W",)], "company string")
    fresh = m.refresh_status(previous, now, succeeded, "url", "company", F.lit("2026-02-01").cast("date"))
    got = {r["url"]: (r["company"], r["status"], str(r["last_checked"])) for r in fresh.collect()}
    assert got == {"a": ("W", "active", "2026-02-01"), "b": ("W", "removed", "2026-02-01"),
                   "c": ("S", "active", "2026-01-01"), "d": ("W", "active", "2026-02-01")}


def test_silver_rows_have_nulls_and_stable_ids(spark):
    post = spark.createDataFrame(
        [("W", "Senior Engineer", "", "Full-time", "Perth", "text", "2026-08-01T10:00:00Z", "2026-08-11T01:00:00Z", "https://x/1", "Lever", 1.0, 2.0, "USD")],
        "company string, job_title string, department string, commitment string, location string, description string, posting_date string, "
        "collected_at string, source_url string, ats string, salary_min double, salary_max double, salary_currency string")
    companies = spark.createDataFrame([("c-1", "W")], "company_id string, name string")
    row = m.silver_postings(post, companies).first()
    assert row["department"] is None and row["company_id"] == "c-1" and row["seniority_level"] == "Senior"
    assert str(row["posted_date"]) == "2026-08-01" and row["salary_max"] == 2.0
    assert row["job_id"] == m.silver_postings(post, companies).first()["job_id"]


def test_stream_equals_batch_and_survives_a_replay(spark, tmp_path):
    drops, root = tmp_path / "drops", str(tmp_path / "table")
    drops.mkdir()
    batches = [[("a", "1", "2026-01-01"), ("b", "1", "2026-01-02")], [("a", "2", "2026-01-03")], [("b", "0", "2026-01-01"), ("c", "1", "2026-01-01")]]
    names = ["url", "title", "seen"]
    for number, batch in enumerate(batches):
        (drops / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(names, row))) for row in batch))
    schema = spark.createDataFrame([], DDL).schema
    table = MergedTable(spark, root, ["url"], "seen")
    for progress in ("p1", "p2"):  # the second stream lands every drop once more
        start_landing(spark, str(drops), schema, table, str(tmp_path / progress), files_per_batch=1, compact_every=2).awaitTermination()
    expected = {("a", "2", "2026-01-03"), ("b", "1", "2026-01-02"), ("c", "1", "2026-01-01")}
    assert rows(table.read().select(*names)) == expected
    table.compact()
    table.compact()
    assert rows(table.read().select(*names)) == expected


def test_a_replayed_batch_replaces_itself_and_later_drops_win_ties(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), ["url"], "seen")
    assert table.read() is None
    table.append(spark.createDataFrame([("a", "z", "d1")], DDL), "s-0")
    table.append(spark.createDataFrame([("a", "b", "d1")], DDL), "s-1")
    table.append(spark.createDataFrame([("a", "z", "d1")], DDL), "s-0")
    assert rows(table.read().select("url", "title", "seen")) == {("a", "b", "d1")}
    assert len(list((tmp_path / "t" / "delta").iterdir())) == 2


def test_unfinished_parts_are_ignored(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), ["url"], "seen")
    table.append(spark.createDataFrame([("a", "1", "x")], DDL), "s-0")
    (tmp_path / "t" / "base" / "0000000009").mkdir(parents=True)
    (tmp_path / "t" / "delta" / "0000000007-s-9").mkdir()
    assert rows(table.read().select("url", "title", "seen")) == {("a", "1", "x")}


def test_retention_drops_old_partitions_only(spark, tmp_path):
    root = str(tmp_path / "bronze")
    spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-03-01")], "raw string, collected string").write.partitionBy("collected").parquet(root)
    assert m.drop_old_partitions(spark, root, "collected", "2026-02-01") == ["collected=2026-01-01"]
    assert [r["raw"] for r in spark.read.parquet(root).collect()] == ["b"]


def test_run_log_is_deterministic(spark):
    batch = spark.createDataFrame([("W",), ("W",), ("S",)], "company string")
    first, again = (rows(m.run_log(batch, "company", F.lit("2026-01-01").cast("date"))) for _ in range(2))
    assert first == again and len(first) == 2


def test_postings_with_maps_have_an_order(spark):
    ddl = "url string, pay map<string,string>, nested array<map<string,int>>, seen string"
    one, two = ("a", {"x": "1", "y": "2"}, [{"k": 1}], "2026-01-01"), ("a", {"y": "2", "x": "3"}, [{"k": 1}], "2026-01-01")
    for order in ([one, two], [two, one]):
        table = spark.createDataFrame(order, ddl)
        assert m.latest_per_key(table, ["url"], m.newest_by_date(table, "seen", ["url"])).first()["pay"]["x"] == "3"


def test_a_posting_seen_without_a_company_is_active(spark):
    previous = spark.createDataFrame([("a", "W", "active", date(2026, 1, 1))], "url string, company string, status string, last_checked date")
    now = spark.createDataFrame([("a", None), ("b", None), ("b", "V")], "url string, company string")
    fresh = m.refresh_status(previous, now, spark.createDataFrame([("W",)], "company string"), "url", "company", F.lit("2026-02-01").cast("date"))
    assert {(r["url"], r["company"], r["status"]) for r in fresh.collect()} == {("a", "W", "active"), ("b", "V", "active")}
