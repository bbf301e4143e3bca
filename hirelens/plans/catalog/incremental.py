"""Upsert, status refresh, run log and the landing stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ...operators import aggregates as a
from ...schemas import POSTING
from ...session import shared_folder
from ...sources.sinks import read_silver, read_trend_snapshots, write_silver, write_trend_snapshot
from ...streaming.landing import MergedTable, start_landing
from .. import maintenance as m
from .quality import split_expressions
from .registry import query, table

LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_ORDER = (
    "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, "
    "l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"
)


@query(f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER}) = 1")
def latest_upsert(spark, folder):
    """The newest row of every repeated (order, line)."""
    lines = table(spark, folder, "lineitem")
    return m.latest_per_key(lines, LINE_KEYS, m.newest_by_date(lines, "l_shipdate", LINE_KEYS))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'rewritten' ELSE o_orderpriority END AS title, "
    "CAST(CAST(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS DATE) AS VARCHAR) AS scraped FROM orders"
)
def batch_upsert(spark, folder):
    """Filled postings scraped again, some on the same day: the batch wins there too."""
    orders = table(spark, folder, "orders")
    current = orders.selectExpr("o_orderkey", "o_orderpriority AS title", "CAST(o_orderdate AS DATE) AS scraped")
    again = orders.filter("o_orderstatus = 'F'").selectExpr(
        "o_orderkey", "'rewritten' AS title",
        "CAST(o_orderdate + CASE WHEN o_totalprice > 200000 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS DATE) AS scraped",
    )
    return m.upsert(current, again, ["o_orderkey"], "scraped").withColumn("scraped", F.col("scraped").cast("string"))


@query(
    "WITH p AS (SELECT o_orderkey, o_custkey, 'active' AS status, DATE '2001-01-01' AS last_checked FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'), "
    "c AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'), ok AS (SELECT c_custkey FROM customer WHERE c_acctbal > 2000) "
    "SELECT coalesce(p.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(p.o_custkey, c.o_custkey) AS o_custkey, "
    "CASE WHEN c.o_orderkey IS NOT NULL THEN 'active' WHEN ok.c_custkey IS NOT NULL THEN 'removed' ELSE p.status END AS status, "
    "CAST(CASE WHEN c.o_orderkey IS NOT NULL OR ok.c_custkey IS NOT NULL THEN DATE '2001-09-01' ELSE p.last_checked END AS VARCHAR) AS last_checked "
    "FROM p FULL OUTER JOIN c ON p.o_orderkey = c.o_orderkey LEFT JOIN ok ON coalesce(p.o_custkey, c.o_custkey) = ok.c_custkey"
)
def status_refresh(spark, folder):
    """Old postings against a new collection; failed runs expire nothing."""
    orders = table(spark, folder, "orders")
    known = orders.filter("o_orderdate < TIMESTAMP '2000-01-01'").selectExpr(
        "o_orderkey", "o_custkey", "'active' AS status", "DATE '2001-01-01' AS last_checked"
    )
    seen = orders.filter("o_orderdate >= TIMESTAMP '1998-01-01'").select("o_orderkey", "o_custkey")
    succeeded = table(spark, folder, "customer").filter("c_acctbal > 2000").selectExpr("c_custkey AS o_custkey")
    fresh = m.refresh_status(known, seen, succeeded, "o_orderkey", "o_custkey", F.expr("DATE '2001-09-01'"))
    return fresh.select("o_orderkey", "o_custkey", "status", F.col("last_checked").cast("string").alias("last_checked"))


@query(
    "SELECT sha256(o_custkey || '~2001-09-01') AS scrape_id, o_custkey AS company_id, '2001-09-01' AS scrape_date, count(*) AS jobs_found, 'success' AS status, "
    "CAST(NULL AS VARCHAR) AS error_message FROM orders GROUP BY o_custkey"
)
def run_log(spark, folder):
    return m.run_log(table(spark, folder, "orders"), "o_custkey", F.lit("2001-09-01"))


@query(
    "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) = 1"
)
def stream_upsert(spark, folder):
    """Event drops landed as files, drained by the stream in several batches, newest row per key kept."""
    root = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    drops = table(spark, folder, "events").selectExpr(
        "user_id", "event_type", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS ts", "value"
    )
    drops.repartition(4).write.json(f"{root}/drops")
    merged = MergedTable(spark, f"{root}/table", ["user_id", "event_type"], "ts")
    stream = start_landing(
        spark, f"{root}/drops", drops.schema, merged, f"{root}/progress", files_per_batch=1, compact_every=3
    )
    stream.awaitTermination()
    return merged.read()


POSTED = (
    "CASE WHEN o_orderkey % 7 <> 0 THEN 'Company ' || o_custkey END AS company, CAST(o_orderkey AS STRING) AS job_id, o_orderpriority AS job_title, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Perth' ELSE '' END AS location, array('Perth', 'Oslo') AS all_locations, "
    "'Résumé – text of ' || o_orderkey AS description, '2001-01-0' || (1 + o_orderkey % 9) || 'T00:00:00Z' AS posting_date, "
    "'https://x.example/' || o_orderkey AS source_url, 'Lever' AS ats"
)
POSTED_KEYS = ["source_url"]


def posting_drops(spark, folder):
    """Postings in the library's own schema: a first collection, and a second one of every third posting, in two copies that
    differ in the salary map only."""
    orders = table(spark, folder, "orders")

    def collection(rows, stamp: str, low: str):
        shaped = rows.selectExpr(*split_expressions(POSTED), f"'{stamp}' AS collected_at", f"map('min', {low}, 'currency', 'AUD') AS salary_range")
        return shaped.select(*(F.col(f.name) if f.name in shaped.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(POSTING)))

    again = orders.filter("o_orderkey % 3 = 0")
    later = "2001-02-01T00:00:00Z"
    return collection(orders, "2001-01-10T00:00:00Z", "'first'"), collection(again, later, "'a'").unionByName(collection(again, later, "'b'"))


def shown(postings):
    return postings.select("source_url", "company", "job_title", "collected_at", F.col("salary_range")["min"].alias("low"))


POSTED_SQL = (
    "SELECT 'https://x.example/' || o_orderkey AS source_url, CASE WHEN o_orderkey % 7 <> 0 THEN 'Company ' || o_custkey END AS company, o_orderpriority AS job_title, "
    "CASE WHEN o_orderkey % 3 = 0 THEN '2001-02-01T00:00:00Z' ELSE '2001-01-10T00:00:00Z' END AS collected_at, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'first' END AS low FROM orders"
)


@query(POSTED_SQL)
def posting_upsert(spark, folder):
    """The second collection over the first; its tie is settled by the salary map."""
    first, second = posting_drops(spark, folder)
    return shown(m.upsert(first, second, POSTED_KEYS, "collected_at"))


@query(POSTED_SQL)
def stream_postings(spark, folder):
    """The same collections as drops of the merge-on-read table, the second one landed twice."""
    first, second = posting_drops(spark, folder)
    merged = MergedTable(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", POSTED_KEYS, "collected_at")
    for batch, drop in (("1", first), ("2", second), ("2", second)):
        merged.append(drop, batch)
    return shown(merged.read())


@query(
    "SELECT sha256('https://x.example/' || o_orderkey) AS job_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'id-' || o_custkey END AS company_id, o_orderpriority AS title, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Perth' END AS job_location, 'Résumé – text of ' || o_orderkey AS raw_description, '2001-01-0' || (1 + o_orderkey % 9) AS posted_date, "
    "CASE WHEN o_orderkey % 3 = 0 THEN '2001-02-01' ELSE '2001-01-10' END AS scraped_date, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.6667 ELSE 0.5 END AS DOUBLE) AS extraction_confidence FROM orders"
)
def pipeline_silver(spark, folder):
    """Collected postings upserted, made silver rows, written and read back."""
    first, second = posting_drops(spark, folder)
    companies = table(spark, folder, "customer").selectExpr("'id-' || c_custkey AS company_id", "'Company ' || c_custkey AS name")
    root = f"{shared_folder(spark)}/silver-{uuid.uuid4().hex}"
    write_silver(m.silver_postings(m.upsert(first, second, POSTED_KEYS, "collected_at"), companies), "job_posting", root)
    silver = read_silver(spark, "job_posting", root)
    return silver.select(
        "job_id", "company_id", "title", "job_location", "raw_description", F.col("posted_date").cast("string").alias("posted_date"),
        F.col("scraped_date").cast("string").alias("scraped_date"), "extraction_confidence",
    )


@query(
    "SELECT category_id, main_type, sub_type, jobs FROM (SELECT sha256('2~' || o_orderpriority || '~' || o_orderstatus) AS category_id, o_orderpriority AS main_type, "
    "o_orderstatus AS sub_type, count(DISTINCT o_orderkey) AS jobs FROM orders GROUP BY ALL)"
)
def silver_categories(spark, folder):
    """Category rows and their bridge joined again: no bridge row is an orphan."""
    labels = table(spark, folder, "orders").selectExpr("o_orderkey AS job_id", "o_orderpriority AS main_type", "o_orderstatus AS sub_type", "0.75D AS confidence_score")
    bridge = m.silver_job_categories(labels.union(labels), 2).groupBy("category_id").agg(F.count(F.lit(1)).alias("jobs"))
    return bridge.join(m.silver_categories(labels, 2), "category_id", "left").select("category_id", "main_type", "sub_type", "jobs")


@query(
    "SELECT sha256(lower(c_mktsegment)) AS skill_id, c_mktsegment AS skill_name, 'technical' AS skill_type, count(*) AS jobs FROM customer GROUP BY ALL"
)
def silver_skills(spark, folder):
    """Skill rows and their bridge, from names that differ in case and outer blanks."""
    jobs = table(spark, folder, "customer").selectExpr("c_custkey", "array(c_mktsegment, ' ' || lower(c_mktsegment), '') AS skills")
    names = jobs.selectExpr("explode(skills) AS skill_name")
    bridge = m.silver_job_skills(jobs, "c_custkey", "skills").groupBy("skill_id").agg(F.count(F.lit(1)).alias("jobs"))
    return bridge.join(m.silver_skills(names), "skill_id", "left").select("skill_id", "skill_name", "skill_type", "jobs")


@query(
    "SELECT sha256('id-' || s_suppkey || '~' || n_name || '~') AS location_id, 'id-' || s_suppkey AS company_id, n_name AS country, CAST(NULL AS VARCHAR) AS city, "
    "s_suppkey % 2 = 0 AS is_hq FROM supplier JOIN nation ON s_nationkey = n_nationkey"
)
def silver_locations(spark, folder):
    """Company places, given twice, kept once."""
    places = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey")).selectExpr(
        "'id-' || s_suppkey AS company_id", "n_name AS country", "CAST(NULL AS STRING) AS city", "s_suppkey % 2 = 0 AS is_hq"
    )
    return m.silver_locations(places.union(places.withColumn("is_hq", F.lit(False))))


@query(
    "SELECT sha256(o_custkey || '~2001-09-01~run-2') AS scrape_id, o_custkey AS company_id, '2001-09-01' AS scrape_date, 0 AS jobs_found, 'failed' AS status, "
    "min(o_orderpriority) AS error_message FROM orders GROUP BY o_custkey"
)
def failed_run_log(spark, folder):
    return m.failed_run_log(table(spark, folder, "orders"), "o_custkey", "o_orderpriority", F.lit("2001-09-01"), F.lit("run-2"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND date_diff('day', o_orderdate, TIMESTAMP '1998-06-01') > 400 THEN 'expired' "
    "WHEN o_orderstatus = 'F' THEN 'removed' WHEN date_diff('day', o_orderdate, TIMESTAMP '1998-06-01') > 60 THEN 'unavailable' ELSE 'active' END AS status FROM orders"
)
def status_ageing(spark, folder):
    """Postings not checked for long become unavailable; removed ones expire."""
    known = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 'removed' ELSE 'active' END AS status", "CAST(o_orderdate AS DATE) AS last_checked"
    )
    return m.expire(known, F.expr("DATE '1998-06-01'"), 60, 400).select("o_orderkey", "status")


@query(
    "WITH runs(scrape_id) AS (VALUES ('run-1'), ('run-2')) "
    "SELECT scrape_id, o_orderpriority AS category_id, count(DISTINCT o_orderkey) AS jobs, TRUE AS total FROM orders, runs GROUP BY ALL UNION ALL "
    "SELECT scrape_id, o_orderpriority, jobs, FALSE FROM (SELECT scrape_id, o_orderpriority, o_orderstatus, count(DISTINCT o_orderkey) AS jobs FROM orders, runs GROUP BY ALL)"
)
def gold_two_runs(spark, folder):
    """Two runs of one day, the first written twice: both stay, and totals are told from rows of a missing company."""
    labels = table(spark, folder, "orders")
    root = f"{shared_folder(spark)}/gold-{uuid.uuid4().hex}"
    for run in ("run-1", "run-2", "run-1"):
        snapshot = a.category_snapshot(labels, "o_orderpriority", "o_orderstatus", "o_orderkey", F.lit(run), F.expr("DATE '2001-09-01'"))
        write_trend_snapshot(snapshot, root)
    return read_trend_snapshots(spark, root).select("scrape_id", "category_id", F.col("job_count").alias("jobs"), F.col("is_total").alias("total"))


@query("SELECT event_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(min(ts) + (max(ts) - min(ts)) / 2 AS DATE) FROM events)")
def retention(spark, folder):
    """Raw partitions by day, those before the middle of the feed dropped."""
    events = table(spark, folder, "events")
    root = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    shaped = events.selectExpr("event_id", "event_type", "CAST(CAST(ts AS DATE) AS STRING) AS day")
    shaped.write.partitionBy("day").parquet(root)
    middle = events.selectExpr("CAST(CAST(min(ts) + (max(ts) - min(ts)) / 2 AS DATE) AS STRING) AS day").first()["day"]
    m.drop_old_partitions(spark, root, "day", middle)
    return spark.read.schema(shaped.schema).parquet(root)
