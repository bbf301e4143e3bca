"""Batch checks, evaluation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...fixed_values import PLATFORM_HOSTS
from ...operators import quality as q
from ...sources.landed import source_platform
from .registry import query, table

DOC_FIELDS = (
    "doc_id, nullif(source, 'src3') AS company, CASE WHEN n_chars < 200 THEN '' ELSE text END AS description, "
    "CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS language"
)


@query(
    "SELECT doc_id, array_to_string(list_filter([CASE WHEN company IS NULL THEN 'company' END, "
    "CASE WHEN description = '' THEN 'description' END, CASE WHEN language IS NULL THEN 'language' END], lambda x: x IS NOT NULL), ',') AS missing "
    f"FROM (SELECT {DOC_FIELDS.replace('src3', 'web3')} FROM documents)"
)
def required_fields(spark, folder):
    """Missing fields of every document, good rows with none."""
    rows = table(spark, folder, "documents").selectExpr(*split_expressions(DOC_FIELDS.replace("src3", "web3")))
    missing = q.missing_fields(rows, ["company", "description", "language"])
    return rows.select("doc_id", F.array_join(missing, ",").alias("missing"))


def split_expressions(expressions: str) -> list[str]:
    """Top-level comma split of a select list."""
    parts, depth, start = [], 0, 0
    for place, mark in enumerate(expressions):
        depth += (mark == "(") - (mark == ")")
        if mark == "," and depth == 0:
            parts.append(expressions[start:place])
            start = place + 1
    return [*parts, expressions[start:]]


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, folder):
    return q.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicates FROM lineitem"
)
def surplus_rows(spark, folder):
    return q.surplus_rows(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "SELECT unnest(['total_jobs', 'unique_job_ids', 'jobs_with_descriptions', 'jobs_with_posting_dates', 'distinct_locations', 'distinct_teams']) AS measure, "
    "unnest([count(*), count(DISTINCT l_orderkey), count(*) FILTER (WHERE l_returnflag <> 'N' OR l_returnflag IS NULL), "
    "count(nullif(l_linestatus, 'O')), count(DISTINCT l_suppkey), count(DISTINCT l_shipdate)]) AS value FROM lineitem"
)
def quality_summary(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_suppkey", "l_shipdate", "CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS description",
        "nullif(l_linestatus, 'O') AS posting_date",
    )
    return q.quality_summary(lines, "l_orderkey", "description", "posting_date", "l_suppkey", "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def orphan_check(spark, folder):
    """Lines whose part is not among the small ones on offer."""
    offered = table(spark, folder, "part").filter("p_size <= 25")
    return q.orphans(table(spark, folder, "lineitem"), "l_partkey", offered, "p_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def enum_check(spark, folder):
    return q.outside_domain(table(spark, folder, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def orphan_cascade(spark, folder):
    """Orders that stay when customers in debt are deleted."""
    deleted = table(spark, folder, "customer").filter("c_acctbal < 0")
    return q.cascade_delete(table(spark, folder, "orders"), "o_custkey", deleted, "c_custkey").select("o_orderkey", "o_custkey")


GUESS = "CAST(contains(lower(text), 'stupid') OR contains(lower(text), 'worthless') AS INT)"
LABELLED_SQL = f"(SELECT toxic AS truth, {GUESS} AS guess FROM labels JOIN documents USING (doc_id))"


def labelled(spark, folder):
    guesses = table(spark, folder, "documents").selectExpr("doc_id", f"{GUESS} AS guess")
    return table(spark, folder, "labels").selectExpr("doc_id", "toxic AS truth").join(guesses, "doc_id")


@query(f"SELECT truth, guess, count(*) AS n FROM {LABELLED_SQL} GROUP BY 1, 2")
def classifier_confusion(spark, folder):
    return q.confusion_counts(labelled(spark, folder), "truth", "guess")


@query(
    "SELECT *, round((true_positive + true_negative) / n, 6) AS accuracy, "
    "round(true_positive / nullif(true_positive + false_positive, 0), 6) AS precision, "
    "round(true_positive / nullif(true_positive + false_negative, 0), 6) AS recall FROM ("
    "SELECT count(*) AS n, count(*) FILTER (WHERE truth = 1 AND guess = 1) AS true_positive, "
    "count(*) FILTER (WHERE truth = 0 AND guess = 1) AS false_positive, "
    "count(*) FILTER (WHERE truth = 1 AND guess = 0) AS false_negative, "
    f"count(*) FILTER (WHERE truth = 0 AND guess = 0) AS true_negative FROM {LABELLED_SQL})"
)
def classifier_eval(spark, folder):
    return q.binary_scores(labelled(spark, folder), "truth", "guess")


COLLECTED = (
    "o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status, "
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_custkey AS company"
)
ACCURACY_ROW = (
    "SELECT '{f}' AS field, count(*) AS n, count(*) FILTER (WHERE c.o_orderkey IS NOT NULL AND t.{f} IS NOT DISTINCT FROM c.{f}) AS n_correct, "
    "count(c.o_orderkey) AS n_found FROM t LEFT JOIN c USING (o_orderkey)"
)


@query(
    f"WITH t AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS company FROM orders), "
    f"c AS (SELECT {COLLECTED} FROM orders WHERE o_totalprice > 20000) "
    "SELECT field, n, n_correct, round(n_correct / n, 4) AS accuracy, round(n_found / n, 4) AS collected_share, "
    "(n >= 20 AND n_correct / n >= 0.9 AND n_found / n >= 0.9) AS accepted FROM ("
    + " UNION ALL ".join(ACCURACY_ROW.format(f=field) for field in ("status", "priority", "company")) + ")"
)
def field_accuracy(spark, folder):
    """A collection that missed cheap orders and garbled some fields, against the truth."""
    orders = table(spark, folder, "orders")
    truth = orders.selectExpr("o_orderkey", "o_orderstatus AS status", "o_orderpriority AS priority", "o_custkey AS company")
    collected = orders.filter("o_totalprice > 20000").selectExpr(*split_expressions(COLLECTED))
    return q.field_accuracy(truth, collected, "o_orderkey", ["status", "priority", "company"])


# A register of suppliers, and a log in which a day's events of a user are one run of that source.
REGISTER = (
    "s_suppkey AS source_id, s_name AS name, CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'excluded' WHEN 1 THEN '' ELSE 'confirmed' END AS source_status, "
    "CASE WHEN s_suppkey % 10 = 0 THEN 'no public board' END AS exclusion_reason, "
    "CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'https://boards-api.greenhouse.io/v1/boards/x' WHEN 1 THEN 'https://API.lever.co/v0/postings/y' "
    "WHEN 2 THEN 'https://www.example.com/careers' ELSE '' END AS endpoint"
)
LOG = (
    "user_id AS source_id, CAST(event_id AS VARCHAR(20)) AS scrape_id, CAST(ts AS DATE) AS scrape_date, "
    "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, "
    "CASE WHEN event_type = 'error' THEN props END AS error_message"
)


@query(
    f"WITH r AS (SELECT {REGISTER} FROM supplier), l AS (SELECT {LOG} FROM events), "
    "m AS (SELECT source_id, max(scrape_date) AS last_attempt, count(*) AS attempts, "
    "max_by(status, strftime(scrape_date, '%Y%m%d') || '|' || scrape_id) AS last_status, "
    "list(error_message ORDER BY scrape_date DESC, scrape_id DESC)[1] AS last_error FROM l GROUP BY 1) "
    "SELECT r.*, CASE WHEN contains(lower(endpoint), 'greenhouse.io') THEN 'Greenhouse' WHEN contains(lower(endpoint), 'lever.co') THEN 'Lever' "
    "WHEN endpoint = '' THEN NULL ELSE 'Custom site' END AS platform, CAST(last_attempt AS VARCHAR) AS last_attempt, last_status, last_error, coalesce(attempts, 0) AS attempts, "
    "CASE WHEN source_status = '' THEN 'no status' WHEN source_status = 'excluded' AND exclusion_reason IS NULL THEN 'no exclusion reason' "
    "WHEN source_status <> 'excluded' AND last_attempt IS NULL THEN 'never attempted' END AS gap FROM r LEFT JOIN m USING (source_id)"
)
def source_register(spark, folder):
    """Register coverage: status, platform, last attempt and open gaps."""
    register = table(spark, folder, "supplier").selectExpr(*split_expressions(REGISTER)).withColumn(
        "platform", source_platform("endpoint", PLATFORM_HOSTS)
    )
    log = table(spark, folder, "events").selectExpr(*split_expressions(LOG))
    covered = q.source_coverage(register, log, "source_id")
    return covered.withColumn("last_attempt", F.col("last_attempt").cast("string"))


@query(
    "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS no_source_url, "
    "count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS no_collected, "
    "count(*) FILTER (WHERE o_orderstatus = 'P') AS no_platform, "
    "count(*) FILTER (WHERE o_orderkey % 9 <> 0 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus <> 'P') AS traceable "
    "FROM orders GROUP BY 1"
)
def trace_audit(spark, folder):
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderpriority", "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'https://x.example/' || o_orderkey END AS source_url",
        "CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN o_orderdate END AS collected_at", "nullif(o_orderstatus, 'P') AS ats",
    )
    return q.trace_audit(
        rows, "o_orderpriority", {"source_url": "source_url", "collected": "collected_at", "platform": "ats"}
    )
