"""Demand counts, distributions and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import aggregates as a
from .registry import query, table

SKILLS_SQL = "(SELECT DISTINCT l_orderkey, skill FROM lineitem JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS skill FROM part) ON l_partkey = p_partkey)"


def posting_skills(spark, folder):
    """(posting, skill) pairs, repeated when several lines bring the skill."""
    words = table(spark, folder, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("skill"))
    return table(spark, folder, "lineitem").join(words, F.expr("l_partkey = p_partkey")).select("l_orderkey", "skill")


@query(f"SELECT skill, count(*) AS n_postings, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM {SKILLS_SQL} GROUP BY skill")
def skill_demand(spark, folder):
    total = table(spark, folder, "orders").agg(F.count(F.lit(1)).alias("n")).scalar()
    return a.skill_demand(posting_skills(spark, folder), "skill", "l_orderkey", total)


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_postings FROM lineitem GROUP BY 1")
def category_distribution(spark, folder):
    """Return flags as the several labels of an order: distinct postings under each."""
    return a.postings_per(table(spark, folder, "lineitem"), "l_returnflag", "l_orderkey")


LOCATED_SQL = "(SELECT o_orderkey, o_orderpriority AS category, nullif(c_mktsegment, 'BUILDING') AS company, n_name AS location, r_name AS region, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def located(spark, folder):
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    companies = table(spark, folder, "customer").join(places, F.expr("c_nationkey = n_nationkey"))
    return table(spark, folder, "orders").join(companies, F.expr("o_custkey = c_custkey")).selectExpr(
        "o_orderkey", "o_orderpriority AS category", "nullif(c_mktsegment, 'BUILDING') AS company",
        "n_name AS location", "r_name AS region", "o_orderdate",
    )


@query(
    "SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(company) = 0 THEN 'company' ELSE 'location' END AS dimension, "
    "CASE WHEN grouping(category) = 0 THEN category WHEN grouping(company) = 0 THEN company ELSE location END AS value, count(*) AS n "
    f"FROM {LOCATED_SQL} GROUP BY GROUPING SETS ((category), (company), (location))"
)
def demand_grouping_sets(spark, folder):
    return a.distributions(located(spark, folder), ["category", "company", "location"])


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query(
    "SELECT category, " + ", ".join(f"count(DISTINCT o_orderkey) FILTER (WHERE region = '{region}') AS \"{region}\"" for region in REGIONS)
    + f" FROM {LOCATED_SQL} GROUP BY category"
)
def skill_company_matrix(spark, folder):
    return a.comparison(located(spark, folder), "category", "region", "o_orderkey", REGIONS)


@query(f"SELECT skill, n_name AS location, count(DISTINCT l_orderkey) AS n_postings FROM {SKILLS_SQL} JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def skill_company_long(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("skills"))
    lines = table(spark, folder, "lineitem").join(parts, F.expr("l_partkey = p_partkey")).select("l_orderkey", "skills")
    places = located(spark, folder).select(F.col("o_orderkey").alias("l_orderkey"), "location")
    return a.listed_comparison(lines, "skills", "skill", places, "location", "l_orderkey")


@query(
    "SELECT sha256('run-1~' || category_id || '~' || CASE WHEN is_total THEN '*' ELSE coalesce(company_id, '') END) AS snapshot_id, * FROM ("
    "SELECT 'run-1' AS scrape_id, category AS category_id, company AS company_id, count(DISTINCT o_orderkey) AS job_count, "
    f"'2001-09-01' AS snapshot_date, grouping(company) = 1 AS is_total FROM {LOCATED_SQL} GROUP BY GROUPING SETS ((category, company), (category)))"
)
def trend_snapshot(spark, folder):
    return a.category_snapshot(
        located(spark, folder), "category", "company", "o_orderkey", F.lit("run-1"), F.lit("2001-09-01")
    )



@query(
    "SELECT o_custkey, CAST(CASE WHEN enough THEN CAST(period AS DATE) END AS VARCHAR) AS period, CASE WHEN enough THEN n END AS n, n_periods, "
    "CASE WHEN enough THEN 'trend' ELSE 'insufficient_data' END AS state, 'posting_date' AS date_basis FROM ("
    "SELECT *, n_periods >= 2 AS enough FROM (SELECT o_custkey, period, n, count(*) FILTER (WHERE n >= 5) OVER (PARTITION BY o_custkey) AS n_periods, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY period) AS r FROM (SELECT o_custkey, date_trunc('year', o_orderdate) AS period, count(*) AS n FROM orders GROUP BY ALL))) "
    "WHERE (enough AND n >= 5) OR (NOT enough AND r = 1)"
)
def trend_gated(spark, folder):
    """Yearly postings per company, shown only for companies with two years of five or more."""
    trend = a.gated_trend(table(spark, folder, "orders"), ["o_custkey"], "o_orderdate", "year", min_records=5)
    return trend.withColumn("period", F.col("period").cast("string"))


def growth_sql(group: str, source: str, period: str, least: int) -> str:
    """Counts over the calendar by generate_series, the change to the period before, and the evidence gate."""
    return (
        f"WITH counted AS (SELECT {group}, date_trunc('{period}', o_orderdate) AS period, count(*) AS n FROM {source} GROUP BY ALL), "
        f"spans AS (SELECT {group}, unnest(generate_series(min(period), (SELECT max(period) FROM counted), INTERVAL 1 {period})) AS period FROM counted GROUP BY {group}), "
        f"filled AS (SELECT spans.{group}, spans.period, coalesce(n, 0) AS n FROM spans LEFT JOIN counted ON spans.{group} = counted.{group} AND spans.period = counted.period), "
        f"w AS (SELECT *, lag(n) OVER (PARTITION BY {group} ORDER BY period) AS previous, count(*) FILTER (WHERE n >= {least}) OVER (PARTITION BY {group}) AS n_periods, "
        f"row_number() OVER (PARTITION BY {group} ORDER BY period) AS r FROM filled) "
        f"SELECT {group}, CASE WHEN n_periods >= 2 THEN CAST(CAST(period AS DATE) AS VARCHAR) END AS period, CASE WHEN n_periods >= 2 THEN n END AS n, "
        "CASE WHEN n_periods >= 2 THEN previous END AS previous, CASE WHEN n_periods >= 2 AND previous > 0 THEN round((n - previous) / previous, 6) END AS change, "
        "CASE WHEN n_periods < 2 THEN NULL WHEN n > previous THEN 'up' WHEN n < previous THEN 'down' WHEN n = previous THEN 'flat' END AS direction, n_periods, "
        "CASE WHEN n_periods >= 2 THEN 'trend' ELSE 'insufficient_data' END AS state FROM w WHERE n_periods >= 2 OR r = 1"
    )


@query(growth_sql("o_orderpriority", "orders", "month", 10))
def trend_growth(spark, folder):
    trend = a.growth(table(spark, folder, "orders"), ["o_orderpriority"], "o_orderdate", "month")
    return trend.withColumn("period", F.col("period").cast("string"))


@query(growth_sql("o_custkey", "(SELECT * FROM orders WHERE o_custkey % 7 <> 0 OR year(o_orderdate) <> 1996)", "year", 3))
def trend_growth_calendar(spark, folder):
    """Yearly change per company, many with years without a posting and many with too little evidence."""
    orders = table(spark, folder, "orders").filter("o_custkey % 7 <> 0 OR year(o_orderdate) <> 1996")
    trend = a.growth(orders, ["o_custkey"], "o_orderdate", "year", min_records=3)
    return trend.withColumn("period", F.col("period").cast("string"))


@query("SELECT o_orderstatus AS currency, o_orderpriority AS pay_period, CAST(floor(o_totalprice / 50000) * 50000 AS BIGINT) AS band, count(*) AS n FROM orders GROUP BY ALL")
def salary_bands(spark, folder):
    priced = table(spark, folder, "orders").selectExpr("o_totalprice", "o_orderstatus AS currency", "o_orderpriority AS pay_period")
    return a.salary_bands(priced, "o_totalprice", ["currency", "pay_period"])


@query("SELECT nullif(event_type, 'view') AS event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, folder):
    return a.value_counts(table(spark, folder, "events").selectExpr("nullif(event_type, 'view') AS event_type"), "event_type")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS relevant, count(*) FILTER (WHERE o_totalprice > 100000) AS with_salary FROM orders")
def posting_counts(spark, folder):
    return a.counts(table(spark, folder, "orders"), relevant=F.expr("o_orderstatus = 'O'"), with_salary=F.expr("o_totalprice > 100000"))


@query("SELECT count(DISTINCT o_custkey) AS distinct_o_custkey, count(DISTINCT o_orderdate) AS distinct_o_orderdate, count(DISTINCT o_orderpriority) AS distinct_o_orderpriority FROM orders")
def distinct_summary(spark, folder):
    return a.distinct_counts(table(spark, folder, "orders"), ["o_custkey", "o_orderdate", "o_orderpriority"])


@query(
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS scrape_date, count(*) AS runs, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, "
    "round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 6) AS success_rate FROM events GROUP BY 1"
)
def run_rates(spark, folder):
    log = table(spark, folder, "events").selectExpr(
        "CAST(CAST(ts AS DATE) AS STRING) AS scrape_date", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status"
    )
    return a.run_rates(log, ["scrape_date"])
