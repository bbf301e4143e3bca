"""Report joins, facets and similar postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import companies, joins
from .. import reports
from .registry import query, table
from .salary import POSTINGS_SQL, postings, range_sql


@query(
    "SELECT t.*, location, salary_min, salary_max, salary_currency, salary_period, salary_snippet, "
    "CASE WHEN salary_min IS NOT NULL THEN 'job_post' END AS salary_source FROM "
    "(SELECT o_orderkey AS job_id, o_orderpriority AS title, o_orderstatus AS functional_area FROM orders WHERE o_orderstatus <> 'P') t "
    "LEFT JOIN (" + range_sql(POSTINGS_SQL, "job_id, location", "research") + ") s USING (job_id)"
)
def taxonomy_salary_join(spark, folder):
    classified = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey AS job_id", "o_orderpriority AS title", "o_orderstatus AS functional_area"
    )
    return reports.classification_report(postings(spark, folder), classified, "research")


@query(
    "SELECT a.l_orderkey, a.l_suppkey, a.n AS n_taxonomy, b.n AS n_salary, b.quantity FROM "
    "(SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) a LEFT JOIN "
    "(SELECT l_orderkey, l_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b "
    "USING (l_orderkey, l_suppkey)"
)
def composite_left_join(spark, folder):
    lines = table(spark, folder, "lineitem")
    keys = ["l_orderkey", "l_suppkey"]
    taxonomy = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    returned = lines.filter("l_returnflag = 'R'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )
    return joins.suffixed_left_join(taxonomy, returned, keys, ("_taxonomy", "_salary"))


@query(
    "WITH top AS (SELECT o_orderpriority, o_orderkey AS other, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders QUALIFY r <= 4) "
    "SELECT o.o_orderkey, CAST(row_number() OVER (PARTITION BY o.o_orderkey ORDER BY r) AS INT) AS similar_rank, other AS similar_o_orderkey "
    "FROM orders o JOIN top USING (o_orderpriority) WHERE other <> o.o_orderkey QUALIFY similar_rank <= 3"
)
def similar_jobs(spark, folder):
    return joins.similar_postings(table(spark, folder, "orders"), "o_orderkey", "o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 77")
def company_jobs(spark, folder):
    return companies.company_postings(table(spark, folder, "orders"), "o_custkey", 77).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def job_company(spark, folder):
    """Company card of every posting; a company that is not known leaves nulls."""
    known = table(spark, folder, "customer").filter("c_acctbal > 0").selectExpr("c_custkey AS o_custkey", "c_name", "c_mktsegment")
    jobs = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return joins.with_company(jobs, known, "o_custkey").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS open_positions FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = o_custkey")
def open_positions(spark, folder):
    vacant = table(spark, folder, "orders").filter("o_orderstatus = 'O'").selectExpr("o_custkey AS c_custkey")
    return companies.open_positions(table(spark, folder, "customer").select("c_custkey", "c_name"), vacant, "c_custkey")


@query(
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN "
    "(SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE list_contains(string_split(p_name, ' '), 'gear'))"
)
def skill_facet(spark, folder):
    """Closed postings asking for a skill, through the posting-skill bridge."""
    parts = table(spark, folder, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("skill"))
    asked = parts.filter("skill = 'gear'").select("p_partkey")
    bridge = table(spark, folder, "lineitem").join(asked, F.expr("l_partkey = p_partkey")).selectExpr(
        "l_orderkey AS o_orderkey", "'gear' AS skill"
    )
    closed = table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    return joins.with_any_of(closed, bridge, "o_orderkey", F.lit(True)).select("o_orderkey", "o_orderpriority")


DOMAIN_PAIRS = "(VALUES ('AUTOMOBILE', 'OEM'), ('MACHINERY', 'Tier 1 Supplier'), ('BUILDING', 'AV Startup'))"


@query(
    f"SELECT c_custkey, c_mktsegment, coalesce(canonical, c_mktsegment) AS company_type FROM customer LEFT JOIN {DOMAIN_PAIRS} m(original, canonical) ON lower(c_mktsegment) = lower(original)"
)
def domain_map(spark, folder):
    pairs = spark.sql(f"SELECT * FROM {DOMAIN_PAIRS} AS m(original, canonical)")
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return joins.mapped_values(rows, "c_mktsegment", pairs, "company_type")
