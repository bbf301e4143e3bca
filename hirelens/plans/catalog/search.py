"""Search, facets, order and paging, and the company register."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import companies as c
from ...operators import search as s
from .quality import split_expressions
from .registry import query, table

JOBS = "p_partkey, p_name AS title, p_brand AS company, p_type AS category, CASE WHEN p_size > 25 THEN 'Full-time' ELSE 'Contract' END AS type"


def jobs(spark, folder):
    return table(spark, folder, "part").selectExpr(*split_expressions(JOBS))


@query(
    f"SELECT * FROM (SELECT {JOBS} FROM part) WHERE category = 'PROMO' AND (contains(lower(title), 'ring') OR contains(lower(company), 'ring') OR contains(lower(category), 'ring') OR contains(lower(type), 'ring'))"
)
def keyword_search(spark, folder):
    return s.search_postings(jobs(spark, folder), "  Ring ", "PROMO", ["title", "company", "category", "type"], "category")


@query(f"SELECT * FROM (SELECT {JOBS} FROM part) WHERE contains(lower(company), '#2') OR contains(lower(type), '#2') OR contains(lower(title), '#2')")
def keyword_search_all(spark, folder):
    return s.search_postings(jobs(spark, folder), "#2", "All", ["title", "company", "type"], "category")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '#00000001') AND c_mktsegment = 'MACHINERY'")
def company_search(spark, folder):
    found = c.search_companies(table(spark, folder, "customer"), "#00000001", "MACHINERY", "c_name", "c_mktsegment")
    return found.select("c_custkey", "c_name", "c_mktsegment")


@query(
    "SELECT p_partkey, p_type, p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size > 25 AND list_contains(string_split(p_name, ' '), 'bolt') AND contains(lower(p_name), 're')"
)
def faceted_search(spark, folder):
    rows = table(spark, folder, "part").selectExpr("p_partkey", "p_type", "p_brand", "p_size > 25 AS large", "p_name", "split(p_name, ' ') AS skills")
    found = s.facets(rows, {"p_type": "ECONOMY", "large": True}, ["bolt"], keyword="RE", keyword_columns=["p_name"])
    return found.select("p_partkey", "p_type", "p_brand")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name LIMIT 12 OFFSET 24")
def paged_companies(spark, folder):
    found = c.search_companies(table(spark, folder, "customer"), "", "BUILDING", "c_name", "c_mktsegment")
    return s.page(found.select("c_custkey", "c_name"), ["c_name"], 3)


@query(
    "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 7 OFFSET (SELECT CAST((ceil(count(*) / 7.0) - 1) * 7 AS BIGINT) FROM customer)"
)
def last_page_companies(spark, folder):
    """A page number beyond the end, clamped; only the rows about the page are sorted."""
    rows = table(spark, folder, "customer").select("c_custkey", "c_name")
    return s.page(rows, ["c_name"], 10**6, 7.9)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET (SELECT CAST(floor(ceil(count(*) / 50.0) / 2) * 50 AS BIGINT) FROM orders)")
def middle_page_postings(spark, folder):
    """A page in the middle of all postings, dearest first."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    middle = -(-rows.count() // 50) // 2 + 1
    return s.page(rows, ["-o_totalprice", "o_orderkey"], middle, 50)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def ranked_postings(spark, folder):
    """A global order number for every posting, without one task seeing them all."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return s.with_global_place(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], "place")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 3")
def sample_selection(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return s.sample_or_any(rows, F.expr("o_orderpriority = '1-URGENT'"), ["o_orderkey"], 3)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 3")
def sample_with_fallback(spark, folder):
    """No row has the wanted priority, so the first of all are taken."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return s.sample_or_any(rows, F.expr("o_orderpriority = '9-NONE'"), ["o_orderkey"], 3)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def newest_first(spark, folder):
    return s.head(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), s.newest_first("o_orderdate", "o_orderkey"), 20)


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def newest_batch(spark, folder):
    """The newest hundred of a feed."""
    return s.head(table(spark, folder, "events").select("event_id", "ts", "user_id"), s.newest_first("ts", "event_id"), 100)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_name")
def company_order(spark, folder):
    return c.by_name(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_name")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def company_lookup(spark, folder):
    return c.company_postings(table(spark, folder, "customer"), "c_custkey", 42).select("c_custkey", "c_name", "c_mktsegment")


EXISTING = "c_name AS name, 'https://' || c_custkey || '.example' AS website_url, 'https://jobs.example/' || (c_custkey * 3) AS career_page_url"
OFFERED = (
    "o_orderkey, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN ' Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR(12)), 9, '0') || ' ' WHEN 1 THEN '  ' ELSE 'New ' || o_custkey END AS name, "
    "'https://' || (o_orderkey * 7) || '.example' AS website_url, 'https://jobs.example/' || (o_orderkey * 2 + 1) AS career_page_url, "
    "o_orderpriority AS company_type, o_orderstatus AS data_source_status"
)


@query(
    f"WITH e AS (SELECT {EXISTING} FROM customer), o AS (SELECT {OFFERED} FROM orders), t AS (SELECT *, trim(name) AS n FROM o), "
    "ok AS (SELECT * FROM t WHERE n <> '' AND n NOT IN (SELECT name FROM e) AND website_url NOT IN (SELECT website_url FROM e) "
    "AND career_page_url NOT IN (SELECT career_page_url FROM e)), fn AS (SELECT n, min(o_orderkey) AS k FROM ok GROUP BY 1), "
    "fw AS (SELECT website_url, min(o_orderkey) AS k FROM ok GROUP BY 1), fc AS (SELECT career_page_url, min(o_orderkey) AS k FROM ok GROUP BY 1) "
    "SELECT t.o_orderkey, n AS name, CASE WHEN n = '' THEN 'name must not be empty' "
    "WHEN n IN (SELECT name FROM e) OR fn.k < t.o_orderkey THEN 'company already exists with name' "
    "WHEN t.website_url IN (SELECT website_url FROM e) OR fw.k < t.o_orderkey THEN 'company already exists with website_url' "
    "WHEN t.career_page_url IN (SELECT career_page_url FROM e) OR fc.k < t.o_orderkey THEN 'company already exists with career_page_url' END AS reject_reason "
    "FROM t LEFT JOIN fn USING (n) LEFT JOIN fw ON t.website_url = fw.website_url LEFT JOIN fc ON t.career_page_url = fc.career_page_url"
)
def new_company_check(spark, folder):
    existing = table(spark, folder, "customer").selectExpr(*split_expressions(EXISTING))
    offered = table(spark, folder, "orders").selectExpr(*split_expressions(OFFERED))
    return c.check_new_companies(offered, existing, "o_orderkey").select("o_orderkey", "name", "reject_reason")
