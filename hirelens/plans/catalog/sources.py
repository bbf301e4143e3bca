"""Source normalisers over payload-shaped rows built from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ...session import shared_folder
from ...sources import adapters, greenhouse, landed, lever, smartrecruiters
from ...sources.adapters import union_sources
from ...sources.sinks import write_records, write_results
from ...sources.variants import odd_items, variant_documents
from ..collection import collect_run
from .quality import split_expressions
from .registry import query, table

STAMP = "2026-08-11T01:00:00Z"
LISTS = ("all_locations", "offices")


def flat(postings: DataFrame) -> DataFrame:
    """Arrays as text and no map column, so that both engines show the same cells."""
    lists = [name for name in LISTS if name in postings.columns]
    return postings.withColumns({name: F.array_join(name, ";") for name in lists}).drop("salary_range")


JOINED_SQL = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def joined(spark, folder):
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    companies = table(spark, folder, "customer").join(places, F.expr("c_nationkey = n_nationkey"))
    return table(spark, folder, "orders", costly=True).join(companies, F.expr("o_custkey = c_custkey"))


LEVER_SHAPE = (
    "CAST(o_orderkey AS STRING) AS id, '  ' || o_orderpriority || '\t &amp; more ' AS text, unix_date(CAST(o_orderdate AS DATE)) * 86400000L + 500 AS createdAt, "
    "nullif(r_name, 'ASIA') AS country, CASE WHEN o_orderkey % 2 = 0 THEN 'hybrid' ELSE 'on-site' END AS workplaceType, "
    "CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE named_struct('location', CASE WHEN o_orderkey % 3 = 0 THEN n_name ELSE ' ' END, "
    "'allLocations', CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE array(n_name, '', ' ' || r_name || ' ', NULL) END, "
    "'team', c_mktsegment, 'department', CAST(NULL AS STRING), 'commitment', o_orderstatus) END AS categories, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Plain' || '\r\n\r\n' || ' text  for ' || c_name END AS descriptionPlain, "
    "'<div>Rich <b>text</b> for<br>' || c_name || '</div>' AS description, "
    "'https://jobs.example/' || o_orderkey AS hostedUrl, 'https://jobs.example/' || o_orderkey || '/apply' AS applyUrl, "
    "CAST(NULL AS MAP<STRING, STRING>) AS salaryRange"
)


@query(
    "SELECT 'Acme' AS company, CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority || ' & more' AS job_title, "
    "CASE WHEN o_orderkey % 10 = 9 THEN '' WHEN o_orderkey % 3 = 0 THEN n_name WHEN o_orderkey % 4 = 0 THEN '' ELSE n_name || ', ' || r_name END AS location, "
    "CASE WHEN o_orderkey % 10 = 9 OR o_orderkey % 4 = 0 THEN '' ELSE n_name || ';' || r_name END AS all_locations, "
    "CASE WHEN r_name = 'ASIA' THEN '' ELSE r_name END AS country_code, CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE c_mktsegment END AS team, '' AS department, "
    "CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE o_orderstatus END AS commitment, CASE WHEN o_orderkey % 2 = 0 THEN 'hybrid' ELSE 'on-site' END AS workplace_type, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Plain' || chr(10) || 'text for ' || c_name ELSE 'Rich text for' || chr(10) || c_name END AS description, "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS posting_date, 'https://jobs.example/' || o_orderkey AS source_url, "
    "'https://jobs.example/' || o_orderkey || '/apply' AS apply_url, 'API' AS collection_method, 'Lever' AS ats, '2026-08-11T01:00:00Z' AS collected_at "
    f"FROM {JOINED_SQL}"
)
def normalise_lever(spark, folder):
    raw = joined(spark, folder).selectExpr(*split_expressions(LEVER_SHAPE))
    return flat(lever.normalise(raw, "Acme", STAMP))


GREENHOUSE_JOB = (
    "named_struct('id', CAST(o_orderkey AS STRING), 'title', o_orderpriority, "
    "'first_published', date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") || '-04:00', 'updated_at', ' now ', "
    "'absolute_url', 'https://jobs.example/' || o_orderkey, "
    "'content', '&lt;p&gt;Build &lt;strong&gt;' || c_name || '&lt;/strong&gt; parts.&lt;/p&gt;', 'language', 'en', "
    "'requisition_id', CAST(NULL AS STRING), 'application_deadline', '', 'internal_job_id', CAST(o_orderkey * 2 AS STRING), "
    "'location', CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE named_struct('name', n_name || CASE WHEN o_orderkey % 3 = 0 THEN ' or Remote' ELSE '' END) END, "
    "'departments', array(named_struct('name', c_mktsegment), named_struct('name', ' '), named_struct('name', c_mktsegment || ' '), named_struct('name', 'R&amp;D')), "
    "'offices', CASE WHEN o_orderkey % 7 = 0 THEN array(named_struct('name', 'Hybrid ' || r_name)) END)"
)
GREENHOUSE_SQL = (
    "SELECT 'Acme' AS company, CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority AS job_title, place AS location, place AS all_locations, '' AS country_code, "
    "c_mktsegment AS team, c_mktsegment || ', R&D' AS department, '' AS commitment, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'hybrid' WHEN contains(place, 'Remote') THEN 'remote' ELSE 'onsite' END AS workplace_type, "
    "'Build ' || c_name || ' parts.' AS description, strftime(o_orderdate + INTERVAL 4 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS posting_date, "
    "'https://jobs.example/' || o_orderkey AS source_url, 'https://jobs.example/' || o_orderkey AS apply_url, 'API' AS collection_method, 'Greenhouse' AS ats, "
    "'2026-08-11T01:00:00Z' AS collected_at, 'en' AS language, '' AS job_reference, CAST(o_orderkey * 2 AS VARCHAR) AS internal_job_id, 'now' AS updated_at, "
    "'' AS application_deadline, CASE WHEN o_orderkey % 7 = 0 THEN 'Hybrid ' || r_name ELSE '' END AS offices FROM "
    f"(SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE n_name || CASE WHEN o_orderkey % 3 = 0 THEN ' or Remote' ELSE '' END END AS place FROM {JOINED_SQL})"
)


def board_envelopes(spark, folder):
    """Landed envelopes of at most fifty jobs with neighbouring ids; some totals are off by one."""
    jobs = joined(spark, folder).selectExpr("o_orderkey - o_orderkey % 50 AS board", f"{GREENHOUSE_JOB} AS job")
    # The work on a job is large for its bytes: a number of partitions that is asked for is not merged into a few large ones.
    jobs = jobs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "board")
    return jobs.groupBy("board").agg(F.collect_list("job").alias("jobs")).selectExpr(
        "board", "jobs",
        "named_struct('total', CAST(size(jobs) + CASE WHEN board % 500 = 0 THEN 1 ELSE 0 END AS BIGINT)) AS meta",
    )


@query(GREENHOUSE_SQL)
def normalise_greenhouse(spark, folder):
    """Envelopes exploded and normalised through the adapter registry."""
    return flat(adapters.normalise_landed(board_envelopes(spark, folder), greenhouse.ATS, "Acme", STAMP))


@query(
    "SELECT count(*) AS envelopes, CAST(sum(held) AS BIGINT) AS jobs FROM (SELECT o_orderkey - o_orderkey % 50 AS board, count(*) AS held "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) WHERE board % 500 = 0"
)
def declared_totals(spark, folder):
    """Envelopes whose declared total is not what they hold."""
    wrong = greenhouse.wrong_totals(board_envelopes(spark, folder))
    return wrong.agg(F.count(F.lit(1)).alias("envelopes"), F.sum("held").cast("bigint").alias("jobs"))


SMART_SHAPE = (
    "CAST(o_orderkey AS STRING) AS id, o_orderpriority AS name, date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") || '.000Z' AS releasedDate, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'https://jobs.example/' || o_orderkey END AS postingUrl, 'https://apply.example/' || o_orderkey || '?oga=true' AS applyUrl, "
    "'REF' || o_orderkey AS refNumber, named_struct('fullLocation', CASE WHEN o_orderkey % 3 = 0 THEN n_name || ', ' || r_name END, 'city', n_name, 'region', '', "
    "'country', lower(r_name), 'hybrid', o_orderkey % 4 = 0, 'remote', CASE WHEN o_orderkey % 5 = 0 THEN TRUE END) AS location, "
    "named_struct('label', c_mktsegment) AS function, CAST(NULL AS STRUCT<label: STRING>) AS department, named_struct('label', 'Full-time') AS typeOfEmployment, "
    "named_struct('label', 'Associate') AS experienceLevel, named_struct('label', ' ') AS industry, named_struct('code', 'en') AS language, "
    "named_struct('sections', named_struct('companyDescription', named_struct('title', 'Company', 'text', '<p>About ' || c_name || '</p>'), "
    "'jobDescription', named_struct('title', CAST(NULL AS STRING), 'text', 'Build &amp; test'), 'qualifications', named_struct('title', 'Empty', 'text', ' '), "
    "'additionalInformation', CAST(NULL AS STRUCT<title: STRING, text: STRING>))) AS jobAd"
)
SMART_SQL = (
    "SELECT 'Acme' AS company, CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority AS job_title, place AS location, place AS all_locations, lower(r_name) AS country_code, "
    "c_mktsegment AS team, '' AS department, 'Full-time' AS commitment, CASE WHEN o_orderkey % 4 = 0 THEN 'hybrid' WHEN o_orderkey % 5 = 0 THEN 'remote' ELSE 'onsite' END AS workplace_type, "
    "'Company' || chr(10) || 'About ' || c_name || chr(10) || chr(10) || 'Build & test' AS description, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS posting_date, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'https://jobs.example/' || o_orderkey ELSE 'https://apply.example/' || o_orderkey END AS source_url, "
    "'https://apply.example/' || o_orderkey || '?oga=true' AS apply_url, 'API' AS collection_method, 'SmartRecruiters' AS ats, '2026-08-11T01:00:00Z' AS collected_at, "
    "'en' AS language, 'REF' || o_orderkey AS job_reference, c_mktsegment AS function, 'Associate' AS experience_level, '' AS industry FROM "
    f"(SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN n_name || ', ' || r_name ELSE n_name || ', ' || lower(r_name) END AS place FROM {JOINED_SQL})"
)


@query(SMART_SQL)
def normalise_smartrecruiters(spark, folder):
    raw = joined(spark, folder).selectExpr(*split_expressions(SMART_SHAPE))
    return flat(smartrecruiters.normalise(raw, "Acme", STAMP))


def event_pages(spark, folder, size: int = 100):
    """The event feed as landed summary pages of a hundred, with the stated total."""
    events = table(spark, folder, "events")
    total = events.agg((F.max("event_id") + 1 - 250).alias("n")).scalar()
    pages = events.groupBy(F.expr(f"event_id - event_id % {size}").alias("offset")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("place"), F.col("event_type").alias("id")))).alias("content")
    )
    return pages.withColumn("totalFound", total)


@query(
    "SELECT event_id AS ordinal, event_type AS id FROM events WHERE event_id < (SELECT CAST(ceil((max(event_id) + 1 - 250) / 100.0) * 100 AS BIGINT) FROM events)"
)
def source_pages(spark, folder):
    """Summaries up to the page that reaches the stated total, in page order."""
    return smartrecruiters.page_summaries(event_pages(spark, folder))


@query("SELECT event_id AS ordinal, event_type AS id FROM events ORDER BY event_id LIMIT 137")
def source_pages_cut(spark, folder):
    """The same pages, cut inside the second one."""
    return smartrecruiters.page_summaries(event_pages(spark, folder), 137)


@query(
    "SELECT event_id AS ordinal, CAST(user_id AS VARCHAR) AS id FROM events WHERE user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)"
)
def details_missing(spark, folder):
    """Summaries whose detail did not land; ids differ in outer blanks and details repeat."""
    summaries = table(spark, folder, "events").selectExpr("event_id AS ordinal", "CAST(user_id AS STRING) AS id")
    details = table(spark, folder, "orders").filter("o_orderkey % 3 <> 0").selectExpr("concat(' ', o_orderkey, ' ') AS id")
    return smartrecruiters.missing_details(summaries, details.union(details))


@query(
    "SELECT event_id AS ordinal, o_orderkey, o_orderpriority FROM events JOIN orders ON o_orderkey = user_id"
)
def details_in_order(spark, folder):
    """The detail of every summary, carrying the summary order."""
    summaries = table(spark, folder, "events").selectExpr("event_id AS ordinal", "CAST(user_id AS STRING) AS id")
    details = table(spark, folder, "orders").selectExpr("CAST(o_orderkey AS STRING) AS id", "o_orderkey", "o_orderpriority")
    return smartrecruiters.details_in_order(summaries, details).select("ordinal", "o_orderkey", "o_orderpriority")


@query(
    "SELECT s_name AS name, s_nationkey AS nation, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL "
    "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_name, c_nationkey, c_acctbal, NULL FROM customer"
)
def union_of_sources(spark, folder):
    """Three sources with differing columns; duplicates stay."""
    suppliers = table(spark, folder, "supplier").selectExpr("s_name AS name", "s_nationkey AS nation", "s_acctbal AS balance")
    customers = table(spark, folder, "customer").selectExpr("c_acctbal AS balance", "c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment")
    return union_sources(suppliers, customers, customers.drop("segment")).select("name", "nation", "balance", "segment")


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority AS job_title, CASE WHEN o_orderkey % 5 = 3 THEN '' ELSE 'Perth' END AS location, "
    "strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS posting_date, CASE WHEN o_orderkey % 5 <> 1 THEN '7' END AS low FROM orders WHERE o_orderkey % 5 <> 4"
)
def lever_odd_fields(spark, folder):
    """Landed postings, some with a text for an object, a list for an object or a text for a date, and items that are no
    objects: every posting stays, the odd field is blank."""
    path = f"{shared_folder(spark)}/lever-{uuid.uuid4().hex}"
    table(spark, folder, "orders").selectExpr(
        "CASE o_orderkey % 5 WHEN 4 THEN '17' ELSE concat('{\"id\": ', o_orderkey, ', \"text\": \"', o_orderpriority, '\", \"createdAt\": ', "
        "CASE o_orderkey % 5 WHEN 2 THEN concat('\"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00.000Z\"') ELSE CAST(unix_timestamp(o_orderdate) * 1000 AS STRING) END, "
        "', \"categories\": ', CASE o_orderkey % 5 WHEN 3 THEN '[\"x\"]' ELSE '{\"location\": \"Perth\"}' END, "
        "', \"salaryRange\": ', CASE o_orderkey % 5 WHEN 1 THEN '\"n/a\"' ELSE '{\"min\": 7}' END, '}') END AS value"
    ).write.text(path)
    good, _ = landed.split_malformed(landed.read_lever(spark, path, multi_line=False))
    return lever.normalise(good, "Acme", STAMP).select("job_id", "job_title", "location", "posting_date", F.col("salary_range")["min"].alias("low"))


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority AS job_title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Oslo' END AS location FROM orders"
)
def greenhouse_odd_job(spark, folder):
    """Landed boards of twenty jobs, every third job with a text for its location object: no job is lost."""
    path = f"{shared_folder(spark)}/greenhouse-{uuid.uuid4().hex}"
    jobs = table(spark, folder, "orders").selectExpr(
        "o_orderkey DIV 20 AS board", "concat('{\"id\": ', o_orderkey, ', \"title\": \"', o_orderpriority, '\", \"location\": ', "
        "CASE o_orderkey % 3 WHEN 0 THEN '\"Perth\"' ELSE '{\"name\": \"Oslo\"}' END, '}') AS job"
    )
    boards = jobs.groupBy("board").agg(F.array_join(F.collect_list("job"), ", ").alias("jobs"))
    boards.selectExpr("concat('{\"jobs\": [', jobs, ']}') AS value").write.text(path)
    good, _ = landed.split_malformed(landed.read_greenhouse(spark, path, multi_line=False))
    return greenhouse.normalise(greenhouse.explode_postings(good), "Acme", STAMP).select("job_id", "job_title", "location")


def lines(rows, name: str) -> str:
    """Write one text column as a landing of lines; gives its path."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path


ODD_JOB = "CASE WHEN o_orderkey % 7 = 0 THEN '\"odd\"' WHEN o_orderkey % 11 = 0 THEN '[1]' ELSE concat('{\"id\": ', o_orderkey, ', \"departments\": [\"x\", {\"name\": \"', o_orderpriority, '\"}, {\"name\": \"E\"}, 4]}') END"


def odd_boards(spark, folder):
    """Boards of twenty jobs in key order; some jobs are no objects, every job has departments of several shapes."""
    jobs = table(spark, folder, "orders").selectExpr("o_orderkey", "o_orderkey DIV 20 AS board", f"{ODD_JOB} AS job")
    boards = jobs.groupBy("board").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "job"))).alias("jobs"))
    text = F.array_join(F.transform("jobs", lambda pair: pair["job"]), ", ")
    landing = boards.select(F.concat(F.lit('{"jobs": ['), text, F.lit('], "meta": {"total": '), F.size("jobs"), F.lit("}}")).alias("value"))
    return landed.read_greenhouse(spark, lines(landing, "boards"), multi_line=False)


@query(
    "WITH j AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) - 1 AS place FROM orders) "
    "SELECT 'good' AS kind, CAST(o_orderkey AS VARCHAR) AS item, place, o_orderpriority || ', E' AS department FROM j WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 "
    "UNION ALL SELECT 'odd', CASE WHEN o_orderkey % 7 = 0 THEN '\"odd\"' ELSE '[1]' END, place, NULL FROM j WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0"
)
def greenhouse_odd_items(spark, folder):
    """Jobs that are no objects are set apart with their place; the others, and their sound departments, stay."""
    boards, bad = landed.split_malformed(odd_boards(spark, folder))
    exploded = greenhouse.explode_postings(boards)
    good = greenhouse.normalise(exploded, "Acme", STAMP, ("ordinal",)).selectExpr("'good' AS kind", "job_id AS item", "CAST(ordinal AS BIGINT) AS place", "department")
    odd = odd_items(boards).selectExpr("'odd' AS kind", "item", "CAST(place AS BIGINT) AS place", "CAST(NULL AS STRING) AS department")
    return good.unionByName(odd)


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE o_orderkey % 5 WHEN 0 THEN '' ELSE 'Bergen' END AS location, "
    "CASE o_orderkey % 5 WHEN 1 THEN 'onsite' WHEN 0 THEN 'onsite' ELSE 'hybrid' END AS workplace_type, CASE o_orderkey % 5 WHEN 2 THEN '' ELSE 'Planning' END AS function, "
    "CASE o_orderkey % 5 WHEN 3 THEN '' ELSE o_orderpriority END AS description FROM orders WHERE o_orderkey % 5 <> 4"
)
def smartrecruiters_odd_fields(spark, folder):
    """Details with a text for the location, a word for a flag, a text for a label or a list for a section: only that leaf is blank.
    Details that are no objects are set apart."""
    detail = (
        "CASE o_orderkey % 5 WHEN 4 THEN '[3]' ELSE concat('{\"id\": \"', o_orderkey, '\", \"location\": ', CASE o_orderkey % 5 WHEN 0 THEN '\"Bergen\"' "
        "WHEN 1 THEN '{\"city\": \"Bergen\", \"hybrid\": \"maybe\"}' ELSE '{\"city\": \"Bergen\", \"hybrid\": true}' END, "
        "', \"function\": ', CASE o_orderkey % 5 WHEN 2 THEN '\"Planning\"' ELSE '{\"label\": \"Planning\"}' END, "
        "', \"jobAd\": {\"sections\": {\"qualifications\": 7, \"jobDescription\": ', CASE o_orderkey % 5 WHEN 3 THEN '[\"x\"]' ELSE concat('{\"text\": \"', o_orderpriority, '\"}') END, '}}}') END AS value"
    )
    path = lines(table(spark, folder, "orders").selectExpr(detail), "details")
    good, _ = landed.split_malformed(landed.read_smartrecruiters_details(spark, path, multi_line=False))
    return smartrecruiters.normalise(good, "Acme", STAMP).select("job_id", "location", "workplace_type", "function", "description")


DATASET = "CAST(o_orderkey AS STRING) AS job_id, 'Acme' AS company, o_orderpriority AS job_title, CASE WHEN o_orderkey % 2 = 0 THEN 'Oslo' END AS location, o_comment_ AS description, 'https://x.example/' || o_orderkey AS source_url, CAST(o_orderdate AS STRING) AS posting_date"


@query(
    "SELECT 'whole' AS dataset, count(*) AS n, '' AS missing FROM orders UNION ALL SELECT 'cut', count(*), 'company;description' FROM orders UNION ALL "
    "SELECT 'sparse', count(*), 'location' FROM orders"
)
def dataset_columns(spark, folder):
    """The columns that three datasets lack: none, two that no record has, and one that is null in all and so not written."""
    orders = table(spark, folder, "orders").withColumn("o_comment_", F.concat(F.lit("text of "), "o_custkey"))
    whole = orders.selectExpr(*split_expressions(DATASET))
    found = []
    for name, rows in (("whole", whole), ("cut", whole.drop("company", "description")), ("sparse", whole.withColumn("location", F.lit(None).cast("string")))):
        path = lines(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")), name)
        shape = landed.dataset_shape(variant_documents(spark, path, False))
        found.append((name, shape["n"], ";".join(landed.missing_columns(shape["schema"]))))
    return spark.createDataFrame(found, "dataset string, n bigint, missing string")


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority AS job_title, CASE WHEN o_orderkey % 2 = 0 THEN 'Oslo' END AS location, 'text of ' || o_custkey AS description, "
    "CAST(NULL AS VARCHAR) AS team FROM orders"
)
def posting_dataset(spark, folder):
    """Postings written by the record sink and scanned again as a dataset."""
    orders = table(spark, folder, "orders").withColumn("o_comment_", F.concat(F.lit("text of "), "o_custkey"))
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    write_records(orders.selectExpr(*split_expressions(DATASET)), path)
    return landed.read_postings(spark, path, multi_line=False).select("job_id", "job_title", "location", "description", "team")


@query("SELECT CAST(event_id AS VARCHAR) AS job_id, event_type AS content FROM events WHERE event_id % 2 = 0")
def response_scan(spark, folder):
    """Stored responses written and scanned; an empty result table leaves the earlier output as it is."""
    rows = table(spark, folder, "events").filter("event_id % 2 = 0").selectExpr("CAST(event_id AS STRING) AS job_id", "event_type AS content")
    path = f"{shared_folder(spark)}/responses-{uuid.uuid4().hex}"
    write_results(rows, path)
    write_results(rows.filter("job_id IS NULL"), path)
    return landed.read_responses(spark, path).select("job_id", "content")


#: Companies are numbers to 39: even ones on Greenhouse, odd ones on Lever.
COMPANY = "CAST(o_custkey % 40 AS INT)"


@query(
    f"WITH o AS (SELECT *, {COMPANY} AS c FROM orders WHERE o_custkey % 40 <> 38), boards AS (SELECT c, o_orderkey // 200 AS board, count(*) AS n FROM o WHERE c % 2 = 0 GROUP BY ALL), "
    "faults AS (SELECT c, min((n + 1) || ' postings declared, ' || n || ' held') AS error FROM boards WHERE c % 10 = 4 AND board % 7 = 0 GROUP BY c "
    "UNION ALL SELECT c, min('duplicate job id: ' || o_orderkey) FROM o WHERE c % 10 = 3 AND o_orderkey % 5 = 0 GROUP BY c "
    "UNION ALL SELECT c, 'posting 1 is missing: job_title, location' FROM o WHERE c % 10 = 7 AND o_orderkey % 9 = 0 GROUP BY c) "
    "SELECT 'c' || e.c AS company_id, '2026-08-11' AS scrape_date, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS jobs_found, "
    "CASE WHEN error IS NULL AND n > 0 THEN 'success' ELSE 'failed' END AS status, coalesce(error, CASE WHEN n IS NULL THEN 'the source returned no postings' END) AS error_message "
    "FROM range(40) e(c) LEFT JOIN (SELECT c, count(*) AS n FROM o GROUP BY c) USING (c) LEFT JOIN faults USING (c)"
)
def collection_run(spark, folder):
    """The log of one run over forty companies of two platforms: boards with a wrong total, repeated ids, incomplete postings and a
    company that landed nothing each fail alone."""
    orders = table(spark, folder, "orders").filter("o_custkey % 40 <> 38").selectExpr("*", f"{COMPANY} AS c")
    root = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    job = (
        "concat('{\"id\": ', o_orderkey, ', \"title\": \"', o_orderpriority, '\", \"location\": {\"name\": \"Oslo\"}, \"content\": \"d\", "
        "\"first_published\": \"2001-01-01T00:00:00Z\", \"absolute_url\": \"https://x.example/', o_orderkey, '\"}')"
    )
    boards = orders.filter("c % 2 = 0").selectExpr("c", "o_orderkey DIV 200 AS board", f"{job} AS job").groupBy("c", "board").agg(F.collect_list("job").alias("jobs"))
    total = F.size("jobs") + F.when((F.col("c") % 10 == 4) & (F.col("board") % 7 == 0), 1).otherwise(0)
    board_text = F.concat(F.lit('{"jobs": ['), F.array_join("jobs", ", "), F.lit('], "meta": {"total": '), total, F.lit("}}"))
    postings = orders.filter("c % 2 = 1").selectExpr(
        "c", "CASE WHEN c % 10 = 3 AND o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS copies", "concat('{\"id\": ', o_orderkey, CASE WHEN c % 10 = 7 AND o_orderkey % 9 = 0 THEN '' "
        "ELSE concat(', \"text\": \"', o_orderpriority, '\", \"categories\": {\"location\": \"Oslo\"}') END, ', \"descriptionPlain\": \"d\", \"createdAt\": 1000000000000, "
        "\"hostedUrl\": \"https://x.example/', o_orderkey, '\"}') AS value",
    )
    landings = {"Greenhouse": boards.select("c", board_text.alias("value")), "Lever": postings.select("c", F.explode(F.array_repeat("value", F.col("copies"))).alias("value"))}
    for ats, rows in landings.items():
        rows.selectExpr("concat('c', c) AS company", "'r1' AS run", "value").write.partitionBy("company", "run").text(f"{root}/ats={ats}")
    expected = spark.range(40).selectExpr("concat('c', id) AS company", "CASE WHEN id % 2 = 0 THEN 'Greenhouse' ELSE 'Lever' END AS ats")
    _, log = collect_run(spark, root, expected, "r1", STAMP, multi_line=False)
    return log.drop("scrape_id").withColumn("scrape_date", F.col("scrape_date").cast("string"))
