"""Salary extraction, the salary reference and the fallback chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...fixed_values import TITLE_STOP_WORDS
from ...functions.salary import ANY_AMOUNT_STEPS, RANGE_READINGS, with_any_salary, with_salary_range
from ...operators.joins import best_title_match
from ...sources.landed import salary_reference
from .. import reports
from .registry import query, table
from .views import DUCK, PART_TITLE, SPARK, last_word, part_pay, pay_text, sql_tokens


def range_sql(source: str, keys: str, reading: str) -> str:
    """Salary columns of `source`, which has `txt`, in plain SQL."""
    shape = RANGE_READINGS[reading]
    p = "(?i)" + shape.pattern
    around = f"(?is).{{0,60}}?(?:{shape.pattern}).{{0,80}}"
    return (
        f"SELECT {keys}, "
        f"TRY_CAST(replace(regexp_extract(txt, '{p}', {shape.minimum}), ',', '') AS DOUBLE) AS salary_min, "
        f"TRY_CAST(replace(regexp_extract(txt, '{p}', {shape.maximum}), ',', '') AS DOUBLE) AS salary_max, "
        f"upper(coalesce(nullif(regexp_extract(txt, '{p}', {shape.code}), ''), "
        f"CASE regexp_extract(txt, '{p}', 1) WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' END)) AS salary_currency, "
        f"CASE WHEN NOT regexp_matches(txt, '{p}') THEN NULL "
        f"WHEN regexp_matches(regexp_extract(txt, '{around}'), '(?i)hour|/hr') THEN 'hour' ELSE 'year' END AS salary_period, "
        f"CASE WHEN regexp_matches(txt, '{p}') THEN trim(regexp_replace(regexp_extract(txt, '{around}'), '\\s+', ' ', 'g')) END AS salary_snippet "
        f"FROM {source}"
    )


def amount_sql(source: str, keys: str) -> str:
    first, second, third = (shape.pattern for shape in ANY_AMOUNT_STEPS)

    def pick(*groups: int) -> str:
        return (
            f"CASE WHEN regexp_matches(txt, '{first}') THEN regexp_extract(txt, '{first}', {groups[0]}) "
            f"WHEN regexp_matches(txt, '{second}') THEN regexp_extract(txt, '{second}', {groups[1]}) "
            f"WHEN regexp_matches(txt, '{third}') THEN regexp_extract(txt, '{third}', {groups[2]}) END"
        )

    return (
        f"SELECT {keys}, CAST(replace({pick(2, 2, 2)}, ',', '') AS BIGINT) AS salary_min, "
        f"CAST(replace({pick(4, 2, 2)}, ',', '') AS BIGINT) AS salary_max, "
        f"coalesce(nullif({pick(5, 3, 3)}, ''), CASE {pick(1, 1, 1)} "
        f"WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' END) AS salary_currency, "
        f"{pick(0, 0, 0)} AS salary_snippet FROM {source}"
    )


POSTINGS_SQL = (
    "(SELECT o_orderkey AS job_id, o_orderpriority AS job_title, n_name AS location, "
    "'https://jobs.example.com/' || o_orderkey AS source_url, "
    f"{pay_text(DUCK)} AS txt FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN nation ON c_nationkey = n_nationkey)"
)


def postings(spark, folder):
    """Orders as postings with a place and a text that may state pay."""
    places = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey"), "left"
    ).select("c_custkey", "n_name")
    return table(spark, folder, "orders", costly=True).join(places, F.expr("o_custkey = c_custkey"), "left").selectExpr(
        "o_orderkey AS job_id", "o_orderpriority AS job_title", "n_name AS location",
        "'https://jobs.example.com/' || o_orderkey AS source_url", f"{pay_text(SPARK)} AS description",
    )


@query("SELECT *, 'job_post' AS salary_source FROM (" + range_sql(
    POSTINGS_SQL, "job_id, job_title, location, source_url", "mobility") + ") WHERE salary_min IS NOT NULL")
def salary_report(spark, folder):
    return reports.salary_report(postings(spark, folder), "mobility")


@query(amount_sql(f"(SELECT o_orderkey, {pay_text(DUCK)} AS txt FROM orders)", "o_orderkey"))
def salary_fallback_chain(spark, folder):
    texts = table(spark, folder, "orders", costly=True).selectExpr("o_orderkey", f"{pay_text(SPARK)} AS txt")
    return with_any_salary(texts, "txt").drop("txt")


HOURLY = (
    "CASE CAST(p_partkey % 3 AS INT) "
    "WHEN 0 THEN 'Shift $' || (p_size + 20) || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR(2)), 2, '0') || '–$' "
    "|| (p_size + 25) || '.50/hr' "
    "WHEN 1 THEN 'About $1,' || (p_size + 100) || ' to $2,' || (p_size + 300) || ' weekly' "
    "ELSE 'See $' || (p_size + 20) || ' - $' || (p_size + 30) || '00 in all' END"
)


@query(range_sql(f"(SELECT p_partkey, {HOURLY} AS txt FROM part)", "p_partkey", "onboard"))
def salary_hourly(spark, folder):
    texts = table(spark, folder, "part").selectExpr("p_partkey", f"{HOURLY} AS txt")
    return with_salary_range(texts, "txt", "onboard").drop("txt", "salary_source")


@query(range_sql(f"(SELECT p_partkey, {HOURLY} AS txt FROM part)", "p_partkey", "onboard_strict"))
def salary_hourly_strict(spark, folder):
    texts = table(spark, folder, "part").selectExpr("p_partkey", f"{HOURLY} AS txt")
    return with_salary_range(texts, "txt", "onboard_strict").drop("txt", "salary_source")


HALVED = "substring(text, 1, CAST(floor(n_chars / 2) AS INT)) || ' {pay} ' || substring(text, CAST(floor(n_chars / 2) AS INT) + 1)"


def with_pay(engine: str) -> str:
    return HALVED.replace("'{pay}'", "").replace("' {pay} '", f"' ' || {pay_text(engine)} || ' '")


@query(range_sql(
    f"(SELECT doc_id, {with_pay(DUCK)} AS txt FROM documents JOIN orders ON doc_id = o_orderkey)",
    "doc_id", "mobility"))
def salary_snippet(spark, folder):
    """Pay stated in the middle of a whole document."""
    texts = table(spark, folder, "documents", costly=True).join(
        table(spark, folder, "orders"), F.expr("doc_id = o_orderkey")
    ).selectExpr("doc_id", f"{with_pay(SPARK)} AS txt")
    return with_salary_range(texts, "txt", "mobility").drop("txt", "salary_source")


def reference_line(engine: str) -> str:
    """Lines of a salary page: a table row with markup, a plain line, or a row of one cell."""
    return (
        f"CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '<td><b>' || {last_word(engine)} || '</b> ' || p_type || ' | ' || p_brand || ' | $' || {part_pay(engine)} "
        f"WHEN 1 THEN {last_word(engine)} || ' ' || p_type || ' $' || {part_pay(engine)} || ' USD' "
        f"ELSE '| ' || p_type || ' ' || {last_word(engine)} || ' $' || {part_pay(engine)} || ' |' END"
    )


REFERENCE_SQL = amount_sql(
    "(SELECT p_partkey, CASE WHEN n >= 2 THEN cells[1] ELSE line END AS title_text, "
    "CASE WHEN n >= 2 THEN array_to_string(cells[2:], ' ') ELSE line END AS txt FROM ("
    "SELECT *, len(cells) AS n FROM ("
    "SELECT p_partkey, line, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM ("
    f"SELECT p_partkey, trim(regexp_replace({reference_line(DUCK)}, '<[^>]+>', ' ', 'g')) AS line FROM part))))",
    "p_partkey AS ordinal, title_text",
)


def reference_entries(spark, folder):
    lines = table(spark, folder, "part", costly=True).selectExpr("p_partkey AS ordinal", f"{reference_line(SPARK)} AS value")
    return salary_reference(lines)


@query(f"SELECT * FROM ({REFERENCE_SQL}) WHERE salary_min IS NOT NULL")
def salary_reference_scan(spark, folder):
    return reference_entries(spark, folder).drop("title_tokens")



def match_sql(title: str) -> str:
    return MATCH_TEMPLATE.replace("{title}", title)


MATCH_TEMPLATE = (
    f"entries AS (SELECT * FROM ({REFERENCE_SQL}) WHERE salary_min IS NOT NULL), "
    "offered AS (SELECT lower(title_text) AS e, min(ordinal) AS ordinal, any_value(tok) AS tok FROM "
    f"(SELECT *, {sql_tokens('title_text', TITLE_STOP_WORDS)} AS tok FROM entries) GROUP BY 1), "
    f"wanted AS (SELECT t, {sql_tokens('t', TITLE_STOP_WORDS)} AS tok FROM (SELECT DISTINCT lower({{title}}) AS t FROM part)), "
    "scored AS (SELECT t, ordinal, len(list_intersect(wanted.tok, offered.tok)) + "
    "CASE WHEN contains(t, e) OR contains(e, t) THEN 1 ELSE 0 END AS score FROM wanted CROSS JOIN offered), "
    "best AS (SELECT t AS title_key, ordinal AS entry_ordinal, CAST(score AS BIGINT) AS score FROM scored WHERE score >= 2 "
    "QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, ordinal) = 1)"
)


@query(f"WITH {match_sql(PART_TITLE)} SELECT * FROM best")
def best_match(spark, folder):
    """Checked against a brute-force comparison of every title with every entry."""
    titles = table(spark, folder, "part").selectExpr(f"{PART_TITLE} AS title")
    return best_title_match(titles, "title", reference_entries(spark, folder))


BOARD_TITLE = f"({PART_TITLE} || CASE WHEN p_size > 25 THEN ' Software' ELSE ' Sales' END)"


def board_content(engine: str) -> str:
    return (
        f"CASE WHEN p_size % 3 = 0 THEN '<p>Pay <b>$' || {part_pay(engine)} || '</b> - $' || "
        f"{part_pay(engine)} || ' USD</p>' ELSE '<p>Apply</p>' END"
    )


@query(
    f"WITH {match_sql(BOARD_TITLE)}, post AS ("
    + amount_sql(
        "(SELECT p_partkey, " + BOARD_TITLE + " AS title, p_brand, trim(regexp_replace(regexp_replace("
        + board_content(DUCK) + ", '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS txt FROM part)",
        "p_partkey, title, p_brand")
    + ") SELECT post.p_partkey AS id, post.title, p_brand AS location_name, 'https://x.example/' || p_partkey AS absolute_url, "
    "coalesce(post.salary_min, m.salary_min) AS salary_min, "
    "CASE WHEN post.salary_min IS NOT NULL THEN post.salary_max ELSE m.salary_max END AS salary_max, "
    "CASE WHEN post.salary_min IS NOT NULL THEN post.salary_currency ELSE m.salary_currency END AS salary_currency, "
    "CASE WHEN post.salary_min IS NOT NULL THEN post.salary_snippet ELSE m.salary_snippet END AS salary_snippet, "
    "CASE WHEN post.salary_min IS NOT NULL THEN 'job_post' ELSE 'levels_fyi' END AS salary_source "
    "FROM post LEFT JOIN (SELECT best.title_key, entries.* FROM best JOIN entries ON entry_ordinal = ordinal) m "
    "ON lower(post.title) = m.title_key "
    "WHERE regexp_matches(post.title, '(?i)machine learning|ml|software|autonomy|autonomous|robot|perception|planning|simulation|ai') "
    "AND coalesce(post.salary_min, m.salary_min) IS NOT NULL"
)
def salary_post_or_reference(spark, folder):
    """The board report: title filter, pay from the text, else from the closest reference title."""
    jobs = table(spark, folder, "part").selectExpr(
        "p_partkey AS id", f"{BOARD_TITLE} AS title", "struct(p_brand AS name) AS location",
        "'https://x.example/' || p_partkey AS absolute_url", f"{board_content(SPARK)} AS content",
    )
    return reports.board_salary_report(jobs, reference_entries(spark, folder))
