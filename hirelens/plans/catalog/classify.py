"""Classification, skills and stored responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...fixed_values import AV_SIGNALS, DATASET_SIGNALS, SKILL_SYNONYMS, TAXONOMY_TERMS
from ...functions import labels, skills
from ...functions.responses import response_error, with_parsed
from ...operators import classify as k, terms
from .. import reports
from .registry import query, table
from .views import PART_TEXT, sql_matched, sql_words


def described(spark, folder):
    return table(spark, folder, "part", costly=True).selectExpr("p_partkey", "p_brand AS title", f"{PART_TEXT} AS description")


def labels_sql(taxonomy, source: str, key: str) -> str:
    """One row per (key, category) with evidence, from `source` which has framed words `w`."""
    arms = " UNION ALL ".join(
        f"SELECT {key}, '{category}' AS category, {sql_matched('w', terms)} AS terms FROM {source}"
        for category, terms in taxonomy.items()
    )
    return (
        f"SELECT {key}, category, array_to_string(list_sort(terms), ';') AS matched_terms, "
        "len(terms) + len(list_filter(terms, lambda x: contains(x, ' ') OR contains(x, '_'))) AS weight "
        f"FROM ({arms}) WHERE len(terms) > 0"
    )


def bridge_sql(taxonomy, source: str, key: str) -> str:
    return (
        "SELECT *, round(weight / sum(weight) OVER (PARTITION BY " + key + "), 6) AS confidence_score, 2 AS taxonomy_version FROM "
        f"(SELECT {key}, category, matched_terms, CAST(weight AS INT) AS weight FROM ({labels_sql(taxonomy, source, key)}))"
    )


PARTS_SQL = f"(SELECT p_partkey, {sql_words('p_brand || chr(10) || ' + PART_TEXT)} AS w FROM part)"


@query(bridge_sql(TAXONOMY_TERMS, PARTS_SQL, "p_partkey"))
def keyword_classify(spark, folder):
    """The unified taxonomy over part descriptions in trade terms."""
    rows = k.label_rows(k.labels_of(described(spark, folder), ["title", "description"], "p_partkey"), "p_partkey")
    return rows.withColumn("matched_terms", F.array_join("matched_terms", ";"))


# A small taxonomy of words that the documents hold.
DOCUMENT_TERMS = {
    "English": ("the", "and", "with", "of the", "is in"),
    "German": ("und", "nicht", "für", "mit", "ist der"),
    "French": ("que", "dans", "avec", "le la"),
    "Abusive": ("stupid", "worthless"),
}


@query(bridge_sql(DOCUMENT_TERMS, f"(SELECT doc_id, {sql_words('text')} AS w FROM documents)", "doc_id"))
def document_topics(spark, folder):
    """The same classifier over whole documents, with its own terms."""
    found = k.labels_of(table(spark, folder, "documents", costly=True).select("doc_id", "text"), ["text"], "doc_id", DOCUMENT_TERMS)
    return k.label_rows(found, "doc_id").withColumn("matched_terms", F.array_join("matched_terms", ";"))


# What the source says a part is for, as its department would.
STATED = "CASE p_type WHEN 'ECONOMY' THEN 'Planning' WHEN 'PROMO' THEN 'Control' END"


def verdict_sql(stated: str) -> str:
    return (
        f"WITH l AS ({labels_sql(TAXONOMY_TERMS, PARTS_SQL, 'p_partkey')}), "
        "v AS (SELECT p_partkey, arg_max(category, lpad(CAST(weight AS VARCHAR), 5, '0') || category) AS primary_category, max(weight) AS top, "
        "list_sort(list(weight))[-2] AS second, max(weight) / sum(weight) AS share, list_sort(list(category)) AS names FROM l GROUP BY 1) "
        "SELECT part.p_partkey, primary_category, array_to_string(list_filter(names, lambda x: x <> primary_category), ';') AS secondary_categories, "
        "round(share, 6) AS top_share, CASE WHEN primary_category IS NULL THEN 'None' WHEN round(share, 6) >= 0.75 THEN 'High' WHEN round(share, 6) >= 0.5 THEN 'Medium' ELSE 'Low' END AS classification_confidence, "
        f"CASE WHEN second >= top * 0.9 OR {stated} <> primary_category THEN 'conflicting' WHEN round(share, 6) >= 0.5 THEN 'automatic' ELSE 'uncertain' END AS review_status "
        "FROM part LEFT JOIN v USING (p_partkey)"
    )


def verdicts(spark, folder, stated=None):
    parts = described(spark, folder).join(table(spark, folder, "part").select("p_partkey", "p_type"), "p_partkey")
    judged = k.with_verdict(k.classify(parts, ["title", "description"], "p_partkey"), stated=None if stated is None else F.expr(stated))
    others = F.when(F.col("primary_category").isNotNull(), F.array_join("secondary_categories", ";"))
    return judged.select(
        "p_partkey", "primary_category", others.alias("secondary_categories"), "top_share",
        "classification_confidence", "review_status",
    )


@query(verdict_sql("NULL"))
def primary_category(spark, folder):
    """Main and further categories, confidence and review status of every part."""
    return verdicts(spark, folder)


@query(verdict_sql(STATED))
def conflict_review(spark, folder):
    """The same, with categories that the source states for some parts."""
    return verdicts(spark, folder, STATED)


SIGNAL_TEST = " OR ".join(f"contains(w, ' {signal} ')" for signal in AV_SIGNALS + DATASET_SIGNALS)


@query(f"SELECT p_partkey FROM {PARTS_SQL} WHERE {SIGNAL_TEST}")
def av_prefilter(spark, folder):
    return k.av_relevant(described(spark, folder), ["title", "description"], "p_partkey").select("p_partkey")


@query(
    "SELECT o_orderkey, round((CAST(o_orderpriority <> '5-LOW' AS INT) + CAST(o_totalprice > 50000 AS INT) + CAST(o_orderstatus = 'F' AS INT)) / 3, 6) AS extraction_confidence FROM orders"
)
def extraction_confidence(spark, folder):
    flags = [F.expr("o_orderpriority <> '5-LOW'"), F.expr("o_totalprice > 50000"), F.expr("o_orderstatus = 'F'")]
    return table(spark, folder, "orders").select("o_orderkey", k.extraction_confidence(flags).alias("extraction_confidence"))


SKILL_NAMES = ("C", "C++", "Python", "LiDAR", "HD map", "MPC", "ROS 2", "Lanelet2", "object detection")


def skill_case(name: str) -> str:
    test = f"contains(t, ' {name} ')" if len(name) == 1 else f"contains(lower(t), ' {name.lower()} ')"
    return f"CASE WHEN {test} THEN '{name}' END"


@query(
    f"SELECT p_partkey, array_to_string(list_filter([{', '.join(skill_case(name) for name in SKILL_NAMES)}], lambda x: x IS NOT NULL), ';') AS skills "
    f"FROM (SELECT p_partkey, {sql_words(PART_TEXT, '+#', False)} AS t FROM part)"
)
def skill_terms(spark, folder):
    """C, C++ and the rest stay distinct."""
    return terms.name_lists(described(spark, folder).select("p_partkey", "description"), "p_partkey", "description", SKILL_NAMES).select(
        "p_partkey", F.array_join("skills", ";").alias("skills")
    )


SYNONYM_CASE = "CASE lower(trim(skill)) " + " ".join(
    f"WHEN '{spelling}' THEN '{normal}'" for spelling, normal in SKILL_SYNONYMS.items()
) + " ELSE skill END"


@query(
    f"SELECT p_partkey, skill AS original, {SYNONYM_CASE} AS normalised FROM (SELECT p_partkey, unnest(string_split({PART_TEXT}, ', ')) AS skill FROM part)"
)
def skill_normalise(spark, folder):
    words = described(spark, folder).select("p_partkey", F.explode(F.split("description", ", ")).alias("original"))
    return words.select("p_partkey", "original", skills.normalise_skill("original").alias("normalised"))


# Event properties as stored responses: fenced, wrapped in prose, incomplete or broken.
RESPONSE_BODY = (
    "'{\"company\": \"wrong\", \"title\": \"wrong\", \"career_page_url\": \"x\", \"role_profile\": \"' || event_type || '\", "
    "\"skills\": [\"C++\", \"' || event_type || '\"], \"functional_area\": \"area ' || user_id || '\"}'"
)
RESPONSE_TEXT = (
    "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '```json ' || {body} || ' ```' WHEN 1 THEN 'Here it is: ' || {body} || ' Good luck.' "
    "WHEN 2 THEN props WHEN 3 THEN 'no answer' WHEN 4 THEN replace({body}, '[\"C++\", ', '\"') ELSE {body} END"
).replace("{body}", RESPONSE_BODY)


@query(
    "SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 2 THEN 'missing fields: career_page_url, company, functional_area, role_profile, skills, title' "
    "WHEN 3 THEN 'not JSON' WHEN 4 THEN 'not JSON' END AS error FROM events"
)
def response_errors(spark, folder):
    """Why a stored response cannot be used; null when it can."""
    parsed = with_parsed(table(spark, folder, "events", costly=True).selectExpr("event_id", f"{RESPONSE_TEXT} AS content"))
    return parsed.select("event_id", response_error("parsed").alias("error"))


@query(
    "SELECT event_id AS job_id, 'User ' || user_id AS company, 'Title ' || event_id AS title, 'https://x.example/' || event_id AS career_page_url, "
    "event_type AS role_profile, 'C++;' || event_type AS skills, 'area ' || user_id AS functional_area FROM events WHERE event_id % 6 IN (0, 1, 5)"
)
def response_parse(spark, folder):
    """Usable responses with company, title and page taken from the posting."""
    events = table(spark, folder, "events", costly=True)
    responses = events.selectExpr("event_id AS job_id", f"{RESPONSE_TEXT} AS content")
    truth = events.selectExpr(
        "event_id AS job_id", "'User ' || user_id AS company", "'Title ' || event_id AS job_title",
        "'https://x.example/' || event_id AS source_url",
    )
    good, _ = reports.ingest_responses(responses, truth)
    return good.withColumn("skills", F.array_join("skills", ";"))


@query(
    "SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'Sensing' WHEN 1 THEN 'Localisation' WHEN 2 THEN 'Perception' WHEN 3 THEN 'Planning' WHEN 4 THEN 'Control' "
    "WHEN 5 THEN 'System and Safety' WHEN 6 THEN 'Vehicle Interface' WHEN 7 THEN 'Mapping' END AS category, "
    "CASE p_size % 7 WHEN 0 THEN 'AV Startup' WHEN 1 THEN 'AV Startup' WHEN 2 THEN 'Tier 1 Supplier' WHEN 3 THEN 'Tier 1 Supplier' WHEN 4 THEN 'OEM' WHEN 5 THEN 'Tech Giant' ELSE 'Other' END AS company_type FROM part"
)
def label_names(spark, folder):
    """Categories of the browse taxonomy in version 2 names, and company types as their four-way labels."""
    old = "array('Sensing', 'Localization', ' Perception', 'Planning', 'Control', 'System', 'Vehicle Interface', 'Map', 'Unknown')[p_size % 9]"
    kind = "array('AV_Startup', 'AV_Tools', 'AV_Chip', 'Supplier', 'OEM', 'OEM_Tech', 'Other')[p_size % 7]"
    rows = table(spark, folder, "part").selectExpr("p_partkey", f"{old} AS old", f"{kind} AS kind")
    return rows.select("p_partkey", labels.taxonomy_2("old").alias("category"), labels.company_type_label("kind").alias("company_type"))


@query(
    "SELECT o_orderkey AS id, 'u' || o_orderkey AS absolute_url, o_orderpriority AS title_taxonomy, o_orderstatus AS functional_area, "
    "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' again' END AS title_salary, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS salary_min FROM orders"
)
def board_classifications(spark, folder):
    """Board classifications beside the salaries of the same posting, matched by id and page."""
    orders = table(spark, folder, "orders")
    labelled = orders.selectExpr("o_orderkey AS id", "'u' || o_orderkey AS absolute_url", "o_orderpriority AS title", "o_orderstatus AS functional_area")
    paid = orders.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey AS id", "'u' || o_orderkey AS absolute_url", "o_orderpriority || ' again' AS title", "o_totalprice AS salary_min")
    return reports.board_classification_report(labelled, paid)
