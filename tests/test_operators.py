from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from hirelens.fixed_values import SKILL_TYPES
from hirelens.operators import aggregates, classify, companies, joins, quality, search
from hirelens.plans import reports


def posting(**changes):
    row = {
        "company": "Tram Works", "job_id": "1", "job_title": "Track Walker", "location": "Turku",
        "description": "Walk the line at night.", "posting_date": "2025-02-03T00:00:00Z",
        "source_url": "https://tram.example/1", "collection_method": "file", "ats": "Paper",
        "collected_at": "2025-02-04T05:00:00Z",
    }
    return {**row, **changes}


def frame(spark, rows):
    return spark.createDataFrame([tuple(row.values()) for row in rows], ", ".join(f"{name} string" for name in rows[0]))


def test_strict_validation(spark):
    quality.validate_batch(frame(spark, [posting(), posting(job_id="2")]))
    quality.validate_batch(frame(spark, [posting(), posting(company="Other")]))
    with pytest.raises(ValueError, match="duplicate Tram Works job id: 1"):
        quality.validate_batch(frame(spark, [posting(), posting()]))
    with pytest.raises(ValueError, match="missing: location, description"):
        quality.validate_batch(frame(spark, [posting(description="", location=None)]))
    with pytest.raises(ValueError, match="no postings"):
        quality.validate_batch(frame(spark, [posting()]).limit(0))


def test_quarantine_keeps_every_row(spark):
    good, bad = quality.split_required(frame(spark, [posting(), posting(job_id="2", ats="")]))
    assert good.count() == 1 and bad.first()["missing_fields"] == ["ats"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        quality.require_columns(spark.range(1), ["id", "b", "a"])


def test_missing_by_type(spark):
    row = spark.createDataFrame([([], 0, False, {})], "a array<int>, n int, f boolean, m map<string,string>")
    assert row.select(quality.missing_fields(row, ["a", "n", "f", "m", "gone"]).alias("x")).first()["x"] == ["a", "n", "f", "m", "gone"]


def test_domain_and_references(spark):
    skills = spark.createDataFrame([("1", "tool"), ("2", "magic"), ("3", None)], "id string, kind string")
    assert [r["id"] for r in quality.outside_domain(skills, "kind", SKILL_TYPES).collect()] == ["2"]
    child = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, parent int")
    parent = spark.createDataFrame([(10,), (10,)], "key int")
    assert [r["id"] for r in quality.orphans(child, "parent", parent, "key").collect()] == [2]
    assert {r["id"] for r in quality.cascade_delete(child, "parent", parent, "key").collect()} == {2, 3}


def test_accuracy_needs_a_large_enough_sample(spark):
    truth = spark.range(20).selectExpr("id", "CAST(id AS STRING) AS title")
    passed = quality.field_accuracy(truth, truth.filter("id < 19"), "id", ["title"]).first()
    assert (passed["accuracy"], passed["accepted"]) == (0.95, True)
    assert quality.field_accuracy(truth.limit(19), truth, "id", ["title"]).first()["accepted"] is False


def test_one_to_one_join(spark):
    left = spark.createDataFrame([("1", "a")], "job_id string, title string")
    right = spark.createDataFrame([("1", 5), ("2", 6), ("2", 7)], "job_id string, pay int")
    broken = joins.one_to_one_left(left, right, "job_id")  # no job yet
    with pytest.raises(Exception, match="job_id repeats on the right side: 2"):
        broken.count()
    with pytest.raises(Exception, match="left side"):
        joins.one_to_one_left(right, left, "job_id").select("pay").collect()
    assert joins.one_to_one_left(left, right.filter("pay < 7"), "job_id").collect()[0]["pay"] == 5
    empty = joins.one_to_one_left(left.limit(0), right.filter("pay < 7"), "job_id")
    assert empty.columns == ["job_id", "title", "pay"] and empty.isEmpty()


def test_suffixed_join(spark):
    left = spark.createDataFrame([(1, "u", "t1")], "id int, absolute_url string, title string")
    right = spark.createDataFrame([(1, "u", "t2", 5), (1, "u", "t3", 6)], "id int, absolute_url string, title string, pay int")
    rows = joins.suffixed_left_join(left, right, ["id", "absolute_url"], ("_taxonomy", "_salary"))
    assert rows.columns == ["id", "absolute_url", "title_taxonomy", "title_salary", "pay"] and rows.count() == 2


WORDS = ["perception", "planning", "senior", "engineer", "ml", "map", "control", "software", "hd"]


def brute_best(title, entries):
    """Best (score, first ordinal) by comparing with every entry."""
    from hirelens.fixed_values import TITLE_STOP_WORDS

    def tokens(value):
        return {w for w in value.lower().split() if len(w) > 2 and w not in TITLE_STOP_WORDS}

    scored = []
    for ordinal, name in entries:
        low, own = name.lower(), title.lower()
        scored.append((len(tokens(own) & tokens(low)) + (own in low or low in own), -ordinal))
    score, place = max(scored)
    return (score, -place) if score >= 2 and tokens(title) else None


def test_best_match_equals_brute_force(spark):
    pick = random.Random(5)

    def title():
        return " ".join(pick.choice(WORDS) for _ in range(pick.randint(1, 4)))

    titles = sorted({title().title() for _ in range(120)})
    entries = [(n, title()) for n in range(60)]
    table = spark.createDataFrame(entries, "ordinal int, title_text string")
    got = joins.best_title_match(spark.createDataFrame([(t,) for t in titles], "title string"), "title", table)
    expected = {t.lower(): best for t in titles if (best := brute_best(t, entries))}
    assert {r["title_key"]: (r["score"], r["entry_ordinal"]) for r in got.collect()} == expected


def test_fallback_takes_all_fields_from_one_side(spark):
    posts = spark.createDataFrame(
        [(1, "HD Map Planning", 10, None, "USD", "own"), (2, "Map planning lead", None, None, None, None), (3, "Chef", None, None, None, None), (4, None, None, None, None, None)],
        "id int, title string, salary_min_post bigint, salary_max_post bigint, salary_currency_post string, salary_snippet_post string")
    entries = spark.createDataFrame(
        [(0, "Planning map", 7, 8, "EUR", "e0"), (1, "map planning", 9, 9, "GBP", "e1")],
        "ordinal int, title_text string, salary_min bigint, salary_max bigint, salary_currency string, salary_snippet string")
    rows = {r["id"]: r for r in joins.salary_with_fallback(posts, "title", entries, "levels_fyi").collect()}
    assert (rows[1]["salary_min"], rows[1]["salary_max"], rows[1]["salary_source"]) == (10, None, "job_post")
    # The second entry is held by the title, so it scores one more than the first.
    assert (rows[2]["salary_currency"], rows[2]["salary_source"]) == ("GBP", "levels_fyi")
    assert rows[3]["salary_source"] is None and rows[4]["salary_min"] is None and len(rows) == 4


def test_similar_postings_equal_brute_force(spark):
    pick = random.Random(2)
    rows = [(n, "hot" if pick.random() < 0.4 else f"c{pick.randint(0, 30)}") for n in range(400)]
    got = joins.similar_postings(spark.createDataFrame(rows, "id int, category string"), "id", "category", "id")
    expected = set()
    for key, category in rows:
        others = [other for other, kind in rows if kind == category and other != key][:3]
        expected |= {(key, rank, other) for rank, other in enumerate(others, start=1)}
    assert {(r["id"], r["similar_rank"], r["similar_id"]) for r in got.collect()} == expected


def test_new_companies(spark):
    ddl = "n int, name string, website_url string, career_page_url string, company_type string, data_source_status string"
    rows = [(1, " New ", "w1", "c1", "OEM", "confirmed"), (2, "Old", "w2", "c2", "OEM", "confirmed"),
            (3, "X", "old-w", "c3", "OEM", "confirmed"), (4, "Y", "w4", "old-c", "OEM", "confirmed"),
            (5, "New", "w5", "c5", "OEM", "confirmed"), (6, "Z", "w6", " ", "OEM", "confirmed"), (7, "V", "w1", "c7", "OEM", "confirmed")]
    existing = spark.createDataFrame([("Old", "old-w", "old-c")], "name string, website_url string, career_page_url string")
    got = {r["n"]: r["reject_reason"] for r in companies.check_new_companies(spark.createDataFrame(rows, ddl), existing, "n").collect()}
    taken = "company already exists with "
    assert got == {1: None, 2: taken + "name", 3: taken + "website_url", 4: taken + "career_page_url", 5: taken + "name",
                   6: "career_page_url must not be empty", 7: taken + "website_url"}


def test_find_one(spark):
    table = spark.range(3)
    assert companies.find_one(table, "id", 2)["id"] == 2
    with pytest.raises(companies.NotFound):
        companies.find_one(table, "id", 9)


def test_keyword_is_literal(spark):
    jobs = spark.createDataFrame([("100% remote", "A"), ("1000 remote", "B"), (None, "A")], "title string, category string")
    assert search.search_postings(jobs, "0% ", "All", ["title"], "category").count() == 1
    assert search.search_postings(jobs, "  ", "A", ["title"], "category").count() == 2


@pytest.mark.parametrize("number, size, expected", [
    (1, 4, [0, 1, 2, 3]), (3, 4, [8, 9]), (99, 4, [8, 9]), (1, None, [0]), (0, 3.9, [0, 1, 2]), (2, -5, [1]),
])
def test_pages(spark, number, size, expected):
    for sample in (4_000, 2):
        rows = search.page(spark.range(10), ["id"], number, size, sample=sample)
        assert [r["id"] for r in rows.collect()] == expected
    assert search.page(spark.range(0), ["id"], 5, 3).count() == 0


def test_global_places_with_a_hot_value(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS score")
    placed = search.with_global_place(rows, [F.desc("score"), F.asc("id")], "place").collect()
    ordered = sorted(((r["score"], r["id"]) for r in placed), key=lambda pair: (-pair[0], pair[1]))
    assert [(r["score"], r["id"]) for r in sorted(placed, key=lambda r: r["place"])] == ordered
    assert sorted(r["place"] for r in placed) == list(range(1, 5001))


def test_sample_falls_back_only_when_nothing_is_wanted(spark):
    rows = spark.range(10)
    assert [r["id"] for r in search.sample_or_any(rows, F.col("id") == 7, ["id"], 3).collect()] == [7]
    assert [r["id"] for r in search.sample_or_any(rows, F.col("id") > 99, ["id"], 3).collect()] == [0, 1, 2]


def test_distributions_match_a_recount(spark):
    rows = [("a", "x"), ("a", None), (None, "x"), ("b", "x")]
    got = aggregates.distributions(spark.createDataFrame(rows, "category string, company string"), ["category", "company"])
    assert {(r["dimension"], r["value"], r["n"]) for r in got.collect()} == {
        ("category", "a", 2), ("category", None, 1), ("category", "b", 1), ("company", "x", 3), ("company", None, 1)}


def test_snapshot_tells_totals_from_missing_companies(spark):
    labels = spark.createDataFrame([(1, "P", None), (1, "P", None), (2, "P", "w"), (2, "Q", "w")], "job int, category string, company string")
    rows = aggregates.category_snapshot(labels, "category", "company", "job", F.lit("r1"), F.lit("2026-01-01").cast("date")).collect()
    assert {(r["category_id"], r["company_id"], r["is_total"], r["job_count"]) for r in rows} == {
        ("P", None, False, 1), ("P", "w", False, 1), ("P", None, True, 2), ("Q", "w", False, 1), ("Q", None, True, 1)}
    assert len({r["snapshot_id"] for r in rows}) == 5


@pytest.mark.parametrize("sizes, state", [((10, 10), "trend"), ((10, 9), "insufficient_data"), ((40,), "insufficient_data")])
def test_trend_gate(spark, sizes, state):
    rows = [("P", date(2026, month, 3)) for month, size in enumerate(sizes, start=1) for _ in range(size)]
    trend = aggregates.gated_trend(spark.createDataFrame(rows, "category string, day date"), ["category"], "day", "month").collect()
    assert {r["state"] for r in trend} == {state}
    if state == "trend":
        assert [r["n"] for r in sorted(trend, key=lambda r: r["period"])] == [10, 10]
    else:
        assert len(trend) == 1 and trend[0]["n"] is None


def test_bands_keep_units_apart(spark):
    rows = [(49_999.0, "USD"), (50_000.0, "USD"), (50_000.0, "EUR"), (None, "EUR")]
    got = aggregates.salary_bands(spark.createDataFrame(rows, "pay double, currency string"), "pay", ["currency"])
    assert {(r["currency"], r["band"], r["n"]) for r in got.collect()} == {("USD", 0, 1), ("USD", 50_000, 1), ("EUR", 50_000, 1)}


def test_multi_label_example(spark):
    rows = spark.createDataFrame([(1, "LiDAR sensor calibration and point-cloud object detection"), (2, "Pastry chef")], "id int, text string")
    judged = {r["id"]: r for r in classify.with_verdict(classify.classify(rows, ["text"], "id")).collect()}
    assert {label["category"] for label in judged[1]["labels"]} == {"Sensing", "Perception"}
    assert (judged[1]["primary_category"], judged[1]["secondary_categories"]) == ("Sensing", ["Perception"])
    assert judged[2]["primary_category"] is None and judged[2]["review_status"] == "uncertain"
    bridge = classify.label_rows(classify.labels_of(rows, ["text"], "id"), "id").collect()
    assert round(sum(r["confidence_score"] for r in bridge), 5) == 1 and {r["taxonomy_version"] for r in bridge} == {2}


def test_prefilter(spark):
    rows = spark.createDataFrame([(1, "Knows ROS 2 well"), (2, "cross 2 teams"), (3, "self-driving trucks"), (4, None)], "id int, text string")
    assert {r["id"] for r in classify.av_relevant(rows, ["text"], "id").collect()} == {1, 3}


def test_responses_are_overridden_and_failures_kept(spark):
    body = '{"company":"bad","title":"bad","career_page_url":"bad","role_profile":"p","skills":["C"],"functional_area":"f"}'
    responses = spark.createDataFrame([("1", body), ("2", "oops")], "job_id string, content string")
    posts = frame(spark, [posting(), posting(job_id="2")])
    good, failed = reports.ingest_responses(responses, posts)
    row = good.first()
    assert (row["company"], row["title"], row["career_page_url"]) == ("Tram Works", "Track Walker", "https://tram.example/1")
    assert [(r["job_id"], r["error"]) for r in failed.collect()] == [("2", "not JSON")]


def test_salary_report_order(spark):
    texts = {"1": "$90,000 - $99,000", "2": "€50,000 - €60,000", "3": "$95,000 - $99,000", "4": "none"}
    rows = frame(spark, [posting(job_id=key, description=value) for key, value in texts.items()])
    assert [r["job_id"] for r in reports.salary_report(rows, "mobility").collect()] == ["2", "3", "1"]


def test_a_row_the_register_rejects_blocks_nobody(spark):
    ddl = "n int, name string, website_url string, career_page_url string, company_type string, data_source_status string"
    rows = [(1, "A", "old-w", "c1", "OEM", "confirmed"), (2, "A", "w2", "c1", "OEM", "confirmed"), (3, "A", "w3", "c3", "OEM", "confirmed")]
    existing = spark.createDataFrame([("Old", "old-w", "old-c")], "name string, website_url string, career_page_url string")
    got = {r["n"]: r["reject_reason"] for r in companies.check_new_companies(spark.createDataFrame(rows, ddl), existing, "n").collect()}
    assert got == {1: "company already exists with website_url", 2: None, 3: "company already exists with name"}


def test_repeated_mapping_keys_give_one_row(spark):
    mapping = spark.createDataFrame([("js", "JavaScript"), (" JS ", "Javascript")], "original string, canonical string")
    rows = joins.mapped_values(spark.createDataFrame([("Js",), ("go",)], "s string"), "s", mapping, "into").collect()
    assert sorted(r["into"] for r in rows) == ["JavaScript", "go"]
