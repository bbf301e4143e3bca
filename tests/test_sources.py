from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from hirelens import schemas
from hirelens.fixed_values import REQUIRED_FIELDS
from hirelens.operators.quality import validate_batch
from hirelens.plans import maintenance
from hirelens.sources import adapters, greenhouse, landed, lever, sinks, smartrecruiters, variants
from hirelens.sources.register_values import REGISTER_ROWS

STAMP = "2026-08-11T01:00:00Z"
LEVER_JOB = {
    "id": "lv-77", "text": "Tram Data Analyst", "createdAt": 1_700_000_000_123,
    "categories": {"location": "Lisbon, Portugal", "allLocations": ["Lisbon, Portugal"], "team": "Rails", "commitment": "Part-time"},
    "workplaceType": "hybrid", "descriptionPlain": "Count trams by hour.",
    "hostedUrl": "https://lv.example/lv-77", "applyUrl": "https://lv.example/lv-77/apply",
    "salaryRange": {"min": 1, "max": 2, "currency": "NOK"}, "unknown": 1,
}
GREENHOUSE_JOB = {
    "id": 9001, "title": "Signal Box Keeper", "first_published": "2025-02-03T09:30:00+02:00",
    "location": {"name": "Turku or Remote"}, "absolute_url": "https://gh.example/9001",
    "content": "&lt;p&gt;Keep &lt;em&gt;all&lt;/em&gt; signals green.&lt;/p&gt;",
    "departments": [{"name": "Operations"}, {"name": " "}, {"name": "Operations "}], "offices": [{"name": "Remote"}],
}
SMART_JOB = {
    "id": "sr-5", "name": "Ferry Timetable Planner", "releasedDate": "2025-03-04T05:06:07.000Z",
    "applyUrl": "https://sr.example/sr-5?oga=true",
    "location": {"city": "Bergen", "region": "", "country": "no", "hybrid": True},
    "function": {"label": "Planning"}, "typeOfEmployment": {"label": "Seasonal"},
    "jobAd": {"sections": {
        "qualifications": {"title": "You bring", "text": "<ul><li>Sea legs</li></ul>"},
        "jobDescription": {"title": "The work", "text": "<p>Plan the ferries.</p>"},
        "additionalInformation": {"title": "Empty", "text": " "},
    }},
}


def landing(tmp_path, payload, name="drop.json"):
    path = tmp_path / name
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")
    return str(path)


def test_lever_postings(spark, tmp_path):
    good, _ = landed.split_malformed(landed.read_lever(spark, landing(tmp_path, [LEVER_JOB])))
    postings = adapters.normalise_landed(good, lever.ATS, "Acme L", STAMP)
    row = postings.first()
    assert row["posting_date"] == "2023-11-14T22:13:20Z" and row["ats"] == "Lever"
    assert row["all_locations"] == ["Lisbon, Portugal"] and row["salary_range"]["currency"] == "NOK"
    assert row["department"] == "" and row["workplace_type"] == "hybrid"
    validate_batch(postings)


def test_lever_fallbacks(spark, tmp_path):
    job = {**LEVER_JOB, "descriptionPlain": " ", "description": "<p>Rich</p>",
           "categories": {"location": "", "allLocations": ["A", "", None, " B "]}, "salaryRange": None}
    row = lever.normalise(landed.read_lever(spark, landing(tmp_path, [job])), "Acme L", STAMP).first()
    assert (row["location"], row["description"], row["salary_range"]) == ("A, B", "Rich", None)


def test_malformed_payload_is_kept_apart(spark, tmp_path):
    good, bad = landed.split_malformed(landed.read_lever(spark, landing(tmp_path, '[{"id": "1"}, 5]')).cache())
    assert bad.count() >= 1


def test_greenhouse_postings(spark, tmp_path):
    envelope = {"jobs": [GREENHOUSE_JOB], "meta": {"total": 1}}
    raw = landed.read_greenhouse(spark, landing(tmp_path, envelope))
    assert greenhouse.wrong_totals(raw).isEmpty()
    postings = adapters.normalise_landed(raw, greenhouse.ATS, "Acme G", STAMP)
    row = postings.first()
    assert row["workplace_type"] == "remote" and row["description"] == "Keep all signals green."
    assert row["posting_date"] == "2025-02-03T07:30:00Z" and row["job_id"] == "9001"
    assert (row["team"], row["department"], row["offices"]) == ("Operations", "Operations", ["Remote"])
    validate_batch(postings)


def test_odd_jobs_are_set_apart_with_their_place(spark, tmp_path):
    second = {**GREENHOUSE_JOB, "id": 9002, "departments": ["x", {"name": "E"}, {"name": 5}], "location": "nowhere"}
    envelope = {"jobs": [GREENHOUSE_JOB, "odd", second, None], "meta": {"total": 4}}
    raw = landed.read_greenhouse(spark, landing(tmp_path, envelope))
    good, bad = landed.split_malformed(raw)
    assert bad.isEmpty() and greenhouse.wrong_totals(good).isEmpty()
    rows = adapters.normalise_landed(good, greenhouse.ATS, "Acme G", STAMP).collect()
    assert sorted((r["job_id"], r["department"], r["location"]) for r in rows) == [("9001", "Operations", "Turku or Remote"), ("9002", "E, 5", "")]
    assert sorted(tuple(r) for r in variants.odd_items(good).collect()) == [(1, '"odd"'), (3, "null")]
    assert [r["ordinal"] for r in greenhouse.explode_postings(good).orderBy("ordinal").collect()] == [0, 2]


@pytest.mark.parametrize("payload", [{"meta": {"total": 2}}, {"jobs": 7}, {"jobs": None}, [1], 5, "not json"])
def test_envelopes_without_a_list_are_set_apart(spark, tmp_path, payload):
    text = payload if payload == "not json" else json.dumps(payload)
    good, bad = landed.split_malformed(landed.read_greenhouse(spark, landing(tmp_path, text)))
    assert good.isEmpty() and bad.count() == 1


def test_a_null_list_holds_no_jobs(spark):
    envelope = spark.createDataFrame([(None, (3,))], schemas.GREENHOUSE_RAW)
    assert [tuple(r) for r in greenhouse.wrong_totals(envelope).collect()] == [(3, 0)]


def test_odd_summaries_and_details(spark, tmp_path):
    page = {"offset": 0, "content": [{"id": "a"}, 7, {"id": {"x": 1}}, {"id": "b"}], "totalFound": 4}
    pages = landed.read_smartrecruiters_pages(spark, landing(tmp_path, page))
    good, _ = landed.split_malformed(pages)
    assert sorted((r["ordinal"], r["id"]) for r in smartrecruiters.page_summaries(good).collect()) == [(0, "a"), (2, '{"x":1}'), (3, "b")]
    assert [tuple(r) for r in variants.odd_items(good).collect()] == [(1, "7")]
    odd = {**SMART_JOB, "location": {"city": "Bergen", "hybrid": "maybe"}, "function": "Planning", "jobAd": {"sections": {"jobDescription": ["x"], "qualifications": {"text": "Rope"}}}}
    row = adapters.normalise_landed(landed.read_smartrecruiters_details(spark, landing(tmp_path, odd)), smartrecruiters.ATS, "Acme S", STAMP).first()
    assert (row["location"], row["workplace_type"], row["function"], row["description"]) == ("Bergen", "onsite", "", "Rope")
    good, bad = landed.split_malformed(landed.read_smartrecruiters_details(spark, landing(tmp_path, "[5, 6]")))
    assert good.isEmpty() and sorted(r[0] for r in bad.collect()) == ["5", "6"]


def test_greenhouse_total_mismatch(spark, tmp_path):
    envelope = {"jobs": [GREENHOUSE_JOB], "meta": {"total": 7}}
    wrong = greenhouse.wrong_totals(landed.read_greenhouse(spark, landing(tmp_path, envelope))).collect()
    assert [(row["declared"], row["held"]) for row in wrong] == [(7, 1)]


def test_smartrecruiters_postings(spark, tmp_path):
    raw = landed.read_smartrecruiters_details(spark, landing(tmp_path, SMART_JOB))
    postings = adapters.normalise_landed(raw, smartrecruiters.ATS, "Acme S", STAMP)
    row = postings.first()
    assert row["workplace_type"] == "hybrid" and row["posting_date"] == "2025-03-04T05:06:07Z"
    assert row["description"] == "The work\nPlan the ferries.\n\nYou bring\nSea legs"
    assert (row["location"], row["source_url"]) == ("Bergen, no", "https://sr.example/sr-5")
    validate_batch(postings)


@pytest.mark.parametrize("pages, limit, expected", [
    ([(0, ["1", "2"], 3), (2, ["3"], 3)], 10, ["1", "2", "3"]),
    ([(0, ["1", "2"], 20), (2, ["3"], 20)], 3, ["1", "2", "3"]),
    ([(0, ["1", "2"], 20), (2, [], 20), (4, ["9"], 20)], 10, ["1", "2"]),
    ([(0, ["1", "2"], 2), (2, ["3"], 2)], 10, ["1", "2"]),
])
def test_page_stop_rules(spark, pages, limit, expected):
    rows = [(offset, [(i,) for i in ids], total) for offset, ids, total in pages]
    summaries = smartrecruiters.page_summaries(spark.createDataFrame(rows, schemas.SMARTRECRUITERS_PAGE), limit)
    assert [row["id"] for row in summaries.orderBy("ordinal").collect()] == expected


def test_page_limit_and_blank_ids(spark):
    pages = spark.createDataFrame([(0, [("1",), (" ",)], 2)], schemas.SMARTRECRUITERS_PAGE)
    with pytest.raises(ValueError):
        smartrecruiters.page_summaries(pages, 0)
    assert smartrecruiters.blank_summaries(smartrecruiters.page_summaries(pages, 5)).count() == 1


def test_details_keep_summary_order(spark):
    summaries = spark.createDataFrame([(0, "b"), (1, "a")], "ordinal bigint, id string")
    details = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    rows = smartrecruiters.details_in_order(summaries, details).orderBy("ordinal").collect()
    assert [row["n"] for row in rows] == [2, 1]


def test_union_fills_missing_columns(spark, tmp_path):
    first = adapters.normalise_landed(landed.read_lever(spark, landing(tmp_path, [LEVER_JOB])), lever.ATS, "Acme L", STAMP)
    second = adapters.normalise_landed(
        landed.read_smartrecruiters_details(spark, landing(tmp_path, SMART_JOB, "s.json")), smartrecruiters.ATS, "Acme S", STAMP)
    both = adapters.union_sources(first, second)
    assert both.count() == 2 and both.filter("ats = 'Lever' AND experience_level IS NULL").count() == 1
    assert set(REQUIRED_FIELDS) <= set(both.columns)


def test_a_new_source_touches_no_other(spark):
    adapter = adapters.Adapter("id STRING", lambda raw: raw, lambda raw, company, stamp: raw.withColumn("company", F.lit(company)))
    adapters.register_adapter("Ashby", adapter)
    try:
        rows = adapters.normalise_landed(spark.createDataFrame([("1",)], "id string"), "Ashby", "X", STAMP)
        assert rows.first()["company"] == "X"
        with pytest.raises(ValueError):
            adapters.register_adapter("Ashby", adapter)
    finally:
        del adapters.ADAPTERS["Ashby"]


def test_posting_dataset_checks(spark, tmp_path):
    with pytest.raises(ValueError, match="no postings"):
        landed.read_postings(spark, landing(tmp_path, []))
    whole = {"job_id": 5, "company": "x", "job_title": "t", "location": "", "source_url": "u", "posting_date": None}
    with pytest.raises(ValueError, match=r"missing columns: \['description'\]"):
        landed.read_postings(spark, landing(tmp_path, [whole]))
    # A column is held if any record has it.
    rows = landed.read_postings(spark, landing(tmp_path, [whole, {"job_id": "6", "description": "d"}])).collect()
    assert [(r["job_id"], r["company"], r["description"]) for r in rows] == [("5", "x", None), ("6", None, "d")]
    with pytest.raises(ValueError, match="1 records"):
        landed.read_postings(spark, landing(tmp_path, [whole, "odd"]))


def test_salary_reference_lines(spark):
    lines = [(0, "| Perception Engineer | <b>$180,000</b> | USD |"), (1, "Planning &amp; Control $150,000 - $170,000"),
             (2, "no pay"), (3, " | | "), (4, "| Lone $99,000 |")]
    rows = landed.salary_reference(spark.createDataFrame(lines, "ordinal int, value string")).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["title_text"], r["salary_min"], r["salary_max"]) for r in rows] == [
        (0, "Perception Engineer", 180000, 180000), (1, "Planning & Control $150,000 - $170,000", 150000, 170000),
        (4, "| Lone $99,000 |", 99000, 99000)]


def test_responses_scan(spark, tmp_path):
    path = landing(tmp_path, '{"job_id": "1", "source_response": "response", "content": "{}"}')
    assert landed.read_responses(spark, path).first()["content"] == "{}"


def test_register_full_refresh(spark, tmp_path):
    for _ in range(2):
        register = sinks.load_register(spark, str(tmp_path))
    assert register.count() == len(REGISTER_ROWS) == 41
    assert register.select("name").distinct().count() == 41
    platforms = register.select(landed.source_platform("career_page_url", {"greenhouse.io": "Greenhouse", "lever.co": "Lever"}).alias("p"))
    assert platforms.filter("p = 'Greenhouse'").count() == 11 and platforms.filter("p = 'Lever'").count() == 1


def test_record_sink_replaces_whole_output(spark, tmp_path):
    path = str(tmp_path / "jobs")
    sinks.write_records(spark.createDataFrame([("Ingénieur", None)], "title string, note string"), path)
    sinks.write_records(spark.createDataFrame([("Développeur", None)], "title string, note string"), path)
    assert [row["title"] for row in spark.read.json(path).collect()] == ["Développeur"]
    texts = [row["value"] for row in spark.read.text(path).collect()]
    assert texts == ['{"title":"Développeur","note":null}']
    assert {p.name for p in tmp_path.iterdir()} == {"jobs"}


def test_failed_write_keeps_previous_output(spark, tmp_path):
    path = str(tmp_path / "jobs")
    sinks.write_records(spark.createDataFrame([("old",)], "title string"), path)
    broken = spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("title"))
    with pytest.raises(Exception, match="boom"):
        sinks.write_records(broken, path)
    assert spark.read.json(path).first()["title"] == "old"


def test_result_sink_skips_empty(spark, tmp_path):
    path = str(tmp_path / "results")
    assert sinks.write_results(spark.createDataFrame([], "a string"), path) is False
    assert not (tmp_path / "results").exists()
    assert sinks.write_results(spark.createDataFrame([("x",)], "a string"), path) is True


def test_silver_and_gold_round_trip(spark, tmp_path):
    root = str(tmp_path)
    sinks.write_silver(spark.createDataFrame([("1", "C++", "tool")], "skill_id string, skill_name string, skill_type string"), "skill", root)
    assert sinks.read_silver(spark, "skill", root).first()["skill_name"] == "C++"
    ddl = "snapshot_id string, scrape_id string, category_id string, company_id string, is_total boolean, job_count bigint, snapshot_date string"
    for count in (5, 6):
        for day in ("2026-01-01", "2026-02-01") if count == 5 else ("2026-02-01",):
            sinks.write_trend_snapshot(spark.createDataFrame([("s", "r", "c", None, False, count, day)], ddl), root)
    rows = sinks.read_trend_snapshots(spark, root).orderBy("snapshot_date").collect()
    assert [row["job_count"] for row in rows] == [5, 6]


def test_a_stopped_write_leaves_a_complete_copy(spark, tmp_path):
    path = tmp_path / "records"
    sinks.write_records(spark.createDataFrame([("old",)], "a string"), str(path))
    path.rename(tmp_path / "records.old")  # where a run stops between its two renames

    def failing():
        sinks._swapped_in(spark, str(path), lambda staged: (_ for _ in ()).throw(OSError("disk full")))

    with pytest.raises(OSError):
        failing()
    assert spark.read.json(str(path)).first()["a"] == "old"
    sinks.write_records(spark.createDataFrame([("new",)], "a string"), str(path))
    assert spark.read.json(str(path)).first()["a"] == "new" and not (tmp_path / "records.old").exists()


def test_silver_postings_can_be_written(spark, tmp_path):
    post = spark.createDataFrame([("W", "Engineer", "Perth", "text", "2026-08-01T10:00:00Z", "2026-08-11T01:00:00Z", "https://x/1", "Lever", {"min": "1"})],
        "company string, job_title string, location string, description string, posting_date string, collected_at string, source_url string, ats string, salary_range map<string,string>")
    post = post.selectExpr("*", "'' AS department", "'' AS commitment")
    silver = maintenance.silver_postings(post, spark.createDataFrame([("c-1", "W")], "company_id string, name string"))
    sinks.write_silver(silver, "job_posting", str(tmp_path))
    row = sinks.read_silver(spark, "job_posting", str(tmp_path)).first()
    assert row["company_id"] == "c-1" and row["extraction_confidence"] == 0.6667


def test_log_appends(spark, tmp_path):
    ddl = "scrape_id string, company_id string, scrape_date string, jobs_found int, status string, error_message string"
    for status in ("success", "failed"):
        sinks.append_log(spark.createDataFrame([("1", "c", "2026-01-01", 3, status, None)], ddl), str(tmp_path))
    assert sinks.read_silver(spark, "scrape_log", str(tmp_path)).count() == 2


def test_source_register_has_every_company(spark, tmp_path):
    sources = sinks.load_source_register(spark, str(tmp_path))
    assert sources.count() == 41 and sources.filter("source_class IS NULL").isEmpty()
    assert sources.filter("source_class = 'published API' AND source_platform = 'Custom site'").isEmpty()
