"""Dictionaries as tables, pages, calendar growth, hot title tokens and collection runs."""
from __future__ import annotations

import datetime
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hirelens.functions.skills import extract_skills, framed_term, word_text
from hirelens.operators import aggregates, classify, joins, search, terms
from hirelens.plans.collection import collect_run
from hirelens.sources import adapters, landed, lever


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def dictionary(spark):
    def make(n):
        rng = random.Random(n)
        names = sorted({" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 4))) for _ in range(n)})
        return spark.createDataFrame(pa.table({"category": [f"c{i % 7}" for i in range(len(names))], "term": names})), names

    return make


def test_ten_thousand_terms_equal_whole_word_search(spark, dictionary):
    table, names = dictionary(10_000)
    rng = random.Random(1)
    texts = [(i, " ".join(f"W{rng.randrange(400)}" + rng.choice(["", ",", "-", "\n"]) for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(40)] + [(40, None), (41, "w1 " * 5000)]
    rows = spark.createDataFrame(texts, "id int, text string")
    got: dict[int, set] = {}
    for r in terms.found_terms(rows, "id", F.col("text"), table).collect():
        assert r["term"] not in got.setdefault(r["id"], set())
        got[r["id"]].add(r["term"])
    framed = {r["id"]: r["w"] for r in rows.select("id", word_text("text").alias("w")).collect()}
    assert got == {i: held for i, w in framed.items() if w and (held := {n for n in names if framed_term(n) in w})}


def test_the_plan_does_not_grow_with_the_dictionary(spark, dictionary):
    rows = spark.createDataFrame([(1, "w1 w2")], "id int, text string")
    plans = [plan_of(classify.labels_of(rows, ["text"], "id", dictionary(n)[0])).count("\n") for n in (20, 10_000)]
    assert plans[0] == plans[1]


def test_names_by_table_equal_names_by_column(spark):
    names = ["Node.js", "CI/CD", "C", "R", "C++", "C#", "ROS 2", "Python", "object detection"]
    texts = ["Uses C++ and python; ros 2.", "C, C#, vitamin c", "R&D and C-suite", "Node.js / CI/CD; Object-detection", "", None, "C R Python C"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    by_table = {r["id"]: r["skills"] for r in terms.name_lists(rows, "id", "text", names).collect()}
    by_column = {r["id"]: r["s"] or [] for r in rows.select("id", extract_skills("text", names).alias("s")).collect()}
    assert by_table == by_column


def test_conflicts(spark):
    rows = spark.createDataFrame([(1, "perception planning", None), (2, "perception", "Planning"), (3, "perception", "Perception"), (4, "x", "Planning")], "id int, text string, dept string")
    judged = classify.with_verdict(classify.classify(rows, ["text"], "id"), stated=F.col("dept"))
    assert {r["id"]: r["review_status"] for r in judged.collect()} == {1: "conflicting", 2: "conflicting", 3: "automatic", 4: "uncertain"}


@pytest.mark.parametrize("order", [["a", "id"], ["-a", "id"], ["-s", "-a", "id"], ["s", "id"]])
def test_pages_equal_a_sort(spark, order):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 1.5, 7.0, rng.random() * 50]), rng.choice([None, "", "é", "x" * rng.randrange(4), f"n{rng.randrange(90)}"])) for i in range(3000)]
    table = spark.createDataFrame(rows, "id int, a double, s string")
    whole = sorted(rows, key=lambda r: r[0])
    for key in reversed(order[:-1]):
        at = 1 if key.endswith("a") else 2
        present, absent = [r for r in whole if r[at] is not None], [r for r in whole if r[at] is None]
        whole = sorted(present, key=lambda r: r[at].encode() if at == 2 else r[at], reverse=key.startswith("-")) + absent
    for number in (1, 2, 117, 213, 214, 10_000):
        got = [tuple(r) for r in search.page(table, order, number, 14, sample=60).collect()]
        start = (min(number, 215) - 1) * 14
        assert got == whole[start : start + 14]


def test_a_page_of_ties_and_of_nothing(spark):
    same = spark.range(500).selectExpr("1 AS a")
    assert search.page(same, ["a"], 3, 20, sample=10).count() == 20
    assert search.page(same.limit(0), ["a"], 3, 20, sample=10).count() == 0


def test_the_last_page_reads_its_range_only(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS k", "id % 7 AS v").write.parquet(str(tmp_path / "t"))
    plan = search.page(spark.read.parquet(str(tmp_path / "t")), ["k"], 10**6, 10, sample=200)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k," in plan


def test_growth_sees_empty_periods(spark):
    def dated(group, month, n):
        return [(group, datetime.date(2024, month, 1 + k % 28)) for k in range(n)]

    rows = dated("a", 1, 12) + dated("a", 3, 20) + dated("b", 2, 3) + dated("c", 1, 10) + dated("c", 2, 10) + dated("c", 5, 1) + [("a", None)] + dated(None, 4, 15) + dated(None, 5, 15)
    table = spark.createDataFrame(rows, "g string, d date")
    got = {(r["g"], r["period"] and r["period"].month): (r["n"], r["previous"], r["change"], r["direction"], r["state"]) for r in aggregates.growth(table, ["g"], "d", "month").collect()}
    assert got == {
        ("a", 1): (12, None, None, None, "trend"), ("a", 2): (0, 12, -1.0, "down", "trend"), ("a", 3): (20, 0, None, "up", "trend"),
        ("a", 4): (0, 20, -1.0, "down", "trend"), ("a", 5): (0, 0, None, "flat", "trend"), ("b", None): (None, None, None, None, "insufficient_data"),
        ("c", 1): (10, None, None, None, "trend"), ("c", 2): (10, 10, 0.0, "flat", "trend"), ("c", 3): (0, 10, -1.0, "down", "trend"),
        ("c", 4): (0, 0, None, "flat", "trend"), ("c", 5): (1, 0, None, "up", "trend"),
        (None, 4): (15, None, None, None, "trend"), (None, 5): (15, 15, 0.0, "flat", "trend"),
    }


def test_one_token_in_every_title(spark, monkeypatch):
    monkeypatch.setattr(joins, "LANE_ROWS", 50)
    rng = random.Random(3)
    words = [f"tok{i}" for i in range(60)]
    titles = sorted({f"common {rng.choice(words)} {rng.choice(words)}{rng.randrange(3)}" for _ in range(150)}) + ["common", "uncommon tok1"]
    entries = [(n, f"Common {rng.choice(words)} {rng.choice(words)}") for n in range(60)] + [(60, "common"), (61, "ab common"), (62, "tok1")]
    got = joins.best_title_match(spark.createDataFrame([(t,) for t in titles], "title string"), "title", spark.createDataFrame(entries, "ordinal int, title_text string"))

    def best(title):
        own = set(title.split())
        scored = [(len(own & {w for w in e.lower().split() if len(w) > 2}), n, e.lower()) for n, e in entries]
        ranked = max(((o + (e in title or title in e), -n) for o, n, e in scored if o), default=(0, 0))
        return (ranked[0], -ranked[1]) if ranked[0] >= 2 else None

    expected = {t: b for t in titles if (b := best(t))}
    assert {r["title_key"]: (r["score"], r["entry_ordinal"]) for r in got.collect()} == expected


def test_a_narrow_select_reads_no_text(spark, tmp_path):
    spark.createDataFrame([("1", "t", "<p>x</p>")], "id string, text string, description string").selectExpr(
        "*", "0L AS createdAt", "'' AS country", "'' AS workplaceType", "named_struct('location', 'P', 'allLocations', array('P'), 'team', '', 'department', '', 'commitment', '') AS categories",
        "'' AS descriptionPlain", "'u' AS hostedUrl", "'u' AS applyUrl", "CAST(NULL AS MAP<STRING, STRING>) AS salaryRange",
    ).drop("text").withColumn("text", F.lit("t")).write.parquet(str(tmp_path / "raw"))
    postings = lever.normalise(spark.read.parquet(str(tmp_path / "raw")), "Acme", "2026-01-01T00:00:00Z")
    narrow, wide = (p._jdf.queryExecution().executedPlan().toString() for p in (postings.select("job_id", "location"), postings))
    scan = next(line for line in narrow.splitlines() if "ReadSchema" in line)
    assert "description:" not in scan and "description:" in next(line for line in wide.splitlines() if "ReadSchema" in line)
    assert narrow.count("ArrowEvalPython") < wide.count("ArrowEvalPython")


def board(*ids):
    return [{"id": i, "title": "T", "location": {"name": "L"}, "content": "d", "first_published": "2025-01-01T00:00:00Z", "absolute_url": f"u{i}"} for i in ids]


def test_a_broken_source_stops_no_other(spark, tmp_path):
    def put(ats, company, payload):
        folder = tmp_path / f"ats={ats}" / f"company={company}" / "run=r1"
        folder.mkdir(parents=True)
        (folder / "drop.json").write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")

    whole = {"id": "1", "text": "T", "categories": {"location": "L"}, "descriptionPlain": "d", "createdAt": 1_700_000_000_000, "hostedUrl": "u"}
    put("Greenhouse", "A", {"jobs": board(1, 2), "meta": {"total": 2}})
    put("Greenhouse", "B", {"jobs": [*board(1), "x"], "meta": {"total": 2}})
    put("Greenhouse", "C", {"jobs": board(1), "meta": {"total": 4}})
    put("Greenhouse", "D", "{broken")
    put("Lever", "E", [whole, {**whole, "id": "2"}, whole])
    put("Lever", "F", [whole, {"id": "2", "text": "T"}])
    put("Lever", "G", [whole])
    put("Lever", "unlisted", [whole])
    expected = spark.createDataFrame([(c, "Greenhouse" if c < "E" else "Lever") for c in "ABCDEFGH"], "company string, ats string")
    postings, log = collect_run(spark, str(tmp_path), expected, "r1", "2026-01-02T00:00:00Z")
    assert sorted((r["company"], r["run"], r["ordinal"], r["job_id"]) for r in postings.collect()) == [("A", "r1", 0, "1"), ("A", "r1", 1, "2"), ("G", "r1", 0, "1")]
    assert {r["company_id"]: (r["status"], r["jobs_found"], r["error_message"]) for r in log.collect()} == {
        "A": ("success", 2, None), "B": ("failed", 0, "item 2 is no object"), "C": ("failed", 0, "4 postings declared, 1 held"),
        "D": ("failed", 0, "not the payload that was expected: {broken"), "E": ("failed", 0, "duplicate job id: 1"),
        "F": ("failed", 0, "posting 2 is missing: location, description, posting_date, source_url"), "G": ("success", 1, None),
        "H": ("failed", 0, "the source returned no postings"),
    }
    assert log.select("scrape_id").distinct().count() == 8


def test_order_of_a_landing_is_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": str(9 - i)} for i in range(5)]), encoding="utf-8")
    raw = landed.read_lever(spark, str(tmp_path / "a.json"))
    rows = adapters.ADAPTERS["Lever"].normalise(raw.drop("_corrupt_record"), "Acme", "2026-01-01T00:00:00Z", ("ordinal",)).orderBy("ordinal").collect()
    assert [r["job_id"] for r in rows] == ["9", "8", "7", "6", "5"]
