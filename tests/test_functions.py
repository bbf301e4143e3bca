from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hirelens.functions import dates, labels, responses, salary, skills, text, titles


@pytest.mark.parametrize("raw, expected", [
    (None, ""),
    ("", ""),
    ("  a \t b  ", "a b"),
    ("a\r\n\r\n  b\rc", "a\nb\nc"),
    ("R&amp;D &lt;x&gt;", "R&D <x>"),
    ("caf&eacute; &#233; &copy", "café é ©"),
    (" x y ", "x y"),
    ("a\x1cb\x85c d", "a\nb\nc\nd"),
    ("a &amp;amp; b", "a &amp; b"),
    ("😀  ok", "😀 ok"),
])
def test_clean_text(spark, one, raw, expected):
    assert one(text.clean_text("t"), raw) == expected
    table = spark.createDataFrame([(raw, "x ")], "t string, u string")
    row = text.cleaned(table, {"t2": "t", "u2": "u"}).first()
    assert (row["t2"], row["u2"]) == (expected, "x")


@pytest.mark.parametrize("raw, expected", [
    ("&amp;lt;p&amp;gt;Build &amp;lt;strong&amp;gt;safe&amp;lt;/strong&amp;gt; software.&amp;lt;/p&amp;gt;", "Build safe software."),
    ("<ul><li>one<li>two</ul>", "one\ntwo"),
    ("a<br/>b<BR>c", "a\nb\nc"),
    ("x &lt;b&gt; y", "x y"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<!-- gone --><p title=\"a>b\">kept</p>", "kept"),
    ("<a href='q'>link</a> &eacute;", "link é"),
    (None, ""),
])
def test_html_text(spark, raw, expected):
    table = spark.createDataFrame([(raw,)], "h string")
    assert text.html_texts(table, {"plain": "h"}).first()["plain"] == expected


def test_script_content_is_kept_unless_dropped(spark):
    table = spark.createDataFrame([("<p>a</p><script>var t='</p>';</script>",)], "h string")
    assert text.html_texts(table, {"plain": "h"}).first()["plain"] == "a\nvar t='</p>';"
    assert text.html_texts(table, {"plain": "h"}, drop_script=True).first()["plain"] == "a"


def test_jvm_and_python_readings_of_markup_agree(spark):
    from hirelens.functions.markup import markup_text

    pieces = ["<p>", "</p>", "<b>", "<br />", "&lt;li&gt;", "&amp;amp;", "&nbsp;", " x ", "&#39;", "AT&T", "<", "&copy;"]
    rows = [(a + b + c,) for a in pieces for b in pieces for c in pieces]
    table = spark.createDataFrame(rows, "h string")
    got = text.html_texts(table, {"plain": "h"}).select("h", "plain").collect()
    tidy = spark.createDataFrame([(row["h"], markup_text(row["h"], False)) for row in got], "h string, m string")
    expected = dict(tidy.select("h", text.tidy_lines("m").alias("m")).collect())
    assert {row["h"]: row["plain"] for row in got} == expected


def test_strip_tags_decodes_after_stripping(one):
    assert one(text.strip_tags("t"), "<b>x</b>&lt;i&gt;  y") == "x <i> y"


@pytest.mark.parametrize("raw, expected", [
    ("2026-08-10T01:02:03.000Z", "2026-08-10T01:02:03Z"),
    ("2026-08-01T10:00:00-04:00", "2026-08-01T14:00:00Z"),
    ("2026-08-10T01:02:03z", "2026-08-10T01:02:03Z"),
    ("2026-08-10T01:02:03", "2026-08-10T01:02:03Z"),
    ("2026-08-10 01:02:03,75+0530", "2026-08-09T19:32:03Z"),
    ("20260810", "2026-08-10T00:00:00Z"),
    ("2026-W32-1", "2026-08-03T00:00:00Z"),
    ("2026-08-10T01:02:03+18:30", "2026-08-09T06:32:03Z"),
    ("not-a-date", ""), ("2026", ""), ("2026-02-30", ""), ("2026-08-10T25:00:00", ""), ("  ", ""), (None, ""),
])
def test_iso_timestamps(spark, one, raw, expected):
    assert one(dates.iso_to_utc_text("t"), raw) == expected
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Australia/Perth")
        assert one(dates.iso_to_utc_text("t"), raw) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_epoch_timestamps(one):
    millis = one(dates.epoch_to_utc_text("t", milliseconds=True), 1_720_000_000_000, "t bigint")
    assert millis == "2024-07-03T09:46:40Z"
    assert one(dates.epoch_to_utc_text("t"), -1, "t bigint") == "1969-12-31T23:59:59Z"
    assert one(dates.epoch_to_utc_text("t"), 10**15, "t bigint") == ""
    assert one(dates.epoch_to_utc_text("t"), None, "t bigint") == ""


RANGES = [
    ("$150,000 – $220,000 USD", "onboard", (150000.0, 220000.0, "USD", "year")),
    ("$32.00–$37.00/hr", "onboard", (32.0, 37.0, "USD", "hour")),
    ("$32 - $3700", "onboard", (32.0, 370.0, "USD", "year")),
    ("$32 - $3700", "onboard_strict", (None, None, None, None)),
    ("€60,000 to €90,000 eur", "mobility", (60000.0, 90000.0, "EUR", "year")),
    ("£45,000.50—£50,000 per Hour", "research", (45000.5, 50000.0, "GBP", "hour")),
    ("$32.00–$37.00/hr", "mobility", (None, None, None, None)),
    ("$9,500 - $9,900", "mobility", (None, None, None, None)),
    (None, "mobility", (None, None, None, None)),
]


@pytest.mark.parametrize("raw, reading, expected", RANGES)
def test_salary_ranges(spark, raw, reading, expected):
    row = salary.with_salary_range(spark.createDataFrame([(raw,)], "t string"), "t", reading).first()
    assert (row["salary_min"], row["salary_max"], row["salary_currency"], row["salary_period"]) == expected
    assert row["salary_source"] == ("job_post" if expected[0] else None)


def test_snippet_counts_characters_not_units(spark):
    raw = "x" * 100 + "😀" + " Pay $150,000 - $160,000\n\n" + "y" * 200
    row = salary.with_salary_range(spark.createDataFrame([(raw,)], "t string"), "t", "mobility").first()
    start, end = raw.index("$150"), raw.index("\n\n")
    assert row["salary_snippet"] == " ".join(raw[start - 60:end + 80].split())


@pytest.mark.parametrize("raw, expected", [
    ("$90,000 base, up to $120,000 CAD", (120000, 120000, "CAD")),
    ("€60,000 to €90,000", (60000, 60000, "EUR")),
    ("$150,000 - $160,000", (150000, 160000, "USD")),
    ("$9,500", (None, None, None)), ("$1,250,000", (None, None, None)), (None, (None, None, None)),
])
def test_any_amount(spark, raw, expected):
    row = salary.with_any_salary(spark.createDataFrame([(raw,)], "t string"), "t").first()
    assert (row["salary_min"], row["salary_max"], row["salary_currency"]) == expected


def test_titles(one):
    assert one(titles.title_relevant("t", "broad"), "Senior maintenance") is True
    assert one(titles.title_relevant("t", "research"), "Senior maintenance") is False
    assert one(titles.title_relevant("t", "research"), "ML, éml") is True
    assert one(titles.title_relevant("t", "research"), "éml") is False
    assert one(titles.title_relevant("t", "mobility"), None) is False
    assert one(titles.title_relevant("t", "mobility"), "Model based design") is True
    assert one(F.array_sort(text.title_tokens("t")), "Senior ML Engineer, Perception (perception) Lead") == ["perception"]


def test_slugs_labels_and_places(one):
    assert one(text.slugify("t"), " --A b&c! ") == "a-b-c"
    assert one(text.slugify("t"), "C++ Engineer") == "c-engineer"
    assert one(text.url_base("t"), "https://x/y?a=1?b") == "https://x/y"
    assert one(labels.long_date(F.col("t").cast("date")), "2026-07-08") == "July 8, 2026"
    assert one(labels.placeholder("t"), "") == "N/A"
    place = one(skills.location_parts("t"), "Pittsburgh, PA, USA")
    assert (place["city"], place["region"], place["country"]) == ("Pittsburgh", "PA", "USA")
    assert one(skills.location_parts("t"), "Remote")["country"] == "Remote"


def test_skills_stay_distinct(one):
    names = ["C", "C++", "C#", "Python", "ROS 2"]
    assert one(skills.extract_skills("t", names), "Uses C++ and python; ros 2.") == ["C++", "Python", "ROS 2"]
    assert one(skills.extract_skills("t", names), "C, C#, vitamin c") == ["C", "C#"]
    assert one(skills.normalise_skills(F.split("t", ",")), "ros2,ROS 2,lidar,Go") == ["ROS 2", "LiDAR", "Go"]


def test_seniority(one):
    assert one(skills.seniority("t"), "Sr. Engineer") == "Senior"
    assert one(skills.seniority("t"), "Internal tools engineer") == "Mid"
    assert one(skills.seniority("t"), "Software Intern") == "Internship"
    assert one(skills.seniority("t", F.lit("Director")), "Intern") == "Director"


BODY = '{"company":"a","title":"b","career_page_url":"c","role_profile":"d","skills":["x"],"functional_area":"e"}'


@pytest.mark.parametrize("raw, error", [
    (BODY, None),
    (f"```json\n{BODY}\n```", None),
    (f"```{BODY}```", None),
    (f"Sure: {BODY} bye", None),
    ("[1]", "not an object"),
    ("nope", "not JSON"),
    (None, "not JSON"),
    ('{"company": null}', "missing fields: career_page_url, functional_area, role_profile, skills, title"),
    (BODY.replace('["x"]', '"x"'), "skills is no list"),
])
def test_responses(spark, raw, error):
    row = responses.with_parsed(spark.createDataFrame([(raw,)], "content string")).select(
        responses.response_error("parsed").alias("error"), responses.response_text("parsed", "title").alias("title"),
    ).first()
    assert row["error"] == error
    if error is None:
        assert row["title"] == "b"


def test_personal_data(one):
    assert one(text.redact_personal("t"), "ask a.b@x.com or +1 412 555 0123 now") == "ask [email] or [phone] now"
    assert one(text.redact_personal("t"), "built in 2024 for 1000 users") == "built in 2024 for 1000 users"


@pytest.mark.parametrize("raw, reading, expected", [
    ("Pay: $150,000 &ndash; $160,000", "mobility", (150000.0, 160000.0)),
    ("$32 - $3700 or $32 - $370", "onboard_strict", (32.0, 370.0)),
    ("$32 - $3700 or $32 - $370, all told", "onboard_strict", (32.0, 370.0)),
])
def test_salary_reads_decoded_text_at_the_place_of_the_match(spark, raw, reading, expected):
    row = salary.with_salary_range(spark.createDataFrame([(raw,)], "t string"), "t", reading).first()
    assert (row["salary_min"], row["salary_max"]) == expected and "$" in row["salary_snippet"]


@pytest.mark.parametrize("text, found", [
    ("Node.js, CI/CD and more.", ["Node.js", "CI/CD"]), ("We do R&D", []), ("The C-suite; Objective-C", []), ("C, R.", ["C", "R"]), ("C/C++ work", ["C++"]), ("in c", []),
])
def test_skill_names_with_marks(one, text, found):
    assert one(skills.extract_skills("t", ["Node.js", "CI/CD", "C", "R", "C++"]), text) == found
