"""Entities cut before their semicolon, as in the titles of pages: the queries read them as their SQL does."""

import duckdb
import pytest

import __spark_entry__
from hirelens.functions import text
from hirelens.functions.markup import markup_text

TITLES = ["a &quot", "a &amp", "a &amp;", "a &quot;", "a &copy", "a &middot", "a &am", "a &quo", "R&D", "&quot;b&quot", "&"]
PAGES = [(i, f"<html><head><title>{t}</title><script>var t;</script></head><body><p>{t}</p>x &copy; y</body></html>") for i, t in enumerate(TITLES)]


@pytest.mark.parametrize("name", ["html_to_text", "html_to_text_no_script"])
def test_cut_entities_are_read_as_in_sql(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = duck.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    found = __spark_entry__.queries()[name](spark, str(tmp_path)).select("page_id", "plain").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_by_default_entities_are_read_as_html_does(one):
    assert one(text.clean_text("t"), "&copy &quot") == '© "'
    assert markup_text("<p>a &quot</p>b", False) == '\na "\nb'
    assert markup_text("<p>a &quot</p>b &amp c &lt;i> &#34 &notin; &notit;", False, ("amp",)) == '\na &quot\nb & c  " ∉ &notit;'
    assert markup_text("&qu<b>ot;</b>", False, ("amp",)) == '"'
