"""Registered queries against their SQL, and the pipeline stage by stage."""
from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, row_bag
from hirelens.llm import jaccard
from hirelens.llm.catalog import ORACLES, QUERIES
from hirelens.llm.work import table

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no shared tables here")


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_matches_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    if name in ORACLES:
        duck = duckdb.connect()
        for t in TABLES:
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        result = duck.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert row_bag(frame.columns, rows) == row_bag(names, result.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@needs_tables
def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, FOLDER, "documents")
    names = docs.columns
    total = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == names
        docs = docs.cache()
        left = docs.count()
        assert 0.4 * total < left <= total
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert set(names) < set(last.columns) and 0 < last.count() <= left


def test_stages_take_odd_and_empty_tables(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert set(docs.columns) <= set(out.columns), name
            assert out.count() <= docs.count(), name


def test_one_document_of_each_group_stays(spark, documents, prose):
    texts = {1: prose(1, 80), 2: prose(1, 80), 3: prose(1, 80) + " more", 4: prose(2, 80), 5: None, 6: "", 7: "x"}
    kept = corpus_pipeline.one_of_each_group(spark, documents(texts), FOLDER).collect()
    parts = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(documents(texts)).collect()}
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d, c in parts.items() if d == c) == [1, 4, 5, 6, 7]


@needs_tables
def test_foreign_and_random_texts_go_and_clean_ones_stay(spark):
    docs = table(spark, FOLDER, "documents")
    rng = random.Random(1)
    odd = {
        -1: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)), -2: "xkcd qqq zzzz " * 9,
        -3: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        -4: "Все люди рождаются свободными и равными в своем достоинстве и правах.", -5: "0x3f99 aab7 deadbeef cafe 1234 5678 " * 8,
    }
    strange = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in odd.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.select(*strange.columns).unionByName(strange), FOLDER).collect()}
    assert not kept & set(odd)
    lettered = {r["doc_id"] for r in docs.where(r"text rlike '\\p{L}' and n_chars >= 40").collect()}
    assert len(lettered - kept) <= 0.01 * len(lettered)


@needs_tables
def test_contaminated_documents_go_and_others_stay(spark, documents, prose):
    item = table(spark, FOLDER, "benchmark").where("text is not null").orderBy(F.desc(F.length("text"))).first()["text"]
    texts = {1: f"{prose(1, 20)} {item} {prose(2, 20)}", 2: prose(3, 200), 3: item, 4: None, 5: ""}
    kept = {r["doc_id"] for r in corpus_pipeline.without_benchmark_passages(spark, documents(texts), FOLDER).collect()}
    assert kept == {2, 4, 5}
