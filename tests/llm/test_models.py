"""Learned operators: held-out accuracy on the shared tables, exact arithmetic on small ones, odd input."""
from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from hirelens.llm import language, quality, toxicity
from hirelens.llm.work import QUERIES, held_out, table
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no shared tables here")


@needs_tables
def test_language_of_held_out_documents(spark):
    found = QUERIES["op5_language_id"](spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out and lang is not null").collect()
    assert len(rows) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)




def test_code_lengths_match_coding_symbol_by_symbol(documents):
    texts = ["the cat sat on the mat", "der hund und die katze", "a cat. THE hat", "die maus"]
    model = language.LanguageModel([], [], [])
    frame = documents(texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = language.learn(frame)
    assert model.langs == ["de", "en"]
    symbol, size, bits = model.ready()
    used = np.unique(np.concatenate([np.stack([c // 155**2, c // 155 % 155, c % 155]).ravel() for c in model.codes] + [np.zeros(1, int)]))
    for text in ("the mouse", "katze", "é?", ""):
        (block,) = language.blocks(pa.array([text, "x"]))
        codes = language.triples(block, symbol, size)[: len(text.encode())]
        for table_, c, n in zip(bits, model.codes, model.counts):
            small = np.zeros((155, 155, 155), np.int64)
            small[c // 155**2, c // 155 % 155, c % 155] = n
            dense = small[np.ix_(used, used, used)]
            mapped = {int(u): k for k, u in enumerate(used)}
            want, two, one = 0.0, 0, 0
            for byte in text.encode():
                now = mapped.get(int(language._SYMBOL[byte]))
                step, hit = 0.0, False
                contexts = [dense[two, one] if None not in (two, one) else None, dense[:, one].sum(0) if one is not None else None, dense.sum((0, 1))]
                for context in contexts:
                    if context is None or not context.sum():
                        continue
                    n_all, d = context.sum(), (context > 0).sum()
                    if now is not None and context[now]:
                        step, hit = step - math.log2(context[now] / (n_all + d)), True
                        break
                    step -= math.log2(d / (n_all + d))
                want += step if hit else step + math.log2(size)
                two, one = one, now
            assert table_[codes].sum() == pytest.approx(want)


def test_language_of_odd_and_empty_tables(odd_documents, no_documents):
    model = language.learn(odd_documents)
    rows = language.identify(odd_documents, model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1, 2, 3, 9, 10):
            assert r["lang_pred"] == "und"
    nothing = language.learn(no_documents)
    assert nothing.langs == [] and language.identify(no_documents, nothing).collect() == []
    assert {r["lang_pred"] for r in language.identify(odd_documents, nothing).collect()} == {"und"}


@needs_tables
def test_quality_of_held_out_documents(spark):
    found = QUERIES["op3_quality"](spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) >= 0.95 * len(found)


def test_trees_split_where_the_labels_do():
    rng = np.random.default_rng(1)
    rows = rng.random((2000, 4)).astype(np.float32)
    labels = ((rows[:, 1] > 0.4) ^ (rows[:, 3] > 0.7)).astype(float)
    trees = quality.grow(rows, labels, trees=40, depth=3)
    assert ((trees.scores(rows) > 0.5) == labels).mean() > 0.97
    by_hand = []
    for row in rows[:50]:
        margin = trees.base
        for statistic, cut, leaf in zip(trees.statistic, trees.cut, trees.leaf):
            node = 0
            while node < len(cut):
                node = 2 * node + 1 + int(row[statistic[node]] > cut[node])
            margin += leaf[node - len(cut)]
        by_hand.append(1 / (1 + math.exp(-margin)))
    assert np.allclose(trees.scores(rows[:50]), by_hand)
    assert quality.grow(rows, np.ones(2000)).scores(rows[:3]).min() > 0.99
    assert quality.grow(rows[:0], labels[:0]).scores(rows[:3]).tolist() == [0.5, 0.5, 0.5]


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_scores_of_odd_and_empty_tables(spark, odd_documents, no_documents, score):
    ddl = "doc_id long, quality int, toxic int, text string, score double"
    labels = spark.createDataFrame([(4, 1, 0, "x", 0.1), (5, 0, 1, "x", 0.1), (5, 1, 1, None, None), (7, None, None, None, None), (None, 1, 1, "", 0.0), (8, 1, 0, "", 0.0)], ddl)
    for frame, known in ((odd_documents, labels), (odd_documents, labels.where("false")), (no_documents, labels)):
        rows = score(frame, known).collect()
        assert len(rows) == frame.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)


def test_labels_of_held_out_documents_do_not_matter(spark, documents, prose):
    texts = [prose(i, 60) + (" awful" if i % 4 == 0 else "") for i in range(200)]
    frame = documents(texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    for score, fold in ((quality.score_quality, (0, 5)), (toxicity.score_toxicity, (1, 3))):
        turned = labels.withColumn("quality", F.when(held_out(*fold), 1 - F.col("quality")).otherwise(F.col("quality")))
        turned = turned.withColumn("toxic", F.when(held_out(*fold), 1 - F.col("toxic")).otherwise(F.col("toxic")))
        assert {r["doc_id"]: r["score"] for r in score(frame, labels).collect()} == {r["doc_id"]: r["score"] for r in score(frame, turned).collect()}


def maximal_segments(scores):
    """All maximal-scoring segments: the best one, shortest first among equals, then the same on both sides."""
    def find(low, high):
        best = None
        for i in range(low, high):
            total = 0
            for j in range(i, high):
                total += scores[j]
                key = (total, -(j - i))
                if total > 0 and (best is None or key > best[0]):
                    best = (key, i, j)
        if best is None:
            return []
        (total, _), i, j = best
        return find(low, i) + [(total, i, j)] + find(j + 1, high)

    return find(0, len(scores))


def test_segment_scan_finds_all_maximal_segments():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(0, 25)
        drift = rng.choice([1, 2, 3])
        scores = [rng.randrange(1, 9) if rng.random() < 0.4 else -drift for _ in range(n)]
        place = np.array([i for i, s in enumerate(scores) if s > 0], int)
        got = toxicity.best_segments(place, np.array([scores[i] for i in place], float), drift)
        assert sum(s for s, _, _ in got) == sum(s for s, _, _ in maximal_segments(scores))
        assert sorted(s for s, _, _ in got) == sorted(s for s, _, _ in maximal_segments(scores))


def test_toxic_words_and_unseen_forms_are_found(spark, documents, prose):
    bad = ["vilestone", "vilestory", "vilestick", "scum"]
    texts = [prose(i, 80) + (f" {bad[i // 3 % 4]}." if i % 3 == 0 else "") for i in range(600)]
    texts += [prose(9000, 50) + " Vilestump " + prose(9001, 50), prose(9002, 100)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(documents(texts), labels).collect()}
    assert rows[600]["predicted"] == 1 and rows[601]["predicted"] == 0
    assert any(p["begin"] <= 50 < p["end"] for p in rows[600]["passages"]) and rows[601]["passages"] == []
