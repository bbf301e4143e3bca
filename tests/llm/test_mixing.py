from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st

from hirelens.llm.mixing import mix, sainte_lague, source_targets
from pyspark.sql import functions as F


def waterfill(sizes, share=1.5, most=2.0):
    """Share by weight, cap, and share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


def test_targets_equal_repeated_resharing(spark):
    sizes = {"b": 1000, "a": 50, "é": 700, None: 10, "c": 0, "z": 4000}
    frame = spark.createDataFrame(list(sizes.items()), "source string, words long")
    got = {r["source"]: r["target"] for r in source_targets(frame, 1.5, 2.0).collect()}
    want = waterfill(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=7), st.integers(0, 60))
def test_seats_go_to_the_highest_quotients(spark, votes, seats):
    frame = spark.createDataFrame([(0, i, v) for i, v in enumerate(votes)], "g int, i int, v long")
    got = {r["i"]: r["quota"] for r in sainte_lague(frame, ["g"], "v", "i", F.lit(seats).cast("long")).collect()}
    quotients = sorted(((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
    want = {i: sum(1 for _, j, _ in quotients if i == j) for i in range(len(votes))}
    assert got == want


def test_each_source_comes_near_its_target_and_reruns_agree(spark, prose):
    rows = [(i, prose(i, 40 + i % 90), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first = {r["doc_id"]: r for r in mix(frame, shard_words=4096, block_words=8).collect()}
    again = {r["doc_id"]: r["taken"] for r in mix(frame.repartition(5), shard_words=4096, block_words=8).collect()}
    assert {d: r["taken"] for d, r in first.items()} == again
    by_source: dict[str, list] = {}
    for doc_id, text, _, source, _ in rows:
        r = first[doc_id]
        assert r["size"] == len(text.split()) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum((s["end"] - s["begin"]) * s["times"] for s in r["spans"])
        by_source.setdefault(source, []).append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by_source.items()}
    for source, target in waterfill(sizes).items():
        assert by_source[source][0]["target"] == pytest.approx(target)
        assert sum(r["taken"] for r in by_source[source]) == pytest.approx(target, abs=40)


def test_odd_and_empty_tables(odd_documents, no_documents):
    rows = mix(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert mix(no_documents).collect() == []


def test_no_python_in_the_plan(odd_documents):
    plan = mix(odd_documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
