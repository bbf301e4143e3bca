"""Large regions end after few rounds, and documents stay in as few of them as a link needs."""

from itertools import combinations

import numpy as np
import pyarrow as pa

from hirelens.llm import jaccard, substrings


def test_regions_of_long_documents_that_no_pivot_shrinks_take_one_round(spark, documents, prose, monkeypatch):
    texts = [f"{prose(99, 20)} {prose(k, 60)}" for k in range(24)]
    texts[20] = f"{texts[9]} more"
    table = documents(texts).select("doc_id", "text")
    regions = spark.createDataFrame([(0, k, len(t.split()) - 4) for k, t in enumerate(texts)], "region long, doc_id long, n long")
    rounds, plain = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda frame, name: rounds.append(name) or plain(frame, name))
    links = jaccard.region_join(regions, table, 75, 100, 5, 4096, 300).distinct().collect()
    assert [sorted(x) for x in links] == [[9, 20]]
    assert rounds.count("regions_left") <= 2 and rounds.count("region_texts") == 1


def test_kept_members_hold_a_region_of_every_link_and_few_others():
    rng = np.random.default_rng(7)
    least, of = 75, 100
    for _ in range(200):
        sizes = rng.integers(1, 40, 6)
        together = {pair: rng.integers(0, 6, 12) * (rng.random(12) < 0.5) for pair in combinations(range(6), 2)}
        shared = np.zeros((6, 12), np.int64)  # at least what any pair has in common in the region
        for (a, b), common in together.items():
            shared[a], shared[b] = np.maximum(shared[a], common), np.maximum(shared[b], common)
        doc, region = np.nonzero(shared)
        if not len(doc):
            continue
        columns = [x.astype(np.int64).tobytes() for x in (region, doc, sizes[doc], shared[doc, region])]
        batch = pa.RecordBatch.from_arrays([pa.array([0]), *(pa.array([c], pa.binary()) for c in columns)], ["lane", *jaccard.MEMBERSHIP])
        kept = {(r["region"], r["doc_id"]) for out in jaccard.kept_members(iter([batch]), least, of) for r in out.to_pylist()}
        for (a, b), common in together.items():
            if least * max(sizes[a], sizes[b]) <= of * min(sizes[a], sizes[b]) and common.sum() >= jaccard.extra(min(sizes[a], sizes[b])):
                assert any({(r, a), (r, b)} <= kept for r in np.flatnonzero(common))
    # A link of 500 shingles needs 47 common ones: fewer in all leave no region, and 20 single ones beside 40 in one region leave that one.
    for counts, left in (([1] * 46, []), ([1] * 20 + [20], []), ([1] * 20 + [40], [20])):
        columns = [np.array(x, np.int64).tobytes() for x in (range(len(counts)), [1] * len(counts), [500] * len(counts), counts)]
        batch = pa.RecordBatch.from_arrays([pa.array([0]), *(pa.array([c], pa.binary()) for c in columns)], ["lane", *jaccard.MEMBERSHIP])
        assert [r["region"] for out in jaccard.kept_members(iter([batch]), least, of) for r in out.to_pylist()] == left


def test_holders_of_a_short_line_are_not_compared_with_one_pivot_a_round(documents, prose, monkeypatch):
    line = prose(5, 40)
    texts = [f"{prose(100 + k, 70)} {line} {prose(200 + k, 70)}" for k in range(60)]
    texts[50] = f"{prose(300, 20)} {' '.join(texts[31].split()[40:120])} {prose(301, 20)}"
    rounds, plain = [], substrings.written
    monkeypatch.setattr(substrings, "written", lambda frame, name: rounds.append(name) or plain(frame, name))
    found = substrings.near_passages(documents(texts), leaf_rows=24).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(50, 31)}
    assert max(r["end"] - r["begin"] for r in found) >= 79
    assert rounds.count("window_texts") == 1 and rounds.count("chunks") <= substrings.PIVOT_ROUNDS + 3
