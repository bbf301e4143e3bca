"""The bit-sliced search against exact products of all pairs."""
from __future__ import annotations

import math

import numpy as np
import pytest

from hirelens.llm.bitslice import Shard, added, at_least, kth_value, top

SCHEMA = "vec_id long, embedding array<float>"


def ranked(ids, scores, k):
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(ids[order].tolist(), scores[order].tolist()))


@pytest.mark.parametrize("bits", [1, 3, 8, 20])
@pytest.mark.parametrize("n", [1, 64, 65, 700])
def test_shard_finds_the_best(bits, n):
    rng = np.random.default_rng(bits * n)
    values, ids = rng.integers(-200, 200, (n, 9)), rng.permutation(n).astype(np.int64)
    values[n // 2 :] = values[: n - n // 2]
    shard = Shard.unpacked(*Shard.built(ids, values, bits).packed())
    for weights in [*rng.integers(-40, 40, (8, 9)), np.zeros(9, int)]:
        own = int(ids[0])
        want = ranked(ids[ids != own], values[ids != own] @ weights, 5)
        assert ranked(*shard.best(weights, own, 5, None), 5) == want
        if len(want) == 5:
            assert ranked(*shard.best(weights, own, 5, want[-1][1]), 5) == want


def test_bitmaps_add_up():
    rng = np.random.default_rng(2)
    maps = [rng.integers(0, 2, (m, 128)).astype(np.uint8) for m in (7, 0, 5, 1)]
    slices = added([[np.packbits(m, 1, bitorder="little").view(np.uint64)] if len(m) else [] for m in maps])
    bits = np.array([np.unpackbits(s.view(np.uint8), bitorder="little") for s in slices], int)
    sums = sum((m.sum(0).astype(int) << p for p, m in enumerate(maps)), np.zeros(128, int))
    assert ((bits << np.arange(len(bits))[:, None]).sum(0) == sums).all()
    every = np.full(2, 2**64 - 1, np.uint64)
    assert kth_value(slices, every, 10) == np.sort(sums)[-10]
    assert np.unpackbits(at_least(slices, every, 9).view(np.uint8), bitorder="little").tolist() == (sums >= 9).astype(int).tolist()


def brute(rows, k, width):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for name in sorted({i for i, _ in sound if i % 50 == 0}):
        asked = min(v for i, v in sound if i == name)
        best = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in sound if i != name)[:k]
        out += [(name, rank, i, -score) for rank, (score, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("settings", [{}, {"slice_bits": 3, "shard_rows": 40, "query_rows": 2}])
def test_search_equals_all_pairs(spark, settings):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i + 300, rows[i][1]) for i in range(20)]
    rows += [(1000, [0.0] * 6), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1050, [float("nan")] * 6), (1002, [float("inf")] + [0.0] * 5), (1003, None), (1004, []), (1005, [1.0] * 5)]
    rows += [(None, [1.0] * 6), (50, [2.0] * 6), (50, [2.0] * 6), (1006, [3.0] * 6), (1006, [3.0] * 6), (-50, [-1.5] * 6)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' as quants", "1 as size", "2 as block", "3 as score")
    found = top(frame, frame.where("vec_id % 50 = 0"), **settings).collect()
    assert sorted(tuple(r) for r in found) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 6)


def test_too_large_components_take_no_part_and_few_rows_are_all_given(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e30, 1.0]), (2, [0.5, 0.25])]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in top(frame, frame.where("vec_id % 50 = 0")).collect()] == [(0, 1, 2, 256 * 128 + 256 * 64)]
    none = spark.createDataFrame([], SCHEMA)
    assert top(none, none).count() == 0
    alone = spark.createDataFrame(rows[:1], SCHEMA)
    assert top(alone, alone).count() == 0
