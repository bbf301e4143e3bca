"""Diagrams and the filter audit against counting every order over every row."""
from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest

from hirelens.llm.interactions import Diagram, adjacent_swaps, audit, document_filters

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.mark.parametrize("n", range(1, 6))
def test_swaps_lead_through_all_orders(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for level in adjacent_swaps(n):
        order[level], order[level + 1] = order[level + 1], order[level]
        seen.add(tuple(order))
    assert len(seen) == len(adjacent_swaps(n)) + 1 == len(list(itertools.permutations(range(n))))


def brute(rows, names):
    """rows: (failed letters, good, toxic)."""
    out = {}
    shapley = Counter()
    for order in itertools.permutations(names):
        left = list(rows)
        for step, name in enumerate(order, 1):
            gone = [r for r in left if name in r[0]]
            left = [r for r in left if name not in r[0]]
            fails = [r for r in rows if name in r[0]]
            shapley[name] += len(gone)
            out["".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(r[0] == {name} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {(o, s): [*v, shapley[o[s - 1]]] for (o, s), v in out.items()}


@pytest.mark.parametrize("seed", range(6))
def test_audit_equals_counting(seed):
    rng = random.Random(seed)
    rows = [({n for n in "ABCDE" if rng.random() < (0.3, 0.9, 0.02)[seed % 3]}, rng.random() < 0.3, rng.random() < 0.2) for _ in range(60)]
    masks: dict[int, list[int]] = {}
    for failed, good, toxic in rows:
        counts = masks.setdefault(sum(1 << "ABCDE".index(n) for n in failed), [0, 0, 0])
        for k, v in enumerate((1, good, toxic)):
            counts[k] += v
    found = {(o, s): list(v) for o, s, *v in audit({m: tuple(c) for m, c in masks.items()}, "ABCDE")}
    assert found == brute(rows, "ABCDE")


def test_equal_subdiagrams_are_one_node():
    full = Diagram({mask: (1, 0, 0) for mask in range(32)}, 5)
    assert [len(level) for level in full.levels] == [1] * 5
    for level in adjacent_swaps(5):
        full.swap(level)
        assert [len(nodes) for nodes in full.levels] == [1] * 5
    assert full.passes()[-1][1:] == ((1, 0, 0), (1, 0, 0))


def conditions(rows):
    """The five conditions of each (doc_id, text), by plain Python."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        failed = set()
        if len(words) < 200:
            failed.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            failed.add("C")
        if any(c in "#$%&*|" for c in text):
            failed.add("D")
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t in rows):
            failed.add("E")
        out.append(failed)
    return out


def found_rows(frame):
    out: dict[str, dict] = {}
    for r in frame.collect():
        out.setdefault(r["part"], {})[r["filter_order"], r["step"]] = [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    return out


def test_documents_equal_counting(spark, odd_documents):
    rng = random.Random(5)
    rows = [(d, None if t is None else str(t), s) for d, t, s in odd_documents.select("doc_id", "text", "source").collect()]
    for k in range(60):
        many = " ".join(rng.choice(["a", "b", "Word", f"x{rng.randrange(400)}", "ü"]) for _ in range(rng.choice([3, 199, 200, 400])))
        rows.append((100 + k, rng.choice([many, "same text", many + " $", many.upper(), "  x", "", None]), rng.choice(["a", "b", None, ""])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "'x' as words", "'y' as part", "3 as n")
    marks = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for d in range(0, 160, 2)] + [(100, 1, 0, "x"), (100, 0, 1, "x"), (None, 1, 1, "x")]
    labels = spark.createDataFrame(marks, LABELS)
    good = {d for d, q, _, _ in marks if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in marks if t == 1 and d is not None}
    expected: dict[str, list] = {}
    for (doc_id, _, source), failed in zip(rows, conditions([(d, t) for d, t, _ in rows])):
        expected.setdefault(source or "", []).append((failed, doc_id in good, doc_id in toxic))
    assert found_rows(document_filters(docs, labels)) == {part: brute(r, "ABCDE") for part, r in expected.items()}


def test_empty_tables(spark, no_documents):
    assert document_filters(no_documents, spark.createDataFrame([], LABELS)).count() == 0
