"""New companies found by rounds against adding them one by one."""
from __future__ import annotations

import random

import pytest

from hirelens.operators import companies

DDL = "n long, name string, website_url string, career_page_url string, company_type string, data_source_status string"
REGISTER = "name string, website_url string, career_page_url string"


def one_by_one(rows, register):
    taken = [{entry[k] for entry in register} for k in range(3)]
    out = {}
    for n, *values in sorted(rows):
        values = [(v or "").strip() for v in values]
        hollow = [f for f, v in zip(companies.REQUIRED, values) if not v]
        known = [f for f, v, held in zip(companies.UNIQUE, values, taken) if v in held]
        out[n] = f"{hollow[0]} must not be empty" if hollow else f"company already exists with {known[0]}" if known else None
        if out[n] is None:
            for v, held in zip(values, taken):
                held.add(v)
    return out


def reasons(spark, rows, register):
    checked = companies.check_new_companies(spark.createDataFrame(rows, DDL), spark.createDataFrame(register, REGISTER), "n")
    return {r["n"]: r["reject_reason"] for r in checked.collect()}


@pytest.mark.parametrize("seed, kinds", [(1, 3), (2, 12), (3, 40)])
def test_rounds_equal_adding_one_by_one(spark, seed, kinds):
    rng = random.Random(seed)

    def value(field, n):
        return rng.choice(["", None, f"{field}-{n}"]) if rng.random() < 0.1 else rng.choice([f" {field}{rng.randrange(kinds)}\t", f"{field}{rng.randrange(5 * kinds)}"])

    rows = [(n, value("a", n), value("b", n), value("c", n), "t", "s") for n in range(80)]
    register = [(f"a{rng.randrange(kinds)}", f"b{rng.randrange(5 * kinds)}", None) for _ in range(3)]
    assert reasons(spark, rows, register) == one_by_one(rows, register)


def test_a_rejected_row_blocks_nobody_along_a_chain(spark):
    # Each row shares its name with the one before and its website with the one after.
    rows = [(n, f"a{(n + 1) // 2}", f"b{n // 2}", f"c{n}", "t", "s") for n in range(12)]
    assert reasons(spark, rows, []) == one_by_one(rows, [])
    assert [n for n, r in sorted(one_by_one(rows, []).items()) if r is None] == [0, 2, 4, 6, 8, 10]


def test_one_value_in_most_rows(spark):
    rows = [(n, f"a{n}", "same" if n % 3 else f"b{n}", f"c{n}", "t", "s") for n in range(300)]
    assert reasons(spark, rows, []) == one_by_one(rows, [])


def test_no_rows(spark):
    assert reasons(spark, [], [("a", "b", "c")]) == {}
