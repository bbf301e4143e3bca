"""Salary extraction: four named readings of a posting text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (
    AMOUNT_DECIMAL, AMOUNT_HOURLY, AMOUNT_WHOLE, ANY_CODE, KNOWN_CODE, RANGE_DASH,
    RANGE_DASH_OR_TO, SALARY_BAND, SNIPPET_AFTER, SNIPPET_BEFORE, SYMBOL_CURRENCY,
)
from .binding import computed_once
from .markup import unescape_entities
from .text import as_column

SYMBOL = "[$£€]"
SPACE = r"\s*"


@dataclass(frozen=True)
class SalaryShape:
    """A pattern whose groups are symbol, lower amount, upper amount and currency code."""

    pattern: str
    minimum: int
    maximum: int
    code: int
    ignore_case: bool
    guarded: bool = False

    @property
    def flags(self) -> str:
        return "(?iU)" if self.ignore_case else "(?U)"


def range_shape(amount: str, end_guard: bool = False) -> SalaryShape:
    guard = r"(?:[^0-9]|$)" if end_guard else ""
    pattern = (
        f"({SYMBOL}){SPACE}({amount}){SPACE}{RANGE_DASH_OR_TO}{SPACE}(?:{SYMBOL}{SPACE})?"
        f"({amount}){guard}(?:{SPACE}({KNOWN_CODE}))?"
    )
    return SalaryShape(pattern, 2, 3, 4, True, end_guard)


# The three steps of the "any_amount" reading, tried in this order.
ANY_AMOUNT_STEPS = (
    SalaryShape(
        f"({SYMBOL}){SPACE}({AMOUNT_WHOLE}){SPACE}{RANGE_DASH}{SPACE}({SYMBOL})?{SPACE}"
        f"({AMOUNT_WHOLE}){SPACE}({ANY_CODE})?", 2, 4, 5, False),
    SalaryShape(f"({SYMBOL}){SPACE}({AMOUNT_WHOLE}){SPACE}({ANY_CODE})", 2, 2, 3, False),
    SalaryShape(f"({SYMBOL}){SPACE}({AMOUNT_WHOLE})(?:{SPACE}({ANY_CODE}))?", 2, 2, 3, False),
)

# The same pattern serves the mobility and the research boards; the onboard one reads hourly pay.
RANGE_READINGS = {
    "mobility": range_shape(AMOUNT_DECIMAL),
    "research": range_shape(AMOUNT_DECIMAL),
    "onboard": range_shape(AMOUNT_HOURLY),
    "onboard_strict": range_shape(AMOUNT_HOURLY, end_guard=True),
}


def _amount(text: Column, kind: str) -> Column:
    return F.regexp_replace(F.nullif(text, F.lit("")), ",", "").try_cast(kind)


def _currency(code: Column, symbol: Column) -> Column:
    by_symbol = F.when(symbol == "$", SYMBOL_CURRENCY["$"])
    for mark in ("£", "€"):
        by_symbol = by_symbol.when(symbol == mark, SYMBOL_CURRENCY[mark])
    return F.upper(F.coalesce(F.nullif(code, F.lit("")), by_symbol))


def _has_symbol(text: Column) -> Column:
    """A cheap first look, so that texts without money never meet the long patterns."""
    return F.contains(text, F.lit("$")) | F.contains(text, F.lit("£")) | F.contains(text, F.lit("€"))


def stated_range(text: Column | str, reading: str) -> Column:
    """The text of the first stated range; blank or null where none is stated."""
    shape = RANGE_READINGS[reading]
    body = as_column(text)
    return F.when(_has_symbol(body), F.regexp_extract(body, shape.flags + shape.pattern, 0))


def surroundings(text: Column | str, found: Column | str, reading: str) -> Column:
    """A found stretch with the characters around it.

    The first match of a pattern is also the first place where its text stands, so a plain search locates it. That does
    not hold for a guarded pattern, whose text may stand earlier as a part of a longer amount: there the pattern
    is searched again, in the texts that have a match.
    """
    body, match, shape = as_column(text), as_column(found), RANGE_READINGS[reading]
    place = F.regexp_instr(body, F.lit(shape.flags + shape.pattern)) if shape.guarded else F.instr(body, match)
    start = F.greatest(place - SNIPPET_BEFORE, F.lit(1))
    return F.substring(body, start, place - start + F.length(match) + SNIPPET_AFTER)


def range_fields(stretch: Column | str, reading: str) -> dict[str, Column]:
    """Salary columns read from a range with its surroundings; all null where it is null."""
    shape = RANGE_READINGS[reading]
    raw = as_column(stretch)

    def group(index: int) -> Column:
        return F.regexp_extract(raw, shape.flags + shape.pattern, index)

    snippet = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
    hourly = F.rlike(raw, F.lit("(?i)hour|/hr"))
    return {
        "salary_min": _amount(group(shape.minimum), "double"),
        "salary_max": _amount(group(shape.maximum), "double"),
        "salary_currency": _currency(group(shape.code), group(1)),
        "salary_period": F.when(hourly, "hour").when(raw.isNotNull(), "year"),
        "salary_snippet": snippet,
        "salary_source": F.when(raw.isNotNull(), "job_post"),
    }


def amount_fields(matched: Column | str) -> dict[str, Column]:
    """Salary columns read from the matched text; a single amount fills both ends."""
    whole = as_column(matched)

    def first(of: str) -> Column:
        return F.coalesce(*(
            F.nullif(F.regexp_extract(whole, shape.flags + shape.pattern, getattr(shape, of)), F.lit(""))
            for shape in ANY_AMOUNT_STEPS
        ))

    return {
        "salary_min": _amount(first("minimum"), "bigint"),
        "salary_max": _amount(first("maximum"), "bigint"),
        "salary_currency": _currency(first("code"), F.substring(whole, 1, 1)),
        "salary_snippet": whole,
    }


def with_salary_range(
    postings: DataFrame, text: str, reading: str, suffix: str = "", stated_only: bool = False
) -> DataFrame:
    """Add salary columns; with `stated_only`, keep the postings that state a range.

    Character references are decoded once first. A long text is scanned once; everything else looks at the short
    stretch around the match.
    """
    decoded = F.when(F.contains(F.col(text), F.lit("&")), unescape_entities(F.col(text))).otherwise(F.col(text))
    found = computed_once(computed_once(postings, {"_body": decoded}), {"_match": stated_range("_body", reading)})
    if stated_only:
        found = found.filter("_match <> ''")
    pay = F.when(F.col("_match") != "", surroundings("_body", "_match", reading))
    fields = range_fields("_pay", reading)
    priced = computed_once(
        computed_once(found, {"_pay": pay}), {name + suffix: value for name, value in fields.items()}
    )
    return priced.drop("_match", "_pay", "_body")


def with_any_salary(
    postings: DataFrame, text: str, suffix: str = "", stated_only: bool = False
) -> DataFrame:
    """Add the salary of a range, else of an amount with a currency code, else of any amount.

    A later step only scans texts in which the earlier ones found nothing.
    """
    body, found = F.col(text), F.lit("")
    staged = postings
    for shape in ANY_AMOUNT_STEPS:
        match = F.regexp_extract(body, shape.flags + shape.pattern, 0)
        step = F.when(found != "", found).when(_has_symbol(body), match).otherwise("")
        staged = computed_once(staged, {"_match": step})
        found = F.col("_match")
    if stated_only:
        staged = staged.filter("_match <> ''")
    fields = amount_fields(F.when(found != "", found))
    priced = computed_once(staged, {name + suffix: value for name, value in fields.items()})
    return priced.drop("_match")


def salary_band(amount: Column | str, width: int = SALARY_BAND) -> Column:
    return (F.floor(as_column(amount) / width) * width).cast("bigint")


def salary_label(minimum: Column | str, maximum: Column | str) -> Column:
    """Thousands as shown on a card."""
    return F.format_string("$%dk – $%dk", as_column(minimum), as_column(maximum))
