"""Skill and term matching on whole words, without a shuffle: dictionaries ride in the plan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from ..fixed_values import SKILL_SYNONYMS
from .text import as_column


def word_text(text: Column | str, keep: str = "", lower: bool = True) -> Column:
    """Words separated and framed by single blanks, so `contains` matches whole words only.

    Letters, digits and underscores are word characters; `keep` adds others.
    """
    body = F.lower(as_column(text)) if lower else as_column(text)
    words = F.regexp_replace(body, f"[^\\p{{L}}\\p{{N}}_{keep}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def framed_term(term: str) -> str:
    """A term as it stands in a framed text: marks inside it separate words there as well."""
    return f" {re.sub(r'[^\w+#]+', ' ', term).strip()} "


def matched_terms(framed: Column | str, terms: Iterable[str]) -> Column:
    """The terms held by a framed text, in dictionary order."""
    body = as_column(framed)
    hits = [F.when(F.contains(body, F.lit(framed_term(term))), F.lit(term)) for term in terms]
    return F.array_compact(F.array(*hits))


def holds_any(framed: Column | str, terms: Iterable[str]) -> Column:
    body = as_column(framed)
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(body, F.lit(framed_term(term)))
    return found


def technical_text(text: Column | str) -> Column:
    """As `word_text`, keeping case, `+` and `#`, so that C, C++ and C# stay apart."""
    return word_text(text, keep="+#", lower=False)


def extract_skills(text: Column | str, names: Iterable[str]) -> Column:
    """Dictionary names found in a text.

    Names with marks inside, such as Node.js or CI/CD, are framed like the text. One-letter names must match in case
    and stand alone: a part of R&D or C-suite is no name.
    """
    whole = word_text(text, keep="+#./&-", lower=False)
    alone = F.regexp_replace(whole, r"[./&-]+ | [./&-]+", "  ")
    loose = F.lower(technical_text(text))
    hits = [
        F.when(
            F.contains(alone, F.lit(f" {name} ")) if len(name) == 1
            else F.contains(loose, F.lit(framed_term(name.lower()))),
            F.lit(name),
        )
        for name in names
    ]
    return F.array_compact(F.array(*hits))


def mapped(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """The canonical form of a value, or the value itself; lookup ignores case and outer blanks."""
    original = as_column(value)
    table = F.create_map(*(F.lit(item) for pair in mapping.items() for item in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(original))), original)


def normalise_skill(skill: Column | str, synonyms: Mapping[str, str] = SKILL_SYNONYMS) -> Column:
    return mapped(skill, synonyms)


def normalise_skills(skills: Column | str, synonyms: Mapping[str, str] = SKILL_SYNONYMS) -> Column:
    """Canonical skills of an array, each once, first occurrence first."""
    return F.array_distinct(F.transform(as_column(skills), lambda skill: mapped(skill, synonyms)))


# Title words of each level, tried in this order.
SENIORITY_RULES = (
    ("Internship", "intern|internship|working student|thesis"),
    ("Lead", "lead|principal|staff|head|director"),
    ("Senior", "senior|sr"),
    ("Junior", "junior|jr|graduate|entry level|trainee"),
)


def seniority(title: Column | str, level: Column | str | None = None) -> Column:
    """The level the source states, else one read from the title, else Mid."""
    text = word_text(title)
    read = None
    for name, words in SENIORITY_RULES:
        held = holds_any(text, words.split("|"))
        read = F.when(held, name) if read is None else read.when(held, name)
    read = read.otherwise("Mid")
    if level is None:
        return read
    return F.coalesce(F.nullif(F.trim(as_column(level)), F.lit("")), read)


def location_parts(location: Column | str) -> Column:
    """Struct of city, region and country: first, middle and last comma-separated part."""
    parts = F.split(F.trim(as_column(location)), r",\s*")
    count = F.size(parts)
    return F.struct(
        F.when(count > 1, parts[0]).alias("city"),
        F.when(count > 2, F.try_element_at(parts, F.lit(2))).alias("region"),
        F.nullif(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("country"),
    )
