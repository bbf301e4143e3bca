from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long_text = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    same = "one two three four five six seven eight nine ten\nsecond line of it"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "b", 4), (4, "word", "en", "a", 4), (5, same, "en", "a", 50),
        (5, same, "en", "a", 50), (6, same, None, None, 50), (7, long_text, "en", "c", len(long_text)), (None, same, "en", "a", 50),
        (None, None, None, None, None), (8, "ÉÀ ß 漢字  x\n\nx", "fr", "é", 9), (9, "!!! ???", "en", "b", 7), (10, "123 456", "de", "b", 7),
    ]
    extra = ", score double, held_out string, text_ string, label string, size string, words string, rank string, n string, a string, node string, _text_ string"
    return spark.createDataFrame([r + (0.5,) + ("x",) * 10 for r in rows], DOCUMENTS + extra)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def prose():
    """Texts of random words, the same for one seed."""
    def make(seed: int, words: int, vocabulary: int = 5000) -> str:
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))

    return make


@pytest.fixture
def documents(spark):
    def make(texts, lang="en", source="s"):
        rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
        return spark.createDataFrame([(i, t, lang, source, len(t) if t is not None else None) for i, t in rows], DOCUMENTS)

    return make
