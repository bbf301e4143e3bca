"""Dictionaries as tables: word n-grams of a text, cut once, meet an index of terms by hash.

The plan holds no term, so it does not grow with the dictionary, and a text is split once however many terms there are. What
leaves the text is (key, gram) with eight bytes a gram; terms of one text come together after the join, when few
rows are left. Two different runs of words share a hash with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.binding import computed_once
from ..functions.skills import technical_text, word_text
from ..functions.text import as_column

#: Marks the grams of one-letter names, which are read from a text of their own.
ALONE = "alone"


def term_table(spark: SparkSession, taxonomy: Mapping[str, Sequence[str]]) -> DataFrame:
    """(category, term) of a dictionary held in memory."""
    pairs = [(category, term) for category, terms in taxonomy.items() for term in terms]
    columns = zip(*pairs) if pairs else ((), ())
    return spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in columns], names=["category", "term"]))


def words_of(framed: Column) -> Column:
    return F.filter(F.split(framed, " "), lambda word: word != "")


def run_hash(words: Column) -> Column:
    """The hash of a run of words; null for none."""
    hashes = F.transform(words, lambda word: F.xxhash64(word))
    return F.when(F.size(words) > 0, F.aggregate(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), F.try_element_at(hashes, F.lit(1)), lambda run, word: F.xxhash64(run, word)))


def indexed(terms: DataFrame, keep: str = "") -> DataFrame:
    """(category, term, n_words, gram) of every term that has words; `keep` as in `word_text`."""
    worded = computed_once(terms.select("category", "term"), {"_words": words_of(word_text("term", keep))})
    return worded.select("category", "term", F.size("_words").alias("n_words"), run_hash(F.col("_words")).alias("gram")).filter("gram IS NOT NULL").distinct()


def with_grams(table: DataFrame, framed: Column | str, longest: int, into: str = "_grams") -> DataFrame:
    """Add the distinct hashes of all runs of one to `longest` words of a framed text."""
    bound = computed_once(table, {"_hashes": F.transform(words_of(as_column(framed)), lambda word: F.xxhash64(word))})
    levels = ["_hashes"]
    for size in range(2, longest + 1):
        rest = F.greatest(F.size("_hashes") - (size - 1), F.lit(0))
        longer = F.zip_with(F.slice(levels[-1], F.lit(1), rest), F.slice("_hashes", F.lit(size), rest), lambda run, word: F.xxhash64(run, word))
        bound = computed_once(bound, {f"_runs_{size}": longer})
        levels.append(f"_runs_{size}")
    return bound.withColumn(into, F.array_distinct(F.concat(*levels))).drop(*levels)


def found_terms(texts: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, category, term) for every term of a (category, term) table that a text holds as whole words, ignoring case."""
    index = indexed(terms)
    longest = index.agg(F.max("n_words")).first()[0] or 1
    framed = computed_once(texts, {"_framed": word_text(text)}).select(key, "_framed")
    grams = with_grams(framed, "_framed", longest).select(key, F.explode("_grams").alias("gram"))
    return grams.join(index.drop("n_words"), "gram").select(key, "category", "term")


def found_names(texts: DataFrame, key: str, text: str, names: Iterable[str]) -> DataFrame:
    """(key, name) of dictionary names held by a text, by the rules of `functions.skills.extract_skills`."""
    spark, listed = texts.sparkSession, list(names)
    several = indexed(term_table(spark, {"": [n for n in listed if len(n) > 1]}), "+#")
    single = term_table(spark, {"": [n for n in listed if len(n) == 1]}).select("term", F.xxhash64(F.xxhash64("term"), F.lit(ALONE)).alias("gram"))
    index = several.select("term", "gram").unionByName(single)
    longest = several.agg(F.max("n_words")).first()[0] or 1
    whole = word_text(text, keep="+#./&-", lower=False)
    bound = computed_once(texts, {
        "_loose": F.lower(technical_text(text)),
        # A mark at a letter's side makes it a part of something longer.
        "_alone": F.transform(
            F.filter(words_of(F.regexp_replace(whole, r"[./&-]+ | [./&-]+", "  ")), lambda word: F.length(word) == 1),
            lambda word: F.xxhash64(F.xxhash64(word), F.lit(ALONE)),
        ),
    }).select(key, "_loose", "_alone")
    grams = with_grams(bound, "_loose", longest).select(key, F.explode(F.array_union("_grams", "_alone")).alias("gram"))
    return grams.join(index, "gram").select(key, F.col("term").alias("name"))


def name_lists(texts: DataFrame, key: str, text: str, names: Sequence[str], into: str = "skills") -> DataFrame:
    """Rows of `texts` with the names they hold, in dictionary order; `key` is unique."""
    order = texts.sparkSession.createDataFrame(pa.table({"name": pa.array(list(names), pa.string()), "_at": pa.array(range(len(names)), pa.int32())}))
    found = found_names(texts, key, text, names).join(order, "name").groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set(F.struct("_at", "name"))).alias("_found"))
    joined = texts.join(found, F.col(key) == F.col("_key"), "left")
    held = F.coalesce(F.transform("_found", lambda pair: pair["name"]), F.array().cast("array<string>"))
    return joined.withColumn(into, held).drop("_key", "_found")
