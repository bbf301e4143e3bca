"""A corpus pipeline: language, line duplicates, near duplicates, benchmark passages, source mix.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns the columns
of documents; the last adds what the mix takes. Nulls in any column, empty and very long texts, repeated rows
and empty tables pass through every stage; what each stage does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelens.llm import decontamination, jaccard, language, linededup, mixing
from hirelens.llm.work import broadcast_if_small, table, written


#: How far a text's code may be longer than usual in its language (deviations of one byte, length allowed for). Texts of a learned
#: language lie near 0 and below 1; random letters, other languages and dumps of digits lie at 3 or more.
MOST_EXCESS = 1.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. Texts that are null or without letters go, those that no language fits better than
    another (posterior of half or less), and those that even the best one codes badly (`MOST_EXCESS`): gibberish and
    languages not learned. With no stated language to learn from, only the first go."""
    model = language.learn(docs)
    judged = language.identify(docs, model)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > 0.5) & (F.col("excess") <= MOST_EXCESS)).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier document has. A document of which nothing but blanks is left goes; n_chars
    follows the text where it changed. Null texts and ids stay as they are."""
    cut = linededup.dedup_lines(docs)
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    columns = [F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of `gone` (doc_id, _text)."""
    gone = written(gone.select(F.col("doc_id").alias("_gone"), F.col("_text").alias("_gone_text")).distinct(), "gone")
    return docs.join(broadcast_if_small(gone), F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_gone_text")), "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Texts without words and null ids stay."""
    return _without(docs, jaccard.near_duplicates(docs).where("doc_id <> component_id"))


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a benchmark passage."""
    return _without(docs, decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes from, with the word ranges taken and how often; the others go. Columns of docs that
    are named like the ones of the mix give way to them."""
    mix = mixing.mix(docs).where("taken > 0").dropDuplicates(["doc_id", "size"])
    added = [name for name in mix.columns if name != "doc_id"]
    mix = mix.withColumnsRenamed({name: f"_mix_{name}" for name in mix.columns})
    joined = docs.join(mix, F.col("doc_id").eqNullSafe(F.col("_mix_doc_id")) & (mixing.word_count(F.col("text")) == F.col("_mix_size")))
    own = [F.col(name) for name in docs.columns if name not in added]
    return joined.select(*own, *(F.col(f"_mix_{name}").alias(name) for name in added))


STAGES = [
    ("language", known_language),
    ("line dedup", without_repeated_lines),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark_passages),
    ("mixing", mixed_sources),
]

#: The language, alignment and block decisions cannot be said in SQL. The tests hold line dedup, near duplicates and benchmark passages
#: against brute force, the mix against its shares, and the language stage against clean, foreign and random texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
