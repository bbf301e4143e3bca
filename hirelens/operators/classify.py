"""Keyword classification into a versioned, multi-label taxonomy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import AV_SIGNALS, DATASET_SIGNALS, TAXONOMY_TERMS
from .terms import found_terms, term_table

TAXONOMY_VERSION = 2
# Ours: the source gives the order of strength, no numbers.
PHRASE_WEIGHT = 2
HIGH_SHARE, MEDIUM_SHARE = 0.75, 0.5
#: A second label at least this heavy against the first contradicts it.
RIVAL_RATIO = 0.9


def combined_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("\n", *columns)


def as_terms(table: DataFrame, terms: DataFrame | Mapping[str, Sequence[str]]) -> DataFrame:
    return terms if isinstance(terms, DataFrame) else term_table(table.sparkSession, terms)


def av_relevant(
    postings: DataFrame, columns: Sequence[str], key: str,
    signals: DataFrame | Mapping[str, Sequence[str]] = {"signal": AV_SIGNALS, "dataset": DATASET_SIGNALS},
) -> DataFrame:
    """Postings with at least one relevance signal. Meant to run before anything costly."""
    held = found_terms(postings, key, combined_text(columns), as_terms(postings, signals))
    return postings.join(held.select(key).distinct(), key, "left_semi")


def term_weight(term: Column, phrase_weight: int) -> Column:
    """One per term, more for phrases and platform names."""
    return F.when(F.contains(term, F.lit(" ")) | F.contains(term, F.lit("_")), phrase_weight).otherwise(1)


def labels_of(
    postings: DataFrame, columns: Sequence[str], key: str,
    taxonomy: DataFrame | Mapping[str, Sequence[str]] = TAXONOMY_TERMS, phrase_weight: int = PHRASE_WEIGHT,
) -> DataFrame:
    """(key, category, terms, weight) for every category that a posting has evidence of; terms sorted."""
    found = found_terms(postings, key, combined_text(columns), as_terms(postings, taxonomy))
    # A gram comes once from a text, so a term does too.
    return found.groupBy(key, "category").agg(
        F.array_sort(F.collect_list("term")).alias("terms"), F.sum(term_weight(F.col("term"), phrase_weight)).cast("int").alias("weight")
    )


def classify(
    postings: DataFrame, columns: Sequence[str], key: str,
    taxonomy: DataFrame | Mapping[str, Sequence[str]] = TAXONOMY_TERMS,
    version: int = TAXONOMY_VERSION, phrase_weight: int = PHRASE_WEIGHT,
) -> DataFrame:
    """Add `labels`: an array of (category, terms, weight) for every category with evidence.

    `taxonomy` is a (category, term) table or a small dictionary; `key` is unique. Texts do not travel: labels are found from
    (key, gram) rows and come back to the postings by key.
    """
    label = F.struct("category", "terms", "weight")
    found = labels_of(postings, columns, key, taxonomy, phrase_weight)
    listed = found.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(label)).alias("labels"))
    joined = postings.join(listed, F.col(key) == F.col("_key"), "left").drop("_key")
    none = F.array().cast(listed.schema["labels"].dataType)
    return joined.withColumns({"labels": F.coalesce("labels", none), "taxonomy_version": F.lit(version)})


def with_verdict(
    classified: DataFrame, high: float = HIGH_SHARE, medium: float = MEDIUM_SHARE, rival: float = RIVAL_RATIO, stated: Column | None = None,
) -> DataFrame:
    """Primary and secondary categories, confidence and review status from `labels`.

    The heaviest label is primary, the later name on a tie. Confidence is its share of all weight. Labels conflict when a second
    one is nearly as heavy (`rival` times the first), or when the category that the source states (`stated`, null where it
    states none) is not the primary one. A conflict goes before doubt.
    """
    ranked = F.transform("labels", lambda label: F.struct(label["weight"], label["category"]))
    top = classified.withColumn("_top", F.array_max(ranked)).withColumn(
        "_total", F.aggregate("labels", F.lit(0), lambda total, label: total + label["weight"])
    )
    names = F.transform("labels", lambda label: label["category"])
    share = F.col("_top.weight") / F.col("_total")
    judged = top.withColumns({
        "primary_category": F.col("_top.category"),
        "secondary_categories": F.array_sort(F.array_except(names, F.array("_top.category"))),
        "top_share": F.round(share, 6),
    })
    confidence = (
        F.when(F.col("primary_category").isNull(), "None")
        .when(F.col("top_share") >= high, "High")
        .when(F.col("top_share") >= medium, "Medium")
        .otherwise("Low")
    )
    others = F.filter("labels", lambda label: label["category"] != F.col("primary_category"))
    conflict = F.exists(others, lambda label: label["weight"] >= F.col("_top.weight") * rival)
    if stated is not None:
        conflict = conflict | F.coalesce(stated != F.col("primary_category"), F.lit(False))
    review = F.when(F.coalesce(conflict, F.lit(False)), "conflicting").when(confidence.isin("High", "Medium"), "automatic").otherwise("uncertain")
    return judged.withColumns({"classification_confidence": confidence, "review_status": review}).drop("_top", "_total")


def label_rows(labels: DataFrame, key: str, version: int = TAXONOMY_VERSION) -> DataFrame:
    """The posting-category bridge with its evidence and score, from `labels_of`."""
    total = labels.groupBy(key).agg(F.sum("weight").alias("_total"))
    return labels.join(total, key).select(
        key, "category", F.col("terms").alias("matched_terms"), "weight",
        F.round(F.col("weight") / F.col("_total"), 6).alias("confidence_score"), F.lit(version).alias("taxonomy_version"),
    )


def extraction_confidence(direct: Sequence[Column]) -> Column:
    """Share of fields collected directly rather than inferred; flags may not be null."""
    return F.round(reduce(lambda a, b: a + b, (flag.cast("int") for flag in direct)) / len(direct), 6)
