"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes: what follows the last two symbols, the last one, and none.
A symbol that a context has not seen is coded by an escape and then by the next shorter context, down to
an even choice; escape probabilities count the different symbols seen (n / (n + d), and d / (n + d) to
escape). Counts are frozen after learning, so a symbol's code length depends on the two symbols
before it alone, and the tree flattens to one table of exact code lengths. A text's language is the
one with the shortest code; the score is its posterior probability under equal priors.

Symbols: a-z (A-Z lower-cased), each byte from 128, and one for all other ASCII. Texts begin after two of
the latter. Learning counts triples over all documents of the learning set, in tasks; the driver receives
sums only, at most 155^3 a language whatever the input's size.

Defined cases: a null or empty text and one without any letter give `und` with score 0; documents with a
null language are not learned from; null ids are never learned from; ties go to the language first by
code point; repeated rows count as often as they come; with nothing to learn from, every document is `und`.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import Block, blocks, segment_sums
from .work import held_out, query, table

SYMBOLS = 155
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
UNKNOWN = "und"


def triples(block: Block, symbol: np.ndarray, size: int) -> np.ndarray:
    """For every byte, the number of the triple that it ends."""
    now = symbol[block.data]
    one = np.empty_like(now)
    two = np.empty_like(now)
    one[1:], two[2:] = now[:-1], now[:-2]
    starts = block.offsets[:-1][np.diff(block.offsets) > 0]
    one[starts] = two[starts] = symbol[32]
    second = block.offsets[:-1][np.diff(block.offsets) > 1] + 1
    two[second] = symbol[32]
    return (two * size + one) * size + now


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = batch.column("text").filter(pa.array(langs == lang))
            counts = np.zeros(SYMBOLS**3, np.int64)
            for block in blocks(texts):
                counts += np.bincount(triples(block, _SYMBOL, SYMBOLS), minlength=SYMBOLS**3)
            codes = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(counts[codes])], ["lang", "code", "n"])


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits for each triple from counts[two, one, now]; the last symbol stands for all that were never seen."""
    size = counts.shape[0]
    shorter = np.full(size, np.log2(size))
    for table_ in (counts.sum((0, 1)), counts.sum(0), counts):
        n = table_.sum(-1, keepdims=True).astype(float)
        d = (table_ > 0).sum(-1, keepdims=True).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = -np.log2(table_ / (n + d))
            escaped = np.where(n > 0, -np.log2(d / (n + d)), 0.0) + shorter
        shorter = np.where(table_ > 0, seen, escaped)
    return shorter


@dataclass
class LanguageModel:
    """Triple counts of each language; `ready` builds the code lengths once in each process."""

    langs: list[str]
    codes: list[np.ndarray]
    counts: list[np.ndarray]
    _built: tuple | None = None
    usual: list | None = None

    def ready(self) -> tuple[np.ndarray, int, list[np.ndarray]]:
        if self._built is None:
            used = np.unique(np.concatenate([np.stack([c // SYMBOLS**2, c // SYMBOLS % SYMBOLS, c % SYMBOLS]).ravel() for c in self.codes] + [np.zeros(1, np.int64)]))
            size = len(used) + 1
            place = np.full(SYMBOLS, size - 1)
            place[used] = np.arange(len(used))
            bits = []
            for codes, counts in zip(self.codes, self.counts):
                dense = np.zeros((size, size, size), np.int64)
                dense[place[codes // SYMBOLS**2], place[codes // SYMBOLS % SYMBOLS], place[codes % SYMBOLS]] = counts
                bits.append(_code_lengths(dense).ravel())
            self._built = place[_SYMBOL], size, bits
            # Mean and deviation of the bits a byte costs, over the language's own texts.
            self.usual = []
            for codes, counts, table_ in zip(self.codes, self.counts, bits):
                own = table_[(place[codes // SYMBOLS**2] * size + place[codes // SYMBOLS % SYMBOLS]) * size + place[codes % SYMBOLS]]
                mean = np.average(own, weights=counts) if counts.sum() else 0.0
                self.usual.append((mean, max(np.sqrt(np.average((own - mean) ** 2, weights=counts)) if counts.sum() else 0.0, 0.1)))
        return self._built

    def __getstate__(self):
        return {"langs": self.langs, "codes": self.codes, "counts": self.counts, "_built": None, "usual": None}

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of the best language in `langs`, its posterior probability, and how far the text's bits a byte lie above
        those of the language's own texts (in deviations of one byte), for each text."""
        symbol, size, bits = self.ready()
        best, score, excess = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column))
        usual = np.array(self.usual)
        for block in blocks(column):
            codes = triples(block, symbol, size)
            lengths = np.stack([segment_sums(table_[codes], block.offsets) for table_ in bits])
            at = slice(block.first, block.first + len(block))
            best[at] = lengths.argmin(0)
            score[at] = 1 / np.exp2(np.minimum(lengths.min(0) - lengths, 0.0)).sum(0)
            n = np.maximum(np.diff(block.offsets), 1)
            excess[at] = (lengths.min(0) / n - usual[best[at], 0]) / usual[best[at], 1]
        return best, score, excess


def learn(documents: DataFrame) -> LanguageModel:
    """Count triples over all given (text, lang); rows with a null in either teach nothing."""
    labelled = documents.select("text", "lang").where("text is not null and lang is not null")
    sums = labelled.mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = sums.toPandas().sort_values(["lang", "code"])
    parts = [(lang, rows) for lang, rows in found.groupby("lang", sort=True)]
    return LanguageModel([x for x, _ in parts], [r["code"].to_numpy(np.int64) for _, r in parts], [r["n"].to_numpy(np.int64) for _, r in parts])


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """The given rows with lang_pred, score and excess added; other columns with these names are replaced.

    `excess` says how much longer than usual in the predicted language the code of the text is, a byte, beyond what its length explains:
    4 deviations over the root of the bytes are taken off. It is near 0 or below for texts of the language, whatever their length.
    """
    kept = documents.drop("lang_pred", "score", "excess")
    if not model.langs:
        return kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "excess": F.lit(0.0)})
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = pa.array(model.langs)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            best, score, excess = shared.value.predict(texts)
            yield pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score), pa.array(excess)], ["lang", "score", "excess"])

    @F.arrow_udf("lang string, score double, excess double")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return scored(texts)

    lettered = F.col("text").rlike(r"\p{L}")
    judged = kept.withColumn("_judged", judge(F.col("text")))
    return judged.select(
        *kept.columns,
        F.when(lettered, F.col("_judged.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(lettered, F.col("_judged.score")).otherwise(0.0).alias("score"),
        F.when(lettered, F.col("_judged.excess") - 4 / F.sqrt(F.octet_length("text"))).otherwise(0.0).alias("excess"),
    )


@query()
def op5_language_id(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(2, 4))
    model = learn(documents.where(~F.col("held_out")))
    return identify(documents, model).select("doc_id", "held_out", "lang_pred", "score")
