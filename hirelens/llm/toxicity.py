"""Toxic passages by maximum-scoring segment search.

Learning. Units are words and their beginnings of 3 to 7 characters. How many toxic and clean documents
hold each unit gives a log-odds ratio under an informative Dirichlet prior (each class gets the other
classes' expected counts, `prior` documents strong), lowered by `caution` standard errors. Units still
above `floor` form the lexicon; a word scores as its best unit, and any other word costs `drift`.
Labelled documents are a bounded sample (`sample_rows`, the smallest seeded hashes of doc_id).

Search. A linear-time scan finds all maximal-scoring segments of a text, the passages that no
extension or cut would improve. Words outside the lexicon enter it as gaps only.

Calibration. In clean texts the best segment's score follows an extreme-value law: the chance of one
above s in n words is 1 - exp(-K n e^(-rate s)). The rate is the root of E[e^(rate * score)] = 1 over the words of
clean sample documents; K gives as many passages as those have. A passage is significant when fewer than `significance` like it are
expected in a text of its length. Document scores are a logistic curve of -log(expected number) fitted to the sample.

Defined cases: a null or wordless text has no passage and gets the score of such texts; rows with a null label
teach nothing; with no toxic or no clean sample document all scores are 0; null ids are never learned from;
repeated rows are scored each; empty tables give no rows. lang, source and doc_id never enter a score.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import NOT_ALNUM, Block, Words, blocks, mixed, words
from .work import held_out, query, table, written

BEGINNINGS = (3, 4, 5, 6, 7)


def units(block: Block, found: Words) -> Iterator[np.ndarray]:
    """Hashes of all words, then of their beginnings; a word too short for a beginning repeats its own hash."""
    yield found.hashes
    leads = np.flatnonzero((block.data & 0xC0) != 0x80)
    rank = np.searchsorted(leads, found.starts)
    stops = np.append(leads, np.full(max(BEGINNINGS) + 1, len(block.data)))
    for size in BEGINNINGS:
        ends = stops[np.minimum(rank + size, len(stops) - 1)]
        longer = ends < found.ends
        hashes = found.hashes.copy()
        hashes[longer] = mixed(found.span_hashes(found.starts[longer], ends[longer]) + np.uint64(size))
        yield hashes


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for block in blocks(batch.column("text")):
            found = words(block, NOT_ALNUM)
            sizes = np.diff(found.offsets)
            text_of = np.repeat(np.arange(len(block), dtype=np.uint64), sizes)
            pairs = np.unique(np.stack([np.concatenate([text_of] * (1 + len(BEGINNINGS))), np.concatenate(list(units(block, found)))]), axis=1) if len(text_of) else np.zeros((2, 0), np.uint64)
            bad = toxic[block.first + pairs[0].astype(np.int64)]
            unit, at = np.unique(pairs[1], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit.view(np.int64)), pa.array(np.bincount(at, bad, len(unit)).astype(np.int64)), pa.array(np.bincount(at, ~bad, len(unit)).astype(np.int64))],
                ["unit", "n_toxic", "n_clean"],
            )


def best_segments(place: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last) of a text with `score` at increasing `place` and -drift elsewhere.

    One pass with a stack of candidates (left and right running sums): a new candidate joins back to the
    nearest one with a smaller left sum whose right sum it exceeds.
    """
    stack: list[tuple[float, float, int, int]] = []
    total, last = 0.0, -1
    for where, gain in zip(place.tolist(), score.tolist()):
        left = total - drift * (where - last - 1)
        total, last = left + gain, where
        begin, right = where, total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= left:
                k -= 1
            if k < 0 or stack[k][1] >= right:
                stack.append((left, right, begin, where))
                break
            left, begin = stack[k][0], stack[k][2]
            del stack[k:]
    return [(right - left, begin, end) for left, right, begin, end in stack]


@dataclass
class ToxicityModel:
    unit: np.ndarray
    score: np.ndarray
    drift: float
    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -np.inf

    def word_scores(self, block: Block, found: Words) -> np.ndarray:
        """The best lexicon score of each word; 0 where no unit is listed."""
        mask = np.uint64((1 << 16) - 1)
        listed = np.zeros(1 << 16, bool)
        listed[(self.unit & mask).astype(np.int64)] = True
        best = np.zeros(len(found.hashes))
        for hashes in units(block, found):
            maybe = np.flatnonzero(listed[(hashes & mask).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.unit, hashes[maybe]), max(len(self.unit) - 1, 0))
            hit = self.unit[at] == hashes[maybe] if len(self.unit) else np.zeros(0, bool)
            best[maybe[hit]] = np.maximum(best[maybe[hit]], self.score[at[hit]])
        return best

    def passages(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[float, int, int]]]]:
        """(text, words, segments) for every text of a column."""
        for block in blocks(column):
            found = words(block, NOT_ALNUM)
            scores = self.word_scores(block, found)
            listed = np.flatnonzero(scores > 0)
            cut = np.searchsorted(listed, found.offsets)
            for i in range(len(block)):
                own = listed[cut[i] : cut[i + 1]]
                n = int(found.offsets[i + 1] - found.offsets[i])
                yield block.first + i, n, best_segments(own - found.offsets[i], scores[own], self.drift) if len(own) else []

    def expected(self, n: int, score: float) -> float:
        return self.k * max(n, 1) * float(np.exp(-self.rate * score))

    def surprise(self, n: int, segments: list) -> float:
        """-log of the expected number of passages as good as the text's best; 0 without any."""
        return max(0.0, -np.log(max(self.expected(n, max(s for s, _, _ in segments)), 1e-300))) if segments else 0.0


def lexicon(counts, caution: float, drift: float, floor: float, prior: float = 1.0) -> ToxicityModel:
    """Units whose cautious log-odds exceed the floor, from (unit, n_toxic, n_clean) with the class sizes in the attributes."""
    toxic, clean = counts["n_toxic"].to_numpy(float), counts["n_clean"].to_numpy(float)
    n_toxic, n_clean = counts.attrs["toxic"], counts.attrs["clean"]
    expected = prior * n_toxic * (toxic + clean) / (n_toxic + n_clean)
    strength = prior * n_toxic
    odds = lambda y, n: np.log((y + expected) / np.maximum(n + strength - y - expected, 0.5))
    delta = odds(toxic, n_toxic) - odds(clean, n_clean)
    score = delta - caution * np.sqrt(1 / (toxic + expected) + 1 / (clean + expected))
    keep = score > floor
    unit = counts["unit"].to_numpy(np.int64).view(np.uint64)[keep]
    order = np.argsort(unit)
    return ToxicityModel(unit[order], score[keep][order], drift)


def calibrate(model: ToxicityModel, texts: pa.Array, toxic: np.ndarray) -> ToxicityModel:
    """Fit the extreme-value law on clean texts and the logistic curve on all."""
    scored = [(n, segments) for _, n, segments in model.passages(texts)]
    clean = [scored[i] for i in np.flatnonzero(~toxic)]
    n_words = max(sum(n for n, _ in clean), 1)
    best = np.array([s for _, segments in clean for s, _, _ in segments])
    p = max(len(best), 1) / n_words
    level = np.array(best) if len(best) else np.array([model.score.max() if len(model.score) else 1.0])
    low, high = 1e-3, 20.0
    for _ in range(60):
        rate = (low + high) / 2
        mean = (1 - p) * np.exp(-rate * model.drift) + p * np.exp(rate * np.minimum(level, 30)).mean()
        low, high = (rate, high) if mean < 1 else (low, rate)
    model.rate = low
    model.k = p * float(np.exp(model.rate * best.min())) if len(best) else p
    x = np.array([model.surprise(n, segments) for n, segments in scored])
    scale = x.std() or 1.0
    w = np.zeros(2)
    design = np.stack([x / scale, np.ones(len(x))], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (toxic - q) - 1e-3 * w
        hessian = (design * (q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -3, 3)
    model.slope, model.shift = w[0] / scale, w[1]
    return model


def learn(documents: DataFrame, labels: DataFrame, folds: tuple[int, int], sample_rows: int, calibration_rows: int, caution: float, drift: float, floor: float) -> ToxicityModel:
    known = labels.select("doc_id", F.col("toxic").alias("_label")).where(F.col("_label").isNotNull() & ~held_out(*folds))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample_rows)
    texts = documents.select("doc_id", "text").where(~held_out(*folds)).join(F.broadcast(known), "doc_id")
    sample = written(texts.select("doc_id", "text", (F.col("_label") > 0).alias("toxic")), "toxicity_sample")
    sizes = sample.agg(F.sum(F.col("toxic").cast("int")).alias("toxic"), F.count(F.lit(1)).alias("rows")).first()
    n_toxic, n_rows = sizes["toxic"] or 0, sizes["rows"]
    if n_toxic in (0, n_rows):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), drift)
    counts = sample.select("text", "toxic").mapInArrow(_count_units, "unit long, n_toxic long, n_clean long")
    counts = counts.groupBy("unit").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    # A unit can pass the cautious bound only if it is more frequent in toxic documents and not rare.
    counts = counts.where((F.col("n_toxic") >= 3) & (F.col("n_toxic") * (n_rows - n_toxic) > F.col("n_clean") * n_toxic)).toPandas()
    counts.attrs = {"toxic": float(n_toxic), "clean": float(n_rows - n_toxic)}
    model = lexicon(counts, caution, drift, floor)
    rows = sample.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(calibration_rows).toArrow()
    return calibrate(model, rows.column("text"), rows.column("toxic").to_numpy())


def score_toxicity(
    documents: DataFrame, labels: DataFrame, folds: tuple[int, int] = (1, 3), sample_rows: int = 20_000, calibration_rows: int = 3_000,
    caution: float = 3.0, drift: float = 0.05, floor: float = 1.0, significance: float = 0.05, threshold: float = 0.7,
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, passages (begin and end word, score, expected number)."""
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, folds, sample_rows, calibration_rows, caution, drift, floor))

    @F.arrow_udf("struct<score: double, passages: array<struct<begin: int, end: int, score: double, expected: double>>>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in batches:
            scores, offsets, rows = [], [0], []
            for _, n, segments in model.passages(column):
                scores.append(float(1 / (1 + np.exp(-(model.slope * model.surprise(n, segments) + model.shift)))))
                found = [(begin, end + 1, s, e) for s, begin, end in segments if (e := model.expected(n, s)) <= significance]
                rows += found
                offsets.append(len(rows))
            parts = list(zip(*rows)) or [(), (), (), ()]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            spans = pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], ["begin", "end", "score", "expected"])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], ["score", "passages"])

    judged = documents.select("doc_id", held_out(*folds).alias("held_out"), judge(F.col("text")).alias("_j"))
    return judged.select(
        "doc_id", "held_out", F.col("_j.score").alias("score"), (F.col("_j.score") >= threshold).cast("int").alias("predicted"),
        F.col("_j.passages").alias("passages"),
    )


@query()
def op6_toxicity(spark, folder):
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("passages")
