"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted in tasks and written once. Trees are grown on a bounded sample of
labelled rows (`sample_rows`, the smallest seeded hashes of doc_id) whose statistics are cut into at most
`bins` quantile bins, so each split needs one histogram per statistic. The trees are complete and
stored as flat arrays: a block of documents descends all of them with `depth` vector steps each.

Defined cases: a null or empty text has the statistics of a text without bytes and gets a score like any
other; rows with a null label teach nothing; several labels of one document count as several rows; with
fewer than two classes to learn from, every score is the share of label 1 (0.5 with no label at all);
empty tables give no rows. lang, source and doc_id are never statistics; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .tokens import SPACE, Block, blocks, segment_sums, words
from .work import held_out, query, table, written

_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "beyond_ascii": _BYTES >= 128,
    "line_end": _BYTES == 10,
    "stop": np.isin(_BYTES, [33, 46, 63]),
    "comma": np.isin(_BYTES, [44, 58, 59]),
    "bracket": np.isin(_BYTES, [40, 41, 60, 62, 91, 93, 123, 125]),
    "rare_mark": np.isin(_BYTES, [35, 36, 37, 38, 42, 43, 47, 61, 64, 92, 94, 95, 96, 124, 126]),
}
STATISTICS = (
    "bytes", "words", "word_length", "long_words", "distinct_words", "top_word", "same_as_before", "marked_words", "upper_words",
    "words_a_line", "distinct_lines", *_CLASSES, "words_a_stop",
)


def statistics_of(block: Block) -> np.ndarray:
    """One row of STATISTICS for each text; ratios of nothing are 0."""
    data, offsets = block.data, block.offsets
    size = np.diff(offsets).astype(float)
    found = words(block)
    count = np.diff(found.offsets).astype(float)
    ratio = lambda part, whole: np.divide(part, whole, out=np.zeros(len(block)), where=whole > 0)
    by_word = lambda flags: segment_sums(flags.astype(np.int32), found.offsets)
    shares = {name: block.sums(flags[data].view(np.int8)) for name, flags in _CLASSES.items()}
    lengths = found.ends - found.starts
    running = np.concatenate([[0], np.cumsum(_CLASSES["rare_mark"][data] | (data == 33))])
    marks = running[found.ends] - running[found.starts]
    running = np.concatenate([[0], np.cumsum(_CLASSES["upper"][data])])
    uppers = running[found.ends] - running[found.starts]
    distinct, top, lines, distinct_lines = (np.zeros(len(block)) for _ in range(4))
    ends = np.flatnonzero(data == 10)
    line_at = np.searchsorted(ends, offsets)
    for i in np.flatnonzero(count > 0):
        own = np.sort(found.hashes[found.offsets[i] : found.offsets[i + 1]])
        turns = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        distinct[i], top[i] = len(turns) - 1, np.diff(turns).max()
        inner = ends[line_at[i] : line_at[i + 1]]
        lines[i] = len(inner) + 1
        if len(inner):
            begin, end = np.concatenate([[offsets[i]], inner + 1]), np.concatenate([inner, [offsets[i + 1]]])
            distinct_lines[i] = len(np.unique(found.span_hashes(begin, end)))
        else:
            distinct_lines[i] = 1
    same = np.zeros(len(found.hashes), bool)
    same[1:] = found.hashes[1:] == found.hashes[:-1]
    columns = [
        np.log1p(size), np.log1p(count), ratio(by_word(lengths), count), ratio(by_word(lengths > 15), count), ratio(distinct, count),
        ratio(top, count), ratio(by_word(same), count), ratio(by_word(marks > 0), count), ratio(by_word((uppers > 1) & (2 * uppers >= lengths)), count),
        ratio(count, lines), ratio(distinct_lines, lines), *(ratio(part, size) for part in shares.values()), ratio(count, shares["stop"] + 1.0),
    ]
    return np.stack(columns, 1).astype(np.float32)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def text_statistics(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        rows = np.concatenate([statistics_of(b) for b in blocks(column)] or [np.zeros((0, len(STATISTICS)), np.float32)])
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(rows.ravel()))


@dataclass
class Trees:
    """Complete trees of one depth: the statistic and cut of every inner node, level by level, and the leaves."""

    statistic: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margin = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for statistic, cut, leaf in zip(self.statistic, self.cut, self.leaf):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, statistic[node]] > cut[node])
            margin += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-margin))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, smooth: float = 1.0) -> Trees:
    """Boost logistic loss with second-order leaves; each split is the best gain over all histogram edges."""
    share = labels.mean() if len(labels) else 0.5
    base = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3)))
    if len(labels) == 0 or share in (0.0, 1.0):
        return Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), base if len(labels) else 0.0)
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], "left") for f in range(width)], 1)
    margin = np.full(len(labels), base)
    inner = 2**depth - 1
    out = Trees(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = labels - p, p * (1 - p)
        node = np.zeros(len(labels), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.zeros(nodes)
            for f in range(width):
                cell = (node - first) * bins + binned[:, f]
                g = np.bincount(cell, gradient, nodes * bins).reshape(nodes, bins)
                h = np.bincount(cell, weight, nodes * bins).reshape(nodes, bins)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                value = gain[np.arange(nodes), at]
                for k in np.flatnonzero(value > best + 1e-9):
                    best[k] = value[k]
                    out.statistic[t, first + k], out.cut[t, first + k] = f, edges[f][at[k]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), out.statistic[t, node]] > out.cut[t, node])
        leaf = node - inner
        value = np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, weight, inner + 1) + smooth)
        out.leaf[t] = rate * value
        margin += out.leaf[t, leaf]
    return out


def score_quality(documents: DataFrame, labels: DataFrame, folds: tuple[int, int] = (0, 5), sample_rows: int = 30_000, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, statistics. Held-out documents' labels are never read."""
    measured = written(documents.select("doc_id", text_statistics(F.col("text")).alias("statistics")).withColumn("held_out", held_out(*folds)), "statistics")
    known = labels.select("doc_id", F.col("quality").alias("_label")).where(F.col("_label").isNotNull() & ~held_out(*folds))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample_rows)
    taught = known.join(measured.where(~F.col("held_out")).select("doc_id", "statistics"), "doc_id")
    sample = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample_rows).toPandas()
    rows = np.array(sample["statistics"].tolist(), np.float32).reshape(len(sample), len(STATISTICS))
    model = documents.sparkSession.sparkContext.broadcast(grow(rows, sample["_label"].to_numpy(float)))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(model.value.scores(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))))

    out = measured.withColumn("score", scored(F.col("statistics")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "statistics")


@query()
def op3_quality(spark, folder):
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("statistics")
