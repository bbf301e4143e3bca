"""How common shingles are, in a table of fixed size, and an order of shingles from rare to common.

Every shingle of every text is counted in the cell that the top bits of its hash name. A cell's count is never
below a shingle's own, and common shingles stand out from the cells' even background. The order (count
class, then hash) is the same everywhere, so methods that need some global order stay exact with it,
and passages that very many documents share come last in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import blocks, shingles, words

CELL_BITS = 20
_SLICES = 16


def _count(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(1 << CELL_BITS, np.int64)
    seen = False
    for batch in batches:
        for block in blocks(batch.column("text")):
            runs, offsets = shingles(words(block))
            named = (runs >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            if once:
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                named = np.unique(text << CELL_BITS | named) & ((1 << CELL_BITS) - 1)
            cells += np.bincount(named, minlength=len(cells))
            seen = True
    if seen:
        parts = [part.astype(np.int32).tobytes() for part in np.split(cells, _SLICES)]
        salt = [int(cells.sum() % 64)] * _SLICES
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(salt, pa.int32()), pa.array(parts, pa.binary())], ["slice", "salt", "counts"])


def _added(kind: type) -> callable:
    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << CELL_BITS) // _SLICES, np.int64)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                total += np.frombuffer(counts, kind)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])

    return add


def shingle_counts(documents: DataFrame, once: bool = False) -> np.ndarray:
    """Cell counts over all texts: 2^20 numbers, whatever the size of the input. `once`: a text counts once in a cell."""
    tasks = documents.select("text").mapInArrow(lambda batches: _count(batches, once), "slice int, salt int, counts binary")
    partial = tasks.groupBy("slice", "salt").applyInArrow(_added(np.int32), "slice int, counts binary")
    sums = partial.groupBy("slice").applyInArrow(_added(np.int64), "slice int, counts binary")
    cells = np.zeros(1 << CELL_BITS, np.int64)
    size = len(cells) // _SLICES
    for row in sums.toLocalIterator():
        cells[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["counts"], np.int64)
    return cells


def count_classes(cells: np.ndarray) -> np.ndarray:
    """A quarter of a doubling is one class; all cells about the median are one class."""
    classes = np.floor(4 * np.log2(1 + cells)).astype(np.int64)
    return np.maximum(classes, np.floor(4 * np.log2(1 + 1.5 * np.median(cells)))).astype(np.uint64)


def ordered(classes: np.ndarray, hashes: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
    """Keys that sort from rare to common, then by `names` (the hashes themselves, unless given)."""
    names = hashes if names is None else names
    return (classes[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)] << np.uint64(56)) | (names & np.uint64((1 << 56) - 1))
