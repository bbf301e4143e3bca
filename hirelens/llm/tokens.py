"""Words, shingles and byte classes of many texts at once, as numpy arrays.

All functions work on the UTF-8 bytes of a block of texts laid end to end. Separators and A-Z are
ASCII, so bytes give the same words as characters do. A word's hash is a polynomial in random byte
weights modulo 2^64, taken from one running sum, then mixed; equal words have equal hashes in
every task. Distinct words share a hash with probability near 2^-64 for a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_WEIGHT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHT[65:91] = _WEIGHT[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


class _Powers(list):
    """Powers of the base and of its inverse as far as a process has needed them; they do not travel with functions."""

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def give_back() -> None:
    """Hand freed memory back to the system. A Python worker lives on after its task, and would hold what its largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        _powers.extend([np.ones(1, np.uint64)] * 2)
    if len(_powers[0]) < size:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(size, BLOCK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Batches cut into smaller ones without a copy, for functions whose output and scratch arrays outgrow their input."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


@dataclass
class Block:
    """Texts `first` to `first + len(self)` of a column: their bytes and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a per-byte array over each text."""
        return segment_sums(values, self.offsets)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=out.dtype)
    return out


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[Block]:
    """Cut a string column into blocks of about a megabyte; a longer text is a block of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
    give_back()


@dataclass
class Words:
    """Words of a block: byte span and hash of each, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    running: np.ndarray

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = _power(len(self.running))[1]
        return mixed((self.running[ends] - self.running[starts]) * inverse[starts])


def words(block: Block, separators: np.ndarray = SPACE) -> Words:
    data, offsets = block.data, block.offsets
    size = len(data)
    inside = ~separators[data]
    before = np.empty(size + 1, bool)
    before[0] = before[-1] = True
    before[1:size] = ~inside[:-1] if size else False
    after = before[1:].copy()
    if size:
        after[:-1] = ~inside[1:]
        after[-1] = True
    cuts = offsets[1:-1]
    before[cuts[cuts < size]] = True
    after[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(inside & before[:size])
    ends = np.flatnonzero(inside & after) + 1
    power = _power(size + 1)[0]
    running = np.zeros(size + 1, np.uint64)
    np.cumsum(_WEIGHT[data] * power[:size], out=running[1:])
    found = Words(starts, ends, np.zeros(0, np.uint64), np.searchsorted(starts, offsets), running)
    found.hashes = found.span_hashes(starts, ends)
    return found


def shingles(found: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and where each text's runs begin.

    A text of fewer words, but not none, has one run: the whole of it.
    """
    hashes, offsets = found.hashes, found.offsets
    counts = np.diff(offsets)
    total = len(hashes)
    factor = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 2**64)) for k in range(size)]
    run = np.zeros(max(0, total - size + 1), np.uint64)
    for k in range(size):
        run += hashes[k : k + len(run)] * factor[size - 1 - k]
    text_of = np.repeat(np.arange(len(counts)), counts)
    keep = text_of[: len(run)] == text_of[size - 1 : size - 1 + len(run)]
    short = np.flatnonzero((counts > 0) & (counts < size))
    per_text = np.maximum(counts - size + 1, 0)
    run = mixed(run[keep])
    if len(short):
        own = []
        for text in short:
            value = counts[text]
            for word in hashes[offsets[text] : offsets[text + 1]]:
                value = (int(value) * 0xC2B2AE3D27D4EB4F + int(word)) % 2**64
            own.append(value)
        at = np.concatenate([[0], np.cumsum(per_text)])[short]
        run = np.insert(run, at, mixed(np.array(own, np.uint64)))
        per_text[short] = 1
    return run, np.concatenate([[0], np.cumsum(per_text)])
