"""Words of whole texts as 64-bit hashes, a column of texts at a time.

Texts arrive as Arrow string columns. Their bytes are hashed together by one polynomial over
byte codes: a running sum gives the sum of any word, and the inverse power of its start makes
that sum independent of its place. No word becomes a Python string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Word separators: space and the controls from tab to carriage return.
BLANK = bytes([0x20, *range(0x09, 0x0E)])
#: Separators of letter and digit words: all of ASCII but 0-9 and a-z (after lower-casing).
NOT_ALNUM = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))

PIECE = 1 << 18
BATCH_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Words(NamedTuple):
    """Words of several texts: hashes, byte spans in `data`, and the first word of each text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    row_start: np.ndarray

    def of(self, row: int) -> slice:
        return slice(self.first[row], self.first[row + 1])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing step of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text starts in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def bounded_batches(spark: SparkSession) -> None:
    """Cap the Arrow batches of the session by bytes of text; by rows alone they have no bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(column: pa.Array, most: int = PIECE << 3) -> Iterator[tuple[int, int]]:
    """A string column cut into runs of rows (first, end) of about `most` bytes of text, or of
    one longer text, so that the arrays of a task stay small."""
    _, row_start = text_bytes(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(row_start, row_start[a] + most, "right")) - 1)
        yield a, b
        a = b


def sliced(batches: Iterable[pa.RecordBatch], text: int, most: int = PIECE << 3) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of their column number `text`."""
    for batch in batches:
        for a, b in slices(batch.column(text), most):
            yield batch.slice(a, b - a)


def hasher(separators: bytes = BLANK, lower: bool = True, digits: bool = False) -> Callable[[pa.Array], Words]:
    """A function from a string column to its words.

    `lower` folds A-Z only; `digits` reads every ASCII digit as 0. Built once per task: it
    holds the power tables, which grow to the longest word met.
    """
    fold = np.arange(256)
    if lower:
        fold[65:91] += 32
    if digits:
        fold[48:58] = 48
    code = mix(fold.astype(np.uint64) + np.uint64(0x51ED270B))
    gap = np.isin(fold, np.frombuffer(separators, np.uint8))
    tables = {"power": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}

    def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(tables["power"]) < n:
            for name, base in (("power", BASE), ("inverse", INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                tables[name] = np.cumprod(steps, dtype=np.uint64)
        return tables["power"], tables["inverse"]

    def words(column: pa.Array) -> Words:
        data, row_start = text_bytes(column)
        if not len(data):
            none = np.zeros(0, np.int64)
            return Words(none.view(np.uint64), none, none, row_start * 0, data, row_start)
        inside = ~gap[data]
        after = np.zeros(len(data), bool)
        after[1:] = inside[:-1]
        after[row_start[row_start < len(data)]] = False
        before = np.zeros(len(data), bool)
        before[:-1] = inside[1:]
        before[row_start[row_start > 0] - 1] = False
        start = np.flatnonzero(inside & ~after)
        end = np.flatnonzero(inside & ~before) + 1
        out = np.empty(len(start), np.uint64)
        cuts = np.searchsorted(start, np.arange(0, len(data), PIECE))
        cuts = [*dict.fromkeys(cuts.tolist()), len(start)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                s, e = start[a], end[b - 1]
                power, inverse = powers(max(PIECE, int(e - s)))
                sums = np.zeros(e - s + 1, np.uint64)
                np.cumsum(code[data[s:e]] * power[: e - s], out=sums[1:])
                out[a:b] = (sums[end[a:b] - s] - sums[start[a:b] - s]) * inverse[start[a:b] - s]
        first = np.searchsorted(start, row_start)
        return Words(mix(out + (end - start).astype(np.uint64)), start, end, first, data, row_start)

    return words


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` consecutive words that start at each place; the last places, which
    have fewer, are left out. Windows across texts are in it: mask them with `whole`."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * np.uint64(pow(BASE, 2 * j + 1, 1 << 64))
    return mix(total)


def whole(first: np.ndarray, size: int) -> np.ndarray:
    """Whether the window of `size` words that starts at each place stays in its text."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(first[-1])
    return left[: max(0, int(first[-1]) - size + 1)] >= size


def shingles(found: Words, row: int, grams: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of one text, sorted: windows of `size` words, or the whole
    sequence if it is shorter, or none."""
    a, b = int(found.first[row]), int(found.first[row + 1])
    if b - a >= size:
        return np.unique(grams[a : b - size + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    return windows(found.hash[a:b], b - a) ^ np.uint64(b - a)


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column whose cells are stretches of `data`, cut at `offsets` (in items)."""
    at = (offsets * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]
    )


def unpacked(column: pa.Array, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Items of all cells of a binary column, and the number in each."""
    cells = column.to_pylist()
    counts = np.array([len(c) if c else 0 for c in cells], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(c for c in cells if c), kind), counts
