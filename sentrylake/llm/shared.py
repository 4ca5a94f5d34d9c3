"""What the corpus operators share: written tables, column expressions, and byte-level words."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.storage import Scratch, work_dir  # noqa: F401  for the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tasks_for(spark: SparkSession, total_bytes: int, per_task: int = 24 << 20) -> int:
    """A number of partitions that follows the input, at least the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // per_task))


# ---------------------------------------------------------------- memory of Python workers


def trim() -> None:
    """Gives freed memory back. Workers live on from task to task, and their allocators would keep each one's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(function):
    """A function of Arrow batches whose task ends with ``trim``."""

    def run(batches):
        yield from function(batches)
        trim()

    return run


# ---------------------------------------------------------------- column expressions


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the built-in byte path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separator: str) -> Column:
    """Non-empty pieces between runs of ``separator`` (a Java class); null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{separator}+"), lambda w: w != "")


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once per row, here.

    Filters are pushed through a projection by copying its expressions into them; inside a lambda that repeats array
    work per element. A generated column can't be copied.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


# ---------------------------------------------------------------- words of Arrow text, vectorised

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit; distinct inputs stay distinct.

    Its constants, and the step above, are the fixed values of the public SplitMix64 generator.
    """
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = 4 << 20):
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes; null is empty; a long row stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-white bytes, never over a row's end, and each row's first word (n + 1)."""
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LOW_BYTES = np.concatenate(([0xFFFFFFFFFFFFFFFF], (np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)) - np.uint64(1))).astype(np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, longest: int = 64) -> np.ndarray:
    """64-bit hash of each word's bytes, the same wherever the word stands.

    Eight bytes at a time go through ``mix``, which is not linear; words over ``longest`` bytes take BLAKE2.
    """
    if fold:
        data = _FOLD[data]
    size = ends - starts
    out = mix((size + 1).astype(np.uint64) * _STEP)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    rows = np.flatnonzero(size <= longest)
    at, left = starts[rows], size[rows]
    while len(rows):
        part = padded[at[:, None] + np.arange(8)].view("<u8").ravel() & _LOW_BYTES[np.where(left < 8, left, 0)]
        out[rows] = mix(out[rows] + _STEP ^ part)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > longest).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_GRAM = mix(np.arange(1, 257, dtype=np.uint64) * _STEP) | np.uint64(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word hashes from each position on (multilinear); length len(words) - k + 1, over row ends too."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out += words[j : j + n] * _GRAM[j % 256]
    return mix(out)
