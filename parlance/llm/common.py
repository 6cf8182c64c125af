"""Pieces shared by the corpus operators: shared storage and vectorised word finding."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Texts are worked on in slices of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 1 << 20
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of words that ASCII white space parts.
WORDS_BY_SPACE = np.ones(256, bool)
WORDS_BY_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Keys that hold more than this share of the rows are joined by a broadcast, of 1 / HOT_SHARE rows at most.
HOT_SHARE = 1e-3


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns a reader of it: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that is free in this process back to the machine. Spark keeps its workers, which would hold it while others work."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, and release() when a task's batches end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def joined_hot(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """The inner join with a table of one row a key and the number of left rows that have it. No task gets a hot key whole."""
    right = stored(right, "joined")
    least = max(1000.0, HOT_SHARE * left.count())
    hot = F.broadcast(right.filter(F.col(count) > least).drop(count))
    cold = right.filter(F.col(count) <= least).drop(count)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows (from, to) that hold about `most` bytes each, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Starts, ends and row of every maximal run of bytes for which inside[byte] holds; runs end with their row."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    m = inside[data]
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    starts = m.copy()
    starts[1:] &= ~m[:-1] | opens[1:n]
    ends = m.copy()
    ends[:-1] &= ~m[1:] | opens[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the multiplier and of its inverse, kept for the largest slice so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            a, b = np.full(n, _MUL), np.full(n, _INV)
            a[0] = b[0] = np.uint64(1)
            self.up, self.down = np.multiply.accumulate(a), np.multiply.accumulate(b)
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, from prefix sums of a polynomial."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _MUL + h[j : j + n]
    return mixed(total)
