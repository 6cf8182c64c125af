"""Fill-in-the-middle: a text is cut in three, and its middle is moved to the end.

Cuts count units: characters, words or lines. Each byte has a class by what begins there, and a wavelet matrix over the classes
answers how many bytes of a class come before a place. Such ranks add up to the boundaries of a unit before it; the place of
a cut is found by bisection on them, for all texts of a slice in step.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS_BY_SPACE, slices, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of a hundred texts so many are cut, and of a hundred cut ones so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: Classes of bytes: within a character, beginning a character only, or with it a word, a line, or both.
_WITHIN, _CHAR, _WORD, _LINE, _BOTH = range(5)
#: The classes at which a unit begins.
UNITS = {"chars": (_CHAR, _WORD, _LINE, _BOTH), "words": (_WORD, _BOTH), "lines": (_LINE, _BOTH)}


class WaveletMatrix:
    """Rank queries over a sequence of small numbers."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for k in reversed(range(bits)):
            bit = (sequence >> k & 1).astype(bool)
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((k, words, before, len(bit) - int(before[-1])))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How many of the first at[i] numbers are `value`."""
        start = np.zeros(1, np.int64)
        for k, words, before, zeros in self.levels:
            ones = lambda i: before[i >> 6] + np.bitwise_count(words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))  # noqa: B023, E731
            start, at = (zeros + ones(start), zeros + ones(at)) if value >> k & 1 else (start - ones(start), at - ones(at))
        return at - start


def byte_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 texts that lie one behind the other."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    after = lambda m: np.concatenate([[False], m[:-1]]) | first
    word = WORDS_BY_SPACE[data] & after(~WORDS_BY_SPACE[data])
    line = after(data == 10)
    return np.where((data & 0xC0) == 0x80, _WITHIN, 1 + word + 2 * line.astype(np.uint8)).astype(np.uint8)


class Boundaries:
    """Boundaries of a unit in texts that lie one behind the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        self.offsets, self.matrix = offsets, WaveletMatrix(byte_classes(data, offsets), 3)
        others = tuple({*range(5)} - {*UNITS[unit]})
        self.classes, self.rest = (UNITS[unit], False) if len(UNITS[unit]) <= len(others) else (others, True)
        self.before = self.count(offsets)
        self.units = np.diff(self.before)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Boundaries in the first at[i] bytes: the ranks of their classes, or all bytes less the ranks of the others."""
        ranks = reduce(np.add, (self.matrix.rank(c, at) for c in self.classes))
        return at - ranks if self.rest else ranks

    def place(self, units: np.ndarray) -> np.ndarray:
        """The byte of each text after so many of its units: the next unit's first byte, or an end of the text."""
        low, high = self.offsets[:-1].copy(), self.offsets[1:].copy()
        goal = self.before[:-1] + units
        while (low < high).any():  # the first place with more boundaries up to and with it than the goal
            middle = (low + high) >> 1
            more = self.count(np.minimum(middle + 1, self.offsets[-1])) > goal
            low, high = np.where(more | (low >= high), low, middle + 1), np.where(more, np.minimum(high, middle), high)
        return np.where(units <= 0, self.offsets[:-1], np.where(units >= self.units, self.offsets[1:], low))


_PARTS = T.StructType().add("n", "long").add("first", "long").add("second", "long").add("prefix", "string").add("middle", "string").add("suffix", "string")


def thirds_udf(unit: str = "chars") -> Callable[[Column, Column, Column], Column]:
    """A Column function (text, a, b) -> n units, the cuts a and b modulo n + 1 in order, and the text's three parts."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    @F.arrow_udf(_PARTS)
    def thirds(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        a, b = (x.to_numpy(zero_copy_only=False) for x in (a, b))
        found = []
        for i, j in slices(offsets):
            raw, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            bounds = Boundaries(raw, ends, unit)
            first, second = np.sort([a[i:j] % (bounds.units + 1), b[i:j] % (bounds.units + 1)], axis=0)
            p, q = bounds.place(first), bounds.place(second)
            cuts = np.stack([ends[:-1], p, q, ends[1:]])
            text = raw.tobytes()
            parts = [[text[x:y].decode() for x, y in zip(*cuts[k : k + 2].tolist(), strict=True)] for k in range(3)]
            found.append((bounds.units, first, second, *parts))
        columns = [pa.chunked_array([pa.array(f[k], kind) for f in found], kind).combine_chunks() for k, kind in enumerate([pa.int64()] * 3 + [pa.string()] * 3)]
        return pa.StructArray.from_arrays(columns, names=_PARTS.names)

    return thirds


def drawn(key: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned numbers of 32 bits, the same on every run: of the SHA-256 of seed, colon and key (a null key: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "chars", seed: str = SEED) -> DataFrame:
    """(key, n, form, prefix_units, middle_units, output) of each row: the text (plain), or its parts behind their marks, as
    prefix, suffix, middle (psm) or suffix, prefix, middle (spm). Counts of a plain row are null.

    Null and empty texts, texts that hold a mark, and a share by hash stay plain. Cuts depend on the key and the number of units
    alone, so repeated rows have equal results, and rows without a key share their draws; an empty table gives none. Texts are cut
    whole, however long. Other columns are left out, so names can't clash.
    """
    a, b, share, order = drawn(F.col(key), seed)
    whole = F.coalesce(text, F.lit(""))
    marked = reduce(lambda x, y: x | y, (F.contains(whole, F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)))
    plain = (whole == "") | marked | (share % 100 >= CUT_PERCENT)
    form = F.when(plain, "plain").when(order % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")
    rows = docs.select(F.col(key), whole.alias("t"), form.alias("form"), thirds_udf(unit)(F.col(text), a, b).alias("p"))
    parts = {m: F.concat(F.lit(m), f"p.{name}") for m, name in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle"))}
    output = F.when(F.col("form") == "psm", F.concat(*parts.values())).when(F.col("form") == "spm", F.concat(parts[SUFFIX], parts[PREFIX], parts[MIDDLE])).otherwise(F.col("t"))
    cut = F.col("form") != "plain"
    return rows.select(key, "p.n", "form", F.when(cut, F.col("p.first")).alias("prefix_units"), F.when(cut, F.col("p.second") - F.col("p.first")).alias("middle_units"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output, exactly: a cut text holds no mark, and no mark can begin in one part and end in the next."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *order: F.concat(*(F.get(parts, F.lit(i)) for i in order))
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).when(form == "plain", output)
