"""Audio samples as arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def noise_gate(x: Column, threshold: float = 100) -> Column:
    """Silence instead of a chunk that stays below the threshold."""
    return F.when(peak(x) < threshold, F.transform(x, lambda v: v * 0)).otherwise(x)


def rms(x: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")), F.size(x)))


def rms_normalize(x: Column, target: float = 0.05, floor: float = 0.003) -> Column:
    """Scaled to a level, unless it is silent."""
    level = rms(x)
    return F.when(level < floor, F.transform(x, lambda v: v.cast("double"))).otherwise(F.transform(x, lambda v: v.cast("double") * F.try_divide(F.lit(target), level)))


def pad_or_trim(x: Column, length: int, side: str = "right") -> Column:
    """Zeros on a side up to a length, or cut to it."""
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size(x)))
    x = F.slice(x, 1, length)
    return F.concat(x, zeros) if side == "right" else F.concat(zeros, x)


def pcm16_to_float(x: Column) -> Column:
    return F.transform(x, lambda v: v / F.lit(32768.0))


def float_to_pcm16(x: Column) -> Column:
    return F.transform(x, lambda v: (v * F.lit(32767.0)).cast("int"))


def mix_channels(channels: Column) -> Column:
    """The mean over channels (array of arrays of one length)."""
    n = F.size(channels)
    total = F.aggregate(channels, F.transform(F.element_at(channels, 1), lambda v: F.lit(0.0)), lambda a, c: F.zip_with(a, c, lambda p, q: p + q))
    return F.transform(total, lambda v: v / n)


def crossfade(before: Column, x: Column, length: int) -> Column:
    """The last `length` samples of the chunk before over the first ones of this chunk, with sine ramps, then the rest.

    Chunks must be as long as `length` at least. A null or empty chunk before leaves the chunk as it is.
    """
    fade = F.array(*[F.lit(math.sin(0.5 * math.pi * i / length)) for i in range(length)])
    tail, head = F.slice(before, -length, length), F.slice(x, 1, length)
    out = F.zip_with(F.zip_with(tail, F.reverse(fade), lambda a, b: a * b), F.zip_with(head, fade, lambda a, b: a * b), lambda a, b: a + b)
    return F.when(F.coalesce(F.size(before), F.lit(0)) <= 0, x).otherwise(F.concat(out, F.slice(x, length + 1, F.greatest(F.size(x) - length, F.lit(0)))))
