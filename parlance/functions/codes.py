"""Audio codes as arrays and as characters, one for each code, from U+E000 on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 0xE000


def codes_to_chars(codes: Column, offset: int = OFFSET) -> Column:
    """A character for each code, beyond the basic plane too.

    Decoding takes a byte order mark (U+FEFF) away from the front, so one is put there: else a first code with that character was lost.
    """
    each = F.array_join(F.transform(codes, lambda x: F.lpad(F.hex((x + offset).cast("bigint")), 8, "0")), "")
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), each)), "UTF-32")


def chars_to_codes(chars: Column, offset: int = OFFSET) -> Column:
    return F.transform(F.regexp_extract_all(F.hex(F.encode(chars, "UTF-32")), F.lit("[0-9A-F]{8}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int") - offset)


def frame_major(codebooks: Column, size: int) -> Column:
    """Codes of several codebooks (array of arrays) frame by frame, each codebook in its own range."""
    n = F.size(F.element_at(codebooks, 1))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.transform(codebooks, lambda book, i: F.get(book, t) + i * size)))


def interleave_channels(channels: Column) -> Column:
    """Round robin over the channels (array of arrays), as long as all of them have a code. A fold over channels, linear in codes."""
    n = F.array_min(F.transform(channels, F.size))
    first = F.transform(F.get(channels, F.lit(0)), lambda x: F.array(x))
    rest = F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0)))
    frames = F.aggregate(rest, first, lambda acc, c: F.zip_with(acc, c, lambda a, x: F.concat(a, F.array(x))))
    return F.flatten(F.slice(frames, 1, n))


def split_channel(codes: Column, channel: int, channels: int) -> Column:
    """Every n-th code; codes of an incomplete last frame are left out (see hanging_codes)."""
    return F.filter(F.slice(codes, 1, F.size(codes) - F.size(codes) % channels), lambda x, i: i % channels == channel)


def hanging_codes(codes: Column, channels: int) -> Column:
    """The codes of the incomplete last frame."""
    return F.slice(codes, F.size(codes) - F.size(codes) % channels + 1, channels)


def swap_agent_channel(channels: Column, agent: Column) -> Column:
    """The agent's channel first, channel 0 in its place."""
    return F.transform(channels, lambda c, i: F.when(i == 0, F.get(channels, agent)).when(i == agent, F.get(channels, F.lit(0))).otherwise(c))


def secs_to_pos(secs: Column, framerate: float, num_codebooks: int = 1, unit: int | None = None) -> Column:
    """Position of a time, cut to a whole code and rolled back to a whole unit (a frame by default)."""
    pos = (secs * F.lit(float(framerate)) * F.lit(num_codebooks)).cast("bigint")
    return pos - pos % (unit or num_codebooks)


def pos_to_secs(pos: Column, framerate: float, channels: int = 1) -> Column:
    return pos / F.lit(float(framerate * channels))


def slice_by_time(codes: Column, start: Column, end: Column, framerate: float, channels: int = 2) -> Column:
    """Codes of [start, end) seconds from interleaved channels; null is the beginning or the end."""
    a = F.coalesce(secs_to_pos(start, framerate, channels, channels), F.lit(0)).cast("int")
    b = F.coalesce(secs_to_pos(end, framerate, channels, channels), F.size(codes)).cast("int")
    return F.slice(codes, a + 1, F.greatest(b - a, F.lit(0)))


def write_back(codes: Column, new: Column, start: Column, channel: int, channels: int = 2) -> Column:
    """codes with those of one channel from a frame on replaced by new ones."""
    return F.transform(codes, lambda x, i: F.when((i >= start) & ((i - start) % channels == channel) & (((i - start) / channels).cast("int") < F.size(new)), F.get(new, ((i - start) / channels).cast("int"))).otherwise(x))


def token_ids(codes: Column, vocab_start: int) -> Column:
    return F.transform(codes, lambda x: x + vocab_start)
