"""Chunks of audio: cutting, context before each chunk, other chunk sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import pad_or_trim


def chunk_audio(df: DataFrame, size: int, pad: bool = False, samples: str = "samples") -> DataFrame:
    """chunk_idx and samples of chunks of `size`; the last is short, or filled up with zeros."""
    n = F.greatest(F.lit(1), F.ceil(F.size(samples) / size)).cast("int")
    rows = df.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    part = F.slice(samples, F.col("chunk_idx") * size + 1, size)
    return rows.withColumn(samples, pad_or_trim(part, size) if pad else part)


def context_frames(df: DataFrame, size: int, context: int, keys: tuple[str, ...] = ("file_id", "channel")) -> DataFrame:
    """frame: a chunk with what stands before it, the last max(size, context) samples."""
    before = Window.partitionBy(*keys).orderBy("chunk_idx").rowsBetween(-(-(-context // size)), 0)
    whole = F.flatten(F.collect_list("samples").over(before))
    n = F.least(F.size(whole), F.lit(max(size, context)))
    return df.withColumn("frame", F.slice(whole, F.size(whole) - n + 1, n))


def rechunk(df: DataFrame, size: int, keys: tuple[str, ...] = ("file_id", "channel")) -> DataFrame:
    """(keys, chunk_idx, samples): frames of any length as chunks of one size; the rest is carried on, and the last may be short."""
    w = Window.partitionBy(*keys).orderBy("chunk_idx")
    rows = df.withColumn("_end", F.sum(F.size("samples")).over(w)).withColumn("_at", F.col("_end") - F.size("samples")).filter(F.size("samples") > 0)
    rows = rows.withColumn("_to", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((F.col("_end") - 1) / size))))
    lo = F.greatest(F.col("_to") * size, F.col("_at"))
    hi = F.least((F.col("_to") + 1) * size, F.col("_end"))
    part = F.slice("samples", (lo - F.col("_at") + 1).cast("int"), (hi - lo).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(lo.alias("lo"), part.alias("x"))))
    return rows.groupBy(*keys, F.col("_to").alias("chunk_idx")).agg(F.flatten(F.transform(parts, lambda p: p["x"])).alias("samples"))
