"""Audio files, their transcripts, and which channel a speaker is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CHANNEL_MAP


def match_audio_to_transcripts(transcripts: DataFrame, audio: DataFrame, extensions: tuple[str, ...] = (".wav", ".mp3", ".flac", ".sph"), num_channels: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(matched, missing): transcripts (stem) with the audio file (stem, path) of the first extension that exists; those without one.

    With num_channels, files of one channel are dropped from the matches.
    """
    rank = F.coalesce(*[F.when(F.endswith("path", F.lit(e)), F.lit(i)) for i, e in enumerate(extensions)])
    known = audio.withColumn("_rank", rank).filter("_rank is not null")
    extra = [F.min_by(c, "_rank").alias(c) for c in known.columns if c not in ("stem", "_rank")]
    best = known.groupBy("stem").agg(*extra)
    matched = transcripts.join(best, "stem")
    return (matched.filter(F.col(num_channels) > 1) if num_channels else matched), transcripts.join(best, "stem", "left_anti")


def skip_existing(files: DataFrame, done: DataFrame, key: str = "file_id", overwrite: bool = False) -> DataFrame:
    return files if overwrite else files.join(done.select(key), key, "left_anti")


def verify_pairs(src: DataFrame, dst: DataFrame, key: str = "stem") -> DataFrame:
    """(sources, paired, unpaired): how many sources (no "-raw" files) have a counterpart."""
    there = dst.select(key).distinct().withColumn("_there", F.lit(True))
    rows = src.filter(~F.endswith(key, F.lit("-raw"))).join(there, key, "left")
    return rows.agg(F.count("*").alias("sources"), F.count("_there").alias("paired"), (F.count("*") - F.count("_there")).alias("unpaired"))


def segment_frames(turns: DataFrame, chunks: DataFrame, sample_rate: int, chunk_samples: int) -> DataFrame:
    """(file_id, speaker, channel, chunk_idx, samples): the samples of a turn, [int(start * rate), int(end * rate)), chunk by chunk.

    Turns are spread over the numbers of the chunks that they touch, so the join is on equal keys; chunks are
    cut at a turn's ends, and a turn past the end of the audio is cut too.
    """
    at = lambda c: (F.col(c) * F.lit(float(sample_rate))).cast("bigint")
    rows = turns.select("file_id", "speaker", at("start_secs").alias("_a"), at("end_secs").alias("_b")).filter("_b > _a")
    rows = rows.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("_a") / chunk_samples), F.floor((F.col("_b") - 1) / chunk_samples))))
    rows = rows.join(chunks.select("file_id", "channel", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "samples"), ["file_id", "chunk_idx"])
    base = F.col("chunk_idx") * chunk_samples
    lo = F.greatest(F.col("_a") - base, F.lit(0)).cast("int")
    hi = F.least(F.col("_b") - base, F.size("samples").cast("bigint")).cast("int")
    return rows.select("file_id", "speaker", "channel", "chunk_idx", F.slice("samples", lo + 1, F.greatest(hi - lo, F.lit(0))).alias("samples"))


def speaker_channel_map(frames: DataFrame, turns: DataFrame) -> DataFrame:
    """(file_id, speaker, channel, duration_secs): the channel of the greatest mean magnitude (the lowest of equals); without samples null and 0."""
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.abs(v))
    level = frames.groupBy("file_id", "speaker", "channel").agg(F.sum(total).alias("_sum"), F.sum(F.size("samples")).alias("_n")).filter("_n > 0")
    best = level.groupBy("file_id", "speaker").agg(F.max_by("channel", F.struct((F.col("_sum") / F.col("_n")).alias("level"), (-F.col("channel")).alias("low"))).alias("channel"))
    secs = turns.groupBy("file_id", "speaker").agg(F.sum(F.col("end_secs") - F.col("start_secs")).alias("_secs"))
    out = secs.join(best, ["file_id", "speaker"], "left")
    return out.select("file_id", "speaker", "channel", F.when(F.col("channel").isNull(), F.lit(0.0)).otherwise(F.col("_secs")).alias("duration_secs"))


def channel_isolated(channel_map: DataFrame) -> DataFrame:
    """With isolated: no other speaker of the file has the same channel; null channels are the same."""
    shared = F.count("*").over(Window.partitionBy("file_id", F.coalesce("channel", F.lit(-1))))
    return channel_map.withColumn("isolated", shared == 1)


def channel_map_json(channel_map: DataFrame) -> DataFrame:
    """(file_id, json): {speaker: {channel, duration_secs}} of each file."""
    entry = F.struct("speaker", F.struct("channel", "duration_secs").alias("v"))
    options = {"ignoreNullFields": "false"}
    return channel_map.groupBy("file_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry))), options).alias("json"))


def parse_channel_map(df: DataFrame, json: str = "json") -> DataFrame:
    rows = df.select("file_id", F.explode(F.from_json(json, CHANNEL_MAP)).alias("speaker", "v"))
    return rows.select("file_id", "speaker", "v.channel", "v.duration_secs")


def folder_hours(seconds: Column) -> Column:
    return F.sum(seconds) / 3600
