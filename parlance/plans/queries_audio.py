"""Queries of audio samples; the rows of embeddings stand for chunks of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio as W
from ..operators import channels as C
from ..operators import chunks as H
from . import fixtures as D
from .registry import query

_SAMPLES = "emb as (select vec_id, label, list_transform(embedding, lambda x: x::double) as x, len(embedding) as n from embeddings)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _sum(x: Column) -> Column:
    return F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6)


@query("select vec_id, round(case when list_max(list_transform(x, lambda v: abs(v))) < 0.3 then 0 else list_sum(x) end, 6) as total from emb", _SAMPLES)
def p6_noise_gate(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("vec_id", _sum(W.noise_gate(F.col("x"), 0.3)).alias("total"))


_RMS = "rm as (select *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / n) as rms from emb)"


@query("select vec_id, round(rms, 6) as rms, round(case when rms < 0.1 then list_sum(x) else list_sum(list_transform(x, lambda v: v * (0.05::double / rms))) end, 6) as total from rm", _SAMPLES, _RMS)
def f17_rms_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("vec_id", F.round(W.rms(F.col("x")), 6).alias("rms"), _sum(W.rms_normalize(F.col("x"), 0.05, 0.1)).alias("total"))


@query("select vec_id, round(x[1], 6) as padded_right, 0::double as padded_left, round(list_sum(x[1:10]), 6) as cut, 100 as n from emb", _SAMPLES)
def f18_pad_or_trim(spark: SparkSession, d: str) -> DataFrame:
    right, left = W.pad_or_trim(F.col("x"), 100), W.pad_or_trim(F.col("x"), 100, "left")
    return _samples(spark, d).select("vec_id", F.round(F.get(right, F.lit(0)), 6).alias("padded_right"), F.get(left, F.lit(0)).alias("padded_left"), _sum(W.pad_or_trim(F.col("x"), 10)).alias("cut"), F.greatest(F.size(left), F.size(right)).alias("n"))


@query("""select vec_id, list_sum(list_transform(x, lambda v: trunc(v * 32767)::int))::bigint as pcm, round(list_sum(list_transform(x, lambda v: trunc(v * 32767)::int::double / 32768)), 6) as back, round(list_sum(list_transform(x, lambda v: (v + v * 3) / 2)), 5) as mixed from emb""", _SAMPLES)
def f19_pcm_and_mix(spark: SparkSession, d: str) -> DataFrame:
    pcm = W.float_to_pcm16(F.col("x"))
    mixed = W.mix_channels(F.array(F.col("x"), F.transform("x", lambda v: v * 3)))
    total = F.aggregate(pcm, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return _samples(spark, d).select("vec_id", total.alias("pcm"), _sum(W.pcm16_to_float(pcm)).alias("back"), F.round(F.aggregate(mixed, F.lit(0.0), lambda a, v: a + v), 5).alias("mixed"))


@query("""select vec_id, round(case when b is null then list_sum(x) else list_sum(list_transform(range(0, 8), lambda i: b[57 + i] * sin(0.5::double * pi() * (7 - i) / 8) + x[i + 1] * sin(0.5::double * pi() * i / 8))) + list_sum(x[9:]) end, 6) as total
 from (select *, lag(x) over (partition by label order by vec_id) as b from emb)""", _SAMPLES)
def w17_crossfade_chunks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("x").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = _samples(spark, d).withColumn("b", before)
    return rows.select("vec_id", _sum(W.crossfade(F.col("b"), F.col("x"), 8)).alias("total"))


@query("select vec_id, i::int as chunk_idx, round(list_sum(x[i * 10 + 1 : i * 10 + 10]), 6) as total, least(10, n - i * 10)::int as size from (select *, unnest(range(0, ceil(n::double / 10)::bigint)) as i from emb)", _SAMPLES)
def x4_chunk_audio(spark: SparkSession, d: str) -> DataFrame:
    rows = H.chunk_audio(_samples(spark, d), 10, samples="x")
    return rows.select("vec_id", "chunk_idx", _sum(F.col("x")).alias("total"), F.size("x").alias("size"))


_CHUNKED = "ck as (select label as file_id, row_number() over (partition by label order by vec_id) - 1 as chunk_idx, x from emb)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return _samples(spark, d).select(F.col("label").alias("file_id"), F.lit(0).alias("channel"), place.alias("chunk_idx"), F.col("x").alias("samples"))


@query("""select file_id, chunk_idx::int as chunk_idx, len(w[greatest(1, len(w) - 99):])::int as n, round(list_sum(w[greatest(1, len(w) - 99):]), 6) as total
 from (select file_id, chunk_idx, flatten(list(x) over (partition by file_id order by chunk_idx rows between 2 preceding and current row)) as w from ck)""", _SAMPLES, _CHUNKED)
def x5_context_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = H.context_frames(_chunks(spark, d), 64, 100)
    return rows.select("file_id", "chunk_idx", F.size("frame").alias("n"), _sum(F.col("frame")).alias("total"))


@query("""select file_id, (p // 150)::bigint as chunk_idx, count(*)::int as n, round(sum(v), 5) as total from (select file_id, row_number() over (partition by file_id order by chunk_idx, i) - 1 as p, v from (select file_id, chunk_idx, unnest(range(1, len(x) + 1)) as i, unnest(x) as v from ck)) group by all""", _SAMPLES, _CHUNKED)
def x6_rechunk(spark: SparkSession, d: str) -> DataFrame:
    rows = H.rechunk(_chunks(spark, d), 150)
    return rows.select("file_id", "chunk_idx", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


_TURNS = """ac as (select label as file_id, vec_id % 2 as channel, row_number() over (partition by label, vec_id % 2 order by vec_id) - 1 as chunk_idx, x from emb),
sp as (select file_id, channel, chunk_idx * 64 + i - 1 as p, x[i] as v from (select *, unnest(range(1, 65)) as i from ac)),
tn as (select distinct file_id, k as turn, chr((65 + k % 2)::int) as speaker, k * 3.1::double as start_secs, k * 3.1::double + 2.3::double as end_secs from ac, (select unnest(range(0, 6)) as k)),
fr as (select tn.file_id, speaker, channel, count(*) as n, sum(abs(v)) as total from tn join sp on tn.file_id = sp.file_id and p >= trunc(start_secs * 64) and p < trunc(end_secs * 64) group by all)"""


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label", F.col("vec_id") % 2).orderBy("vec_id")) - 1
    chunks = _samples(spark, d).select(F.col("label").alias("file_id"), (F.col("vec_id") % 2).alias("channel"), place.alias("chunk_idx"), F.col("x").alias("samples"))
    k = chunks.select("file_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    letter = F.when(F.col("k") % 2 == 0, "A").otherwise("B")
    turns = k.select("file_id", letter.alias("speaker"), (F.col("k") * F.lit(3.1)).alias("start_secs"), (F.col("k") * F.lit(3.1) + F.lit(2.3)).alias("end_secs"))
    return turns, C.segment_frames(turns, chunks, 64, 64)


@query("select file_id, speaker, channel, n, round(total, 5) as total from fr", _SAMPLES, _TURNS)
def j6_segment_frames(spark: SparkSession, d: str) -> DataFrame:
    _, frames = _frames(spark, d)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.abs(v))
    return frames.groupBy("file_id", "speaker", "channel").agg(F.sum(F.size("samples")).alias("n"), F.round(F.sum(total), 5).alias("total"))


@query("""select t.file_id, t.speaker, channel, case when channel is null then 0 else round(d, 6) end as duration_secs from (select file_id, speaker, sum(end_secs - start_secs) as d from tn group by all) t
 left join (select file_id, speaker, arg_max(channel, total / n) as channel from fr group by all) using (file_id, speaker)""", _SAMPLES, _TURNS)
def a6_speaker_channel_map(spark: SparkSession, d: str) -> DataFrame:
    turns, frames = _frames(spark, d)
    return C.speaker_channel_map(frames, turns).withColumn("duration_secs", F.round("duration_secs", 6))
