"""Streams over the tables, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import jobs as J
from . import fixtures as D
from . import queries_text as Q
from .registry import query


def stream(spark: SparkSession, d: str, name: str, files: int = 1000) -> DataFrame:
    """A table as a stream of its files: those of a folder, or one file, which a stream can only find in its folder."""
    path = f"{d}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    if all(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return reader.parquet(path)


def finished(df: DataFrame) -> DataFrame:
    """What a stream gives until its source is used up: written to the shared folder, then read."""
    spark = df.sparkSession
    path = shared_folder(spark, "stream")
    job = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


_Z = """z0 as (select user_id as session_id, event_id as chunk_idx, value, least(row_number() over (partition by user_id order by event_id), 20) as n from events),
z1 as (select *, n < 5 or n % 5 = 0 as upd, avg(value) over f as m, case when n > 1 then stddev_pop(value) over f else 1 end as s from z0 window f as (partition by session_id order by chunk_idx rows between 19 preceding and current row)),
z2 as (select *, coalesce(last_value(case when upd then m end ignore nulls) over w, 0) as fm, coalesce(last_value(case when upd then s end ignore nulls) over w, 1) as fs from z1 window w as (partition by session_id order by chunk_idx rows between unbounded preceding and 1 preceding))"""


@query("select session_id, chunk_idx, value, round((value - fm) / nullif(fs, 0), 5) as z from z2", _Z)
def t1_stream_rolling_zscore(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_idx"), "value", F.col("ts").cast("timestamp").alias("ts"))
    return finished(J.stream_rolling_zscore(rows, 20, 5, "30 days", "1 day")).withColumn("z", F.round("z", 5))


@query("""select session_id, chunk_idx, z, inactive_chunks, inactive_chunks * 0.1::double >= 0.3::double and (inactive_chunks - 1) * 0.1::double < 0.3::double as finalize from (select session_id, chunk_idx, z, i - coalesce(max(case when z >= 0 then i end) over (partition by session_id order by chunk_idx), 0) as inactive_chunks
 from (select user_id as session_id, event_id as chunk_idx, value - 50 as z, row_number() over (partition by user_id order by event_id) as i from events))""")
def t2_stream_inactivity(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_idx"), (F.col("value") - 50).alias("z"), F.col("ts").cast("timestamp").alias("ts"))
    return finished(J.stream_inactivity(rows, 0.1, 0.3, "30 days", "1 day"))


_ACTIVE = """a0 as (select user_id as session_id, event_id as chunk_idx, ts, value - 50 as z1, json_extract_string(props, '$.k')::double - 40 as z2, (value - 20) / 20 as event_z, case when value > 60 then 'agent' else 'user' end as speaker,
  row_number() over (partition by user_id order by event_id) as i from events),
a1 as (select *, coalesce(lag(z2) over (partition by session_id order by chunk_idx), 0) < 0 as below from a0),
a2 as (select *, i - coalesce(max(case when z1 >= 0 then i end) over u, 0) as n1, i - coalesce(max(case when z2 >= 0 then i end) over u, 0) as n2, max(case when z2 >= 0 and below then i - 1 end) over u * 0.1::double as start
  from a1 window u as (partition by session_id order by chunk_idx)),
a3 as (select *, n1 * 0.1::double >= 0.3::double and (n1 - 1) * 0.1::double < 0.3::double as finalize, n2 * 0.1::double >= 0.2::double and event_z >= 1 and speaker = 'user' as force_transcription, least(n1, n2) * 0.1::double >= 0.3::double as force_response from a2),
ends as (select session_id, max(ts) as last, max_by(n1, chunk_idx) as n1, max_by(n2, chunk_idx) as n2, max_by(start, chunk_idx) as start from a3 group by 1),
silent as (select *, last + to_milliseconds(round((0.3::double - n1 * 0.1::double) * 1000)::bigint) as ring from ends where round((0.3::double - n1 * 0.1::double) * 1000) > 0)"""


@query("""select session_id, chunk_idx, strftime(ts, '%Y-%m-%d %H:%M:%S') as "at", round(n1 * 0.1::double, 3) as ch1_inactive_secs, round(n2 * 0.1::double, 3) as ch2_inactive_secs, round(start, 3) as activity_start_secs, finalize, force_transcription, force_response from a3
 union all select session_id, null, strftime(ring, '%Y-%m-%d %H:%M:%S'), 0.3::double, round(n2 * 0.1::double + 0.3::double - n1 * 0.1::double, 3), round(start, 3), true, false, round(least(0.3::double, n2 * 0.1::double + 0.3::double - n1 * 0.1::double), 6) >= 0.3::double
 from silent where ring < (select max(ts) from events) - interval '10 seconds'""", _ACTIVE)  # fmt: skip
def t2_stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Two channels with the flags that force an answer, and a row for each session that falls silent."""
    rows = stream(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_idx"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") - 50).alias("z1"), (F.get_json_object("props", "$.k").cast("double") - 40).alias("z2"),
        ((F.col("value") - 20) / 20).alias("event_z"), F.when(F.col("value") > 60, "agent").otherwise("user").alias("probable_speaker"),
    )
    out = finished(J.stream_activity(rows, 0.1, 0.2, 0.3, 0.3, "30 days", "10 seconds"))
    secs = [F.round(c, 3).alias(c) for c in ("ch1_inactive_secs", "ch2_inactive_secs", "activity_start_secs")]
    return out.select("session_id", "chunk_idx", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), *secs, "finalize", "force_transcription", "force_response")


@query("""select stage, strftime(b, '%Y-%m-%d %H:%M:%S') as start, round(f, 4) as factor, n from (select event_type as stage, time_bucket(interval '1 hour', ts) as b, avg(0.1::double / (value + 1e-8::double)) as f, count(*) as n from events group by all)
 where b + interval '1 hour' <= (select max(ts) from events) - interval '10 minutes'""")
def t3_stream_realtime_factor(spark: SparkSession, d: str) -> DataFrame:
    """Windows of an hour; those that the watermark has passed."""
    rows = stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value").alias("elapsed_secs"))
    out = finished(J.stream_realtime_factor(rows, 0.1, "1 hour", "10 minutes"))
    return out.select("stage", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("factor", 4).alias("factor"), "n")


@query("""select session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval '3 hours', '%Y-%m-%d %H:%M:%S') as end, count(*) as n
 from (select *, sum(new) over (partition by session_id order by ts, event_id) as s from (select user_id as session_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '3 hours' then 0 else 1 end as new from events))
 group by session_id, s having max(ts) + interval '3 hours' <= (select max(ts) from events) - interval '10 minutes'""")
def t4_stream_activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Islands that three hours of silence close; those that the watermark has passed."""
    rows = stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"))
    out = finished(J.stream_activity_sessions(rows, "3 hours", "10 minutes"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("session_id", text("start"), text("end"), "n")


@query(rf"select doc_id, line_idx::int as line_idx, {Q._CLEAN} as clean, regexp_replace({Q._ASR}, '^\s+|\s+$', '', 'g') as asr, {Q._TTS} as tts from dl", D.LINES_SQL)
def t5_stream_clean_transcripts(spark: SparkSession, d: str) -> DataFrame:
    lines = stream(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    return finished(J.stream_clean_transcripts(lines, "line")).select("doc_id", "line_idx", "clean", "asr", "tts")


@query("select o_orderkey, case when o_orderkey % 100 < 5 then 'validation' else 'training' end as split from orders where o_orderkey % 100 <> 5")
def t6_stream_split(spark: SparkSession, d: str) -> DataFrame:
    validation, training = J.stream_split(stream(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), 5)
    return finished(validation.withColumn("split", F.lit("validation"))).unionByName(finished(training.withColumn("split", F.lit("training"))))
