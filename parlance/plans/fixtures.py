"""The tables as speech corpora: utterances, codes, sessions. Whole-number arithmetic, so that SQL gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as utterances: 40 ms a word, one turn after the other with gaps that may be negative."""
    rows = table(spark, sf_dir, "conversations").withColumn("w", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("dur", F.size("w").cast("bigint") * 40)
    start = F.greatest(F.lit(0), F.coalesce(F.sum("dur").over(before), F.lit(0)) + ((F.col("conv_id") * 31 + F.col("turn") * 17) % 50 - 10) * 20)
    rows = rows.withColumn("start_ms", start)
    corpus = F.concat(F.lit("corp"), F.col("conv_id") % 5)
    return rows.select(
        F.concat(corpus, F.lit("/conv_"), "conv_id").alias("file_id"), corpus.alias("corpus_id"), F.col("conv_id"), F.col("turn").cast("int").alias("line_idx"),
        (F.col("start_ms") / F.lit(1000.0)).alias("start_secs"), ((F.col("start_ms") + F.col("dur")) / F.lit(1000.0)).alias("end_secs"),
        F.upper(F.substring("role", 1, 1)).alias("speaker"), F.array_join("w", " ").alias("text"), "role", (F.col("start_ms") + F.col("dur")).alias("end_ms"),
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, channel, part_ts, codes): two channels of 50 codes a second, in two parts."""
    ends = utterances(spark, sf_dir).groupBy("file_id", "conv_id").agg(F.ceil(F.max("end_ms") / 20).cast("bigint").alias("n"))
    rows = ends.withColumn("channel", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.floor(F.col("n") / 2)
    lo, hi = F.when(F.col("part") == 0, F.lit(0)).otherwise(half), F.when(F.col("part") == 0, half).otherwise(F.col("n"))
    code = F.expr("transform(sequence(lo, greatest(hi - 1, lo)), p -> cast((conv_id * 7919 + p * 104729 + channel * 15485863) % 131072 as int))")
    rows = rows.withColumn("lo", lo.cast("bigint")).withColumn("hi", hi.cast("bigint"))
    return rows.select("file_id", "channel", F.concat(F.lit("p"), "part").alias("part_ts"), F.when(F.col("hi") > F.col("lo"), code).otherwise(F.array().cast("array<int>")).alias("codes"))


def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as chunks of sessions: value and ch1 are the event's value, ch2 its property k."""
    rows = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1
    k = F.get_json_object("props", "$.k").cast("double")
    return rows.select(F.col("user_id").alias("session_id"), place.alias("chunk_idx"), "event_id", "ts", "event_type", "value", F.col("value").alias("ch1"), k.alias("ch2"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, corpus_id, line_idx, line) of all lines of documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    return rows.select("doc_id", F.concat("source", F.lit("/doc_"), "doc_id").alias("file_id"), F.col("source").alias("corpus_id"), "line_idx", "line")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, n) of pages: the URL without scheme, query and fragment as a path."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.length("html").alias("n"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("code"), "embedding", "label")


# The same in DuckDB.
UTTERANCES_SQL = r"""
u0 as (select conv_id, turn, role, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from conversations),
u1 as (select *, len(w) * 40 as dur from u0),
u2 as (select *, greatest(0, coalesce(sum(dur) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) + ((conv_id * 31 + turn * 17) % 50 - 10) * 20)::bigint as start_ms from u1),
utt as (select 'corp' || (conv_id % 5) || '/conv_' || conv_id as file_id, 'corp' || (conv_id % 5) as corpus_id, conv_id, turn::int as line_idx,
  start_ms::double / 1000 as start_secs, (start_ms + dur)::double / 1000 as end_secs, upper(role[1:1]) as speaker, array_to_string(w, ' ') as text, role, start_ms + dur as end_ms from u2)"""
CODES_SQL = """
ends as (select file_id, conv_id, ceil(max(end_ms)::double / 20)::bigint as n from utt group by all),
codes as (select file_id, ch as channel, list_transform(range(0, n), lambda p: ((conv_id * 7919 + p * 104729 + ch * 15485863) % 131072)::int) as codes, n from ends, (select unnest([0, 1]) as ch))"""
CHUNKS_SQL = """
chunks as (select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) - 1 as chunk_idx, event_id, ts, event_type, value, value as ch1,
  json_extract_string(props, '$.k')::double as ch2 from events)"""
LINES_SQL = r"""
dl as (select doc_id, source || '/doc_' || doc_id as file_id, source as corpus_id, unnest(range(0, len(string_split(text, chr(10))))) as line_idx, unnest(string_split(text, chr(10))) as line from documents)"""
PATHS_SQL = r"""
paths as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path, length(html) as n from pages)"""
LOADED_SQL = """
dur as (select file_id, speaker, sum(end_secs - start_secs) as d from utt where length(text) > 0 group by all),
share as (select *, d / nullif(sum(d) over (partition by file_id), 0) as share from dur),
letters as (select file_id, speaker, chr((65 + dense_rank() over (partition by file_id order by speaker) - 1)::int) as letter from share where coalesce(share >= 0.1, true)),
loaded as (select utt.file_id, corpus_id, conv_id, line_idx, start_secs, end_secs, letter as speaker, text, row_number() over (partition by utt.file_id order by start_secs, end_secs, line_idx) - 1 as line_no
  from utt join letters l on utt.file_id = l.file_id and utt.speaker = l.speaker where length(text) > 0)"""
