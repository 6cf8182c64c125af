"""Queries of session windows, turns and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions as N
from ..operators import stats as A
from . import fixtures as D
from .registry import query

#: Windows of the queries in chunks: small, so that sessions reach every regime.
WINDOW, UPDATE = 20, 5

_Z = f"""z0 as (select *, least(row_number() over (partition by session_id order by chunk_idx), {WINDOW}) as n from chunks),
z1 as (select *, n < {UPDATE} or n % {UPDATE} = 0 as upd, avg(value) over f as m, case when n > 1 then stddev_pop(value) over f else 1 end as s from z0 window f as (partition by session_id order by chunk_idx rows between {WINDOW - 1} preceding and current row)),
z2 as (select *, coalesce(last_value(case when upd then m end ignore nulls) over w, 0) as fm, coalesce(last_value(case when upd then s end ignore nulls) over w, 1) as fs from z1 window w as (partition by session_id order by chunk_idx rows between unbounded preceding and 1 preceding)),
z as (select *, round((value - fm) / nullif(fs, 0), 6) as z from z2)"""
_TIMERS = """t0 as (select *, row_number() over w as i, coalesce(z >= 0, false) as a, coalesce(lag(z) over w, 0) < 0 as below from z window w as (partition by session_id order by chunk_idx)),
t1 as (select *, i - coalesce(max(case when a then i end) over u, 0) as inactive_chunks, max(case when a and below then (i - 1)::double * 0.1::double end) over u as activity from t0 window u as (partition by session_id order by chunk_idx rows between unbounded preceding and current row)),
timers as (select *, inactive_chunks::double * 0.1::double as inactive_secs, inactive_chunks::double * 0.1::double >= 0.3::double and (inactive_chunks - 1)::double * 0.1::double < 0.3::double as finalize from t1)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows = N.rolling_zscore(D.chunk_metrics(spark, d), WINDOW, UPDATE)
    return rows.withColumn("z", F.round("z", 6))


def _timers(spark: SparkSession, d: str) -> DataFrame:
    return N.inactivity_timers(_scores(spark, d), finalize=0.3)


@query("select session_id, chunk_idx, z from z", D.CHUNKS_SQL, _Z)
def w8_rolling_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("session_id", "chunk_idx", "z")


_POOLED = f"""p0 as (select *, least(row_number() over (partition by session_id order by chunk_idx), {WINDOW}) as n from chunks),
p1 as (select *, n < {UPDATE} or n % {UPDATE} = 0 as upd, avg((ch1 + ch2) / 2) over f as m, case when n > 1 then sqrt(var_pop((ch1 + ch2) / 2) over f + avg(((ch1 - ch2) / 2) * ((ch1 - ch2) / 2)) over f) else 1 end as s from p0 window f as (partition by session_id order by chunk_idx rows between {WINDOW - 1} preceding and current row)),
p3 as (select *, coalesce(last_value(case when upd then m end ignore nulls) over w, 0) as fm, coalesce(last_value(case when upd then s end ignore nulls) over w, 1) as fs from p1 window w as (partition by session_id order by chunk_idx rows between unbounded preceding and 1 preceding))"""


@query("select session_id, chunk_idx, round((ch1 - fm) / nullif(fs, 0), 5) as z1, round((ch2 - fm) / nullif(fs, 0), 5) as z2 from p3", D.CHUNKS_SQL, _POOLED)
def w8_rolling_zscore_pooled(spark: SparkSession, d: str) -> DataFrame:
    rows = N.rolling_zscore_pooled(D.chunk_metrics(spark, d), WINDOW, UPDATE)
    return rows.select("session_id", "chunk_idx", F.round("z1", 5).alias("z1"), F.round("z2", 5).alias("z2"))


_FAR = "far as (select * replace (1000000 + ch1 as ch1, 1000000 + ch2 as ch2) from chunks)"


@query("select session_id, chunk_idx, round((ch1 - fm) / nullif(fs, 0), 3) as z1, round((ch2 - fm) / nullif(fs, 0), 3) as z2 from p3", D.CHUNKS_SQL, _FAR, _POOLED.replace("from chunks", "from far"))
def w8_rolling_zscore_pooled_far(spark: SparkSession, d: str) -> DataFrame:
    """Values far from zero, whose squares would cancel."""
    far = D.chunk_metrics(spark, d).withColumn("ch1", F.col("ch1") + 1000000).withColumn("ch2", F.col("ch2") + 1000000)
    rows = N.rolling_zscore_pooled(far, WINDOW, UPDATE)
    return rows.select("session_id", "chunk_idx", F.round("z1", 3).alias("z1"), F.round("z2", 3).alias("z2"))


_BLOCKS = """rf0 as (select session_id, event_type as stage, chunk_idx, (row_number() over (partition by session_id, event_type order by chunk_idx) - 1) // 5 as block, 0.1::double / (value / 100 + 1e-8::double) as f from chunks),
rf as (select session_id, stage, block, avg(f) as factor from rf0 group by all having count(*) = 5)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = D.chunk_metrics(spark, d).select("session_id", F.col("event_type").alias("stage"), "chunk_idx", (F.col("value") / 100).alias("elapsed_secs"))
    return N.realtime_factor_blocks(rows, 0.1, 5)


@query("select session_id, stage, block, round(factor, 4) as factor from rf", D.CHUNKS_SQL, _BLOCKS)
def w9_realtime_factor_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).withColumn("factor", F.round("factor", 4))


@query("select stage, round(quantile_cont(factor, 0.5), 4) as median_factor, count(*) as blocks from rf group by 1", D.CHUNKS_SQL, _BLOCKS)
def a12_realtime_factor_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.realtime_factor_summary(_blocks(spark, d)).withColumn("median_factor", F.round("median_factor", 4))


@query("select session_id, chunk_idx, inactive_chunks, round(inactive_secs, 6) as inactive_secs, round(activity, 6) as activity_start_secs, finalize from timers", D.CHUNKS_SQL, _Z, _TIMERS)
def w10_inactivity_timers(spark: SparkSession, d: str) -> DataFrame:
    rows = _timers(spark, d)
    return rows.select("session_id", "chunk_idx", F.col("inactive_chunks").cast("bigint").alias("inactive_chunks"), F.round("inactive_secs", 6).alias("inactive_secs"), F.round("activity_start_secs", 6).alias("activity_start_secs"), "finalize")


_TWO = """c0 as (select session_id, chunk_idx, ch1, ch2, row_number() over (partition by session_id order by chunk_idx) as i, round((ch1 - fm) / nullif(fs, 0), 5) as z1, round((ch2 - fm) / nullif(fs, 0), 5) as z2 from p3),
c1 as (select *, coalesce(z2 >= 0, false) as on2, coalesce(lag(z2) over (partition by session_id order by chunk_idx), 0) < 0 as below from c0),
two as (select *, (i - coalesce(max(case when z1 >= 0 then i end) over u, 0)) * 0.1::double as s1, (i - coalesce(max(case when z2 >= 0 then i end) over u, 0)) * 0.1::double as s2, max(case when on2 and below then (i - 1) * 0.1::double end) over u as start
  from c1 window u as (partition by session_id order by chunk_idx))"""


def _channels(spark: SparkSession, d: str) -> DataFrame:
    rows = N.rolling_zscore_pooled(D.chunk_metrics(spark, d), WINDOW, UPDATE)
    return N.channel_timers(rows.withColumn("z1", F.round("z1", 5)).withColumn("z2", F.round("z2", 5)), finalize=0.3)


@query("select session_id, chunk_idx, round(s1, 6) as ch1_inactive_secs, round(s2, 6) as ch2_inactive_secs, round(start, 6) as activity_start_secs, s1 >= 0.3::double and round(s1 / 0.1::double) = 3 as finalize from two", D.CHUNKS_SQL, _POOLED, _TWO)
def w10_channel_timers(spark: SparkSession, d: str) -> DataFrame:
    """A timer for each channel, by the pooled z."""
    secs = [F.round(c, 6).alias(c) for c in ("ch1_inactive_secs", "ch2_inactive_secs", "activity_start_secs")]
    return _channels(spark, d).select("session_id", "chunk_idx", *secs, "finalize")


@query("""select session_id, chunk_idx, coalesce(s2 >= 0.2::double and z1 + 2 >= 1 and speaker = 'user', false) as force_transcription, least(s1, s2) >= 0.3::double as force_response
 from (select *, case when z1 + 4 >= 0 then case when ch1 > ch2 then 'agent' else 'user' end end as speaker from two)""", D.CHUNKS_SQL, _POOLED, _TWO)  # fmt: skip
def w11_force_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each channel has its own timer; the event's z is the first channel's, raised so that the flags occur."""
    rows = _channels(spark, d).withColumn("event_z", F.col("z1") + 2)
    rows = rows.withColumn("probable_speaker", N.probable_event_speaker(F.col("z1") + 4, F.col("ch1"), F.col("ch2")))
    return N.force_flags(rows, 0.2, 0.3).select("session_id", "chunk_idx", "force_transcription", "force_response")


@query("select session_id, chunk_idx, case when z >= 0 then case when ch1 > ch2 then 'agent' else 'user' end end as speaker from z", D.CHUNKS_SQL, _Z)
def w18_probable_event_speaker(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d)
    return rows.select("session_id", "chunk_idx", N.probable_event_speaker(F.col("z"), F.col("ch1"), F.col("ch2")).alias("speaker"))


@query("select session_id, chunk_idx, case when event_type = 'error' then 'own' when z >= 1 then 'interrupted' else 'external' end as codes from z", D.CHUNKS_SQL, _Z)
def w19_interrupt_or_substitute(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d)
    return rows.select("session_id", "chunk_idx", N.interrupt_or_substitute(F.col("z"), F.col("event_type") != "error").alias("codes"))


_TURNS = "turns as (select conv_id as session_id, turn as turn_idx, case when turn % 3 = 1 then 'user' else role end as role, text from conversations)"
_MESSAGES = """talk as (select * from turns where role <> 'system'),
m0 as (select *, case when lag(role) over (partition by session_id order by turn_idx) is distinct from role then 1 else 0 end as new from talk),
m1 as (select *, sum(new) over (partition by session_id order by turn_idx) as run from m0),
m2 as (select session_id, run, role, string_agg(text, ' ' order by turn_idx) as content from m1 group by all),
ends as (select t.session_id, min_by(k.role, k.turn_idx) as f, max_by(k.role, k.turn_idx) as l from (select distinct session_id from turns) t left join talk k using (session_id) group by 1),
m3 as (select * from m2 union all select session_id, 0, 'user', '[silence]' from ends where f = 'assistant' union all select session_id, 2147483647, 'user', '[silence]' from ends where l is null or l = 'assistant'),
messages as (select session_id, row_number() over (partition by session_id order by run)::int as msg_idx, role, content from m3)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """All turns; every third one is the user's, so that equal roles meet."""
    role = F.when(F.col("turn") % 3 == 1, F.lit("user")).otherwise(F.col("role"))
    return D.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_idx"), role.alias("role"), "text")


@query("select * from messages", _TURNS, _MESSAGES)
def w12_merge_same_role_turns(spark: SparkSession, d: str) -> DataFrame:
    return N.merge_same_role_turns(_turns(spark, d))


@query("select session_id, md5('system' || chr(31) || 'You are a friendly assistant.' || string_agg(chr(30) || role || chr(31) || content, '' order by msg_idx)) as digest, count(*) + 1 as n_messages from messages group by 1", _TURNS, _MESSAGES)
def f16_chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """The JSON is read back: roles and contents in order, by digest."""
    rows = N.chat_messages_json(N.merge_same_role_turns(_turns(spark, d)), "You are a friendly assistant.")
    parsed = F.from_json("messages", "array<struct<role:string,content:string>>")
    body = F.array_join(F.transform(parsed, lambda m: F.concat(m["role"], F.lit("\x1f"), m["content"])), "\x1e")
    return rows.select("session_id", F.md5(body).alias("digest"), F.size(parsed).cast("bigint").alias("n_messages"))


@query("select session_id, role = 'assistant' as is_agent, max(turn_idx) as turn_idx, max_by(text, turn_idx) as text from turns group by all", _TURNS)
def w13_last_turn_by_role(spark: SparkSession, d: str) -> DataFrame:
    return N.last_turn_by_role(_turns(spark, d), F.col("role") == "assistant")


_SENTENCES = r"""sc0 as (select doc_id as session_id, line_idx as chunk_idx, line as text from dl),
sc1 as (select *, coalesce(sum(regexp_matches(text, '[.!?:;]$')::int) over (partition by session_id order by chunk_idx rows between unbounded preceding and 1 preceding), 0)::bigint as sentence_idx from sc0)"""


@query(r"""select * from (select session_id, sentence_idx, regexp_replace(replace(replace(string_agg(text, '' order by chunk_idx), '[ ', '['), ' ]', ']'), '^\s+|\s+$', '', 'g') as sentence from sc1 group by all) where length(sentence) > 0""", D.LINES_SQL, _SENTENCES)
def w14_assemble_sentences(spark: SparkSession, d: str) -> DataFrame:
    chunks = D.document_lines(spark, d).select(F.col("doc_id").alias("session_id"), F.col("line_idx").alias("chunk_idx"), F.col("line").alias("text"))
    return N.assemble_sentences(chunks)


@query("""select file_id as session_id, turn_idx, round(case when is_agent then end_secs else greatest(coalesce(start_secs, b), b) end, 6) as start_secs, case when not is_agent then round(end_secs, 6) end as end_secs
 from (select *, coalesce(lag(end_secs) over (partition by file_id, is_agent order by turn_idx), 0) as b from (select *, line_idx as turn_idx, role = 'assistant' as is_agent from utt))""", D.UTTERANCES_SQL)  # fmt: skip
def w15_turn_times(spark: SparkSession, d: str) -> DataFrame:
    rows = D.utterances(spark, d).select(F.col("file_id").alias("session_id"), F.col("line_idx").alias("turn_idx"), (F.col("role") == "assistant").alias("is_agent"), F.col("end_secs").alias("now_secs"), F.col("start_secs").alias("activity_start_secs"))
    return N.turn_times(rows).select("session_id", "turn_idx", F.round("start_secs", 6).alias("start_secs"), F.round("end_secs", 6).alias("end_secs"))


_TOKENS = """tk0 as (select session_id as turn_id, chunk_idx as token_idx, ' ' || event_type as token, value / 40 as ratio from chunks),
tk1 as (select *, sum((ratio >= 1)::int) over (partition by turn_id order by token_idx) as run from tk0),
tk2 as (select *, sum((ratio < 1)::int) over (partition by turn_id, run order by token_idx) as k, min(case when ratio < 1 then token_idx end) over (partition by turn_id, run) as st from tk1),
tk3 as (select *, min(case when k > 3 then st end) over (partition by turn_id) as cut from tk2)"""


@query("""select turn_id, count(*) filter (cut is null or token_idx < cut)::int as kept, coalesce(ltrim(string_agg(token, '' order by token_idx) filter (cut is null or token_idx < cut)), '[silence]') as text from tk3 group by 1""", D.CHUNKS_SQL, _TOKENS)
def w16_truncate_improbable_run(spark: SparkSession, d: str) -> DataFrame:
    rows = D.chunk_metrics(spark, d).select(F.col("session_id").alias("turn_id"), F.col("chunk_idx").alias("token_idx"), F.concat(F.lit(" "), "event_type").alias("token"), (F.col("value") / 40).alias("ratio"))
    return N.truncate_improbable_run(rows)


@query("select event_id, 20 * greatest(0, floor((value * 7 - 80) / 20) + 1)::bigint as trim_secs from events")
def x7_trim_context(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "events").select("event_id", N.trim_context(F.col("value") * 7).alias("trim_secs"))


_STAMP = "(ms{0} // 3600000)::varchar || ':' || lpad((ms{0} // 60000 % 60)::varchar, 2, '0') || ':' || lpad((ms{0} // 1000 % 60)::varchar, 2, '0') || '.' || lpad((ms{0} % 1000)::varchar, 3, '0')"


@query(f"""select file_id as session_id, string_agg('[' || {_STAMP.format(1)} || ' - ' || {_STAMP.format(2)} || '] ' || speaker || ': ' || case when planned is not null and planned <> said then said || '  ⟶  {{' || ltrim(planned[length(said) + 1 :]) || '}}' else text end, chr(10) order by start_secs, line_idx) as transcript
 from (select *, round(start_secs * 1000)::bigint as ms1, round(coalesce(case when line_idx % 2 = 0 then end_secs end, 99) * 1000)::bigint as ms2, case when line_idx % 3 = 1 then text end as planned, case when line_idx % 3 = 1 then text[1:10] else text end as said from utt) group by 1""", D.UTTERANCES_SQL)  # fmt: skip
def f15_format_transcript(spark: SparkSession, d: str) -> DataFrame:
    """A third of the turns was cut after ten characters; every second is open."""
    cut = F.col("line_idx") % 3 == 1
    rows = D.utterances(spark, d).select(
        F.col("file_id").alias("session_id"), F.col("line_idx").alias("turn_idx"), "speaker", "start_secs", F.when(F.col("line_idx") % 2 == 0, F.col("end_secs")).alias("end_secs"), F.lit(99.0).alias("total_secs"),
        F.when(cut, F.col("text")).alias("planned_text"), F.when(cut, F.substring("text", 1, 10)).otherwise(F.col("text")).alias("text"), F.col("text").alias("text_with_external_markers"),
    )
    return N.format_transcript(rows)


@query("""select round(avg((l = p)::int), 6) as accuracy, count(*) as n from (select value_l as l, value_p as p from (select session_id, chunk_idx, lead(case when chunk_idx % 7 = 3 then -100 else ch2::int % 5 end) over (partition by session_id order by chunk_idx) as value_l, value::int % 5 as value_p from (select * replace (trunc(value) as value) from chunks))) where l is not null and l <> -100""", D.CHUNKS_SQL)
def a10_token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("chunk_idx") % 7 == 3, F.lit(-100)).otherwise(F.col("ch2").cast("int") % 5)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", label.alias("l"), (F.col("value").cast("int") % 5).alias("p"))))
    rows = D.chunk_metrics(spark, d).groupBy("session_id").agg(ordered.alias("x"))
    rows = rows.select(F.transform("x", lambda v: v["l"]).alias("labels"), F.transform("x", lambda v: v["p"]).alias("preds"))
    return A.token_accuracy(rows).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query("select event_type, round(exp(avg(value / 100)), 6) as perplexity, isinf(case when avg(value) * 100 > 709 then 'inf'::double else exp(avg(value) * 100) end) as over from events group by 1")
def a11_perplexity(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "events").groupBy("event_type")
    return rows.agg(F.round(A.perplexity(F.col("value") / 100), 6).alias("perplexity"), (A.perplexity(F.col("value") * 100) == F.lit(float("inf"))).alias("over"))


_SILENCE = """ce as (select i, avg(x) as v from (select unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as x from embeddings where label = 0) group by 1),
cv as (select list(v order by i) as c from ce),
ds as (select vec_id as code, sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::double - c[i]) * (embedding[i]::double - c[i])))) as distance from embeddings, cv),
cs as (select session_id as chunk_id, chunk_idx % 2 = 0 as own, event_id % (select count(*) from embeddings) as code from chunks)"""


@query("""select chunk_id, round(avg(case when own then distance end) / (avg(case when not own then distance end) + 1e-5::double), 5) as score from cs join ds using (code) group by 1""", D.CHUNKS_SQL, _SILENCE)
def f20_silence_distance_ratio(spark: SparkSession, d: str) -> DataFrame:
    table = D.embeddings(spark, d)
    every = table.count()  # all codes of the table are met
    distances = A.silence_distances(table, A.silence_centroid(table, F.col("label") == 0))
    codes = D.chunk_metrics(spark, d).select(F.col("session_id").alias("chunk_id"), (F.col("chunk_idx") % 2 == 0).alias("own"), (F.col("event_id") % every).alias("code"))
    return A.silence_distance_ratio(codes, distances, "chunk_id").withColumn("score", F.round("score", 5))


_PAD = """pd0 as (select conv_id, turn, conv_id % 10 as batch, list_transform(range(0, len(regexp_extract_all(text, '\\S+'))), lambda i: (i % 50 + 1)::int) as ids from conversations),
pd as (select *, (ceil(max(len(ids)) over (partition by batch)::double / 8) * 8)::int as m from pd0)"""


@query("select conv_id, turn, m::int as length, list_sum(ids)::bigint as total, (m - len(ids))::int as padded from pd where len(ids) > 0", _PAD)
def f22_pad_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    rows = D.table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 10).alias("batch"), n.alias("n")).filter("n > 0")
    rows = rows.withColumn("input_ids", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i % 50 + 1))
    out = A.pad_labels(rows, "batch")
    total = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return out.select("conv_id", "turn", F.size("labels").alias("length"), total.alias("total"), F.size(F.filter("labels", lambda x: x == -100)).alias("padded"))
