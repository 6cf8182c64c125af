"""Queries of codes, interleaving, windows, voices and training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as K
from ..functions.text import shorten_codes, strip_non_audio
from ..operators import channels as C
from ..operators import interleave as I
from ..operators import stats as A
from ..operators import voice as V
from ..operators.transcripts import load_transcripts
from ..schemas import CodecParams, Tokens
from ..session import shared_folder
from ..sources.readers import code_files
from ..sources.writers import write_channel_map
from . import examples as E
from . import fixtures as D
from .registry import query

CODEC, TOKENS = CodecParams(), Tokens()
#: Windows of the queries, in seconds: short, so that a conversation has several.
CONTEXT, OVERLAP = 4.0, 1.0
THRESHOLD = 0.1

_FILES = """
bounds0 as (select file_id, trunc(min(start_secs) * 50 * 1)::bigint as ts, trunc(max(end_secs) * 50 * 1)::bigint as te, list_sort(list(distinct speaker)) as speakers from loaded group by 1),
nc as (select file_id, max(n) as n_codes, max(channel) + 1 as ch from codes group by 1),
files as (select nc.file_id, n_codes, ch, ts, te, coalesce(speakers, []) as speakers from nc left join bounds0 using (file_id)),
views as (select file_id, 'audio_only' as view, null::varchar as agent from files
  union all select file_id, v, null from files, (select unnest(['text_only', 'audio_first', 'text_first']) as v) where len(speakers) > 0
  union all select file_id, 'agent', unnest(speakers) from files where len(speakers) = 2)"""
_EVENTS = """
st0 as (select v.file_id, view, agent, line_no, start_secs, end_secs, case when agent is null then speaker when speaker = agent then 'A' when speaker = 'A' then agent else speaker end as speaker, text
  from views v join loaded l using (file_id) where view in ('audio_first', 'text_first', 'agent')),
st1 as (select *, case when view = 'agent' and speaker = 'A' then 1 else 0 end as stream from st0
  union all select file_id, view, agent, 2147483647, null, null, null, null, s from views, (select unnest([0, 1]) as s) where view <> 'text_only' and (s = 0 or view = 'agent')),
st2 as (select st1.*, n_codes, ch, case when view = 'audio_only' or ts is null then 0 else ts end as lo, case when view = 'audio_only' or te is null then n_codes else te end as hi,
  case when view = 'audio_first' or (view = 'agent' and stream = 0) then end_secs else start_secs end as secs from st1 join files using (file_id)),
st3 as (select *, case when speaker is null then hi else trunc(secs * 50 * 1)::bigint end as pt from st2),
st4 as (select *, greatest(lo, max(pt) over (partition by file_id, view, agent, stream order by line_no)) as pos from st3),
st5 as (select *, coalesce(lag(pos) over w, lo) as before, lag(speaker) over w as spoke from st4 window w as (partition by file_id, view, agent, stream order by line_no)),
ev as (select file_id, view, agent, (least(before, n_codes) - least(lo, n_codes)) * ch as q, stream, line_no::bigint * 4 as seq, '<|audio|>' as piece from st5 where pos > before
  union all select file_id, view, agent, (least(pos, n_codes) - least(lo, n_codes)) * ch, stream, line_no::bigint * 4 + 1, '<|end_audio|>' from st5 where pos > before
  union all select file_id, view, agent, (least(pos, n_codes) - least(lo, n_codes)) * ch, stream, line_no::bigint * 4 + 2, case when pos = before and spoke = speaker then ' ' || text else ' ' || speaker || ': ' || text end from st5 where speaker is not null)"""
_MERGED = """
mg0 as (select file_id, view, agent, q, string_agg(piece, '' order by stream, seq) as p from ev group by all),
mg1 as (select file_id, view, agent, q, case when view = 'agent' then replace(replace(replace(p, '<|audio|><|audio|>', '<|audio|>'), '<|end_audio|><|end_audio|>', '<|end_audio|>'), '<|audio|><|end_audio|>', '') else p end as p from mg0),
merged as (select file_id, view, agent, q, case when view = 'agent' and q = 0 and starts_with(p, '<|audio|>') and length(p) > 9 then p[10:] else p end as piece from mg1)"""
_WINDOWS = """
wn0 as (select v.file_id, view, agent, n_codes, ch, case when view = 'audio_only' or ts is null then 0 else least(ts, n_codes) end as lo, case when view = 'audio_only' or te is null then n_codes else least(te, n_codes) end as hi from views v join files using (file_id) where view <> 'text_only'),
wn1 as (select *, greatest(hi - lo, 0) * ch as length, (200 * ch)::bigint as c, (150 * ch)::bigint as d from wn0),
wn2 as (select *, case when length <= c then 1 else 1 + ceil((length - c)::double / d)::bigint end as n from wn1),
wn as (select *, k as example_index, k * d as s, least(k * d + c, length) as e from (select *, unnest(range(0, n)) as k from wn2))"""
_RENDER = """
chars0 as (select a.file_id, list_transform(range(0, a.n), lambda i: chr((a.codes[i + 1] + 57344)::int) || coalesce(chr((b.codes[i + 1] + 57344)::int), '')) as pairs, list_transform(range(0, a.n), lambda i: coalesce(chr((b.codes[i + 1] + 57344)::int), '') || chr((a.codes[i + 1] + 57344)::int)) as swapped
  from (select * from codes where channel = 0) a left join (select * from codes where channel = 1) b using (file_id)),
chars as (select v.file_id, v.view, v.agent, case when lead = 1 then swapped else pairs end as pairs from leads v join chars0 using (file_id)),
inw as (select w.file_id, w.view, w.agent, example_index, q, piece from wn w join merged m on w.file_id = m.file_id and w.view = m.view and w.agent is not distinct from m.agent and (s = 0 or q > s) and q <= e),
rn0 as (select inw.*, wn.s, wn.e, wn.lo, wn.ch, coalesce(lag(q) over (partition by inw.file_id, inw.view, inw.agent, inw.example_index order by q), wn.s) as prev from inw join wn on inw.file_id = wn.file_id and inw.view = wn.view and inw.agent is not distinct from wn.agent and inw.example_index = wn.example_index),
rn1 as (select rn0.file_id, rn0.view, rn0.agent, example_index, string_agg(array_to_string(pairs[lo + prev // ch + 1 : lo + q // ch], '') || piece, '' order by q) as body, max(q) as last from rn0 join chars on rn0.file_id = chars.file_id and rn0.view = chars.view and rn0.agent is not distinct from chars.agent group by all),
body as (select wn.file_id, wn.view, wn.agent, wn.example_index, coalesce(rn1.body, '') || array_to_string(pairs[lo + coalesce(last, s) // ch + 1 : lo + e // ch], '') as body
  from wn join chars on wn.file_id = chars.file_id and wn.view = chars.view and wn.agent is not distinct from chars.agent left join rn1 on rn1.file_id = wn.file_id and rn1.view = wn.view and rn1.agent is not distinct from wn.agent and rn1.example_index = wn.example_index),
ex as (select b.file_id, b.view, b.agent as agent_speaker, example_index::int as example_index, '<|' || b.view || '|>' || case when b.view = 'audio_only' then '' else array_to_string(list_transform(speakers, lambda x: '<|speaker|> ' || x), '') end || '<|end_header|>' || body as text from body b join files using (file_id))"""
_TEXT_ONLY = """tw0 as (select file_id, regexp_extract_all(string_agg(speaker || ': ' || text, ' ' order by line_no), '\\S+') as words, list_sort(list(distinct speaker)) as speakers from loaded group by 1),
tw as (select file_id, words, speakers, 0 as k, 0 as a, least(40, len(words)) as b from tw0
  union all select file_id, words, speakers, k + 1, coalesce(list_filter(range(b - 10, b), lambda i: list_contains(list_transform(speakers, lambda s: s || ':'), words[i + 1]))[1], b), least(coalesce(list_filter(range(b - 10, b), lambda i: list_contains(list_transform(speakers, lambda s: s || ':'), words[i + 1]))[1], b) + 40, len(words))
  from tw where a + 40 < len(words)),
texts as (select file_id, k::int as example_index, '<|text_only|>' || array_to_string(list_transform(speakers, lambda x: '<|speaker|> ' || x), '') || '<|end_header|> ' || array_to_string(words[a + 1 : b], ' ') as text from tw)"""
_EVERY = "every as (select * from ex union all select file_id, 'text_only', null, example_index, text from texts)"
_NO_MAP = "leads as (select file_id, view, agent, 0 as lead from views)"
_RECURSIVE = "recursive " + D.UTTERANCES_SQL.lstrip()
_BASE = (D.UTTERANCES_SQL, D.CODES_SQL, D.LOADED_SQL, _FILES)
_AUDIO = (_EVENTS, _MERGED, _WINDOWS, _RENDER)
_ALL = (*_BASE, _NO_MAP, *_AUDIO)
_ALL_VIEWS = (_RECURSIVE, *_ALL[1:], _TEXT_ONLY, _EVERY)


#: Every fourth file is mono, and every fifth has no codes at all.
_MIXED_CODES = D.CODES_SQL.replace("codes as (", "all_codes as (") + """,
codes as (select all_codes.* from all_codes join (select distinct file_id, conv_id from utt) using (file_id) where (channel = 0 or conv_id % 4 <> 1) and conv_id % 5 <> 2)"""


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """The codes of all files as mono and stereo: every fourth file is mono, every fifth has no codes at all."""
    number = F.regexp_extract("file_id", "[0-9]+$", 0).cast("bigint")
    return D.codes(spark, d).filter(((F.col("channel") == 0) | (number % 4 != 1)) & (number % 5 != 2))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load_transcripts(D.utterances(spark, d), THRESHOLD)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return I.attach_transcripts(I.code_lengths(D.codes(spark, d)), _lines(spark, d), CODEC)


def _examples(spark: SparkSession, d: str, view: str) -> DataFrame:
    return E.training_examples(D.utterances(spark, d), D.codes(spark, d), view, CODEC, TOKENS, CONTEXT, OVERLAP, THRESHOLD, text_context=40, text_overlap=10)


@query("select * from ex where view = 'audio_first'", *_ALL)
def x9_audio_first_examples(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d, "audio_first")


@query("select * from ex where view = 'text_first'", *_ALL)
def x9_text_first_examples(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d, "text_first")


@query("select * from ex where view = 'agent'", *_ALL)
def x9_agent_examples(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d, "agent")


@query("select * from every", *_ALL_VIEWS)
def x9_all_examples(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d, "all")


@query("select file_id, view, agent as agent_speaker from views", *_BASE)
def o3_build_views(spark: SparkSession, d: str) -> DataFrame:
    return I.build_views(_files(spark, d).select("file_id", "speakers"))


@query("select file_id, view, agent as agent_speaker, q, stream, seq, piece from ev", *_BASE, _EVENTS)
def o6_audio_stretch_events(spark: SparkSession, d: str) -> DataFrame:
    """Positions (w5), prefixes (w6) and the tokens of audio stretches of all views."""
    files = _files(spark, d)
    views = I.build_views(files.select("file_id", "speakers"))
    bounds = files.select("file_id", "trans_start", "trans_end", "n_codes", "num_channels")
    return I.events(I.streams(views, _lines(spark, d)), bounds, CODEC, TOKENS)


@query("select file_id, line_no::int as line_no, pos, case when pos = before and spoke = speaker then '' else speaker end as prefix from st5 where view = 'audio_first' and speaker is not null", *_BASE, _EVENTS)
def w5_insert_positions(spark: SparkSession, d: str) -> DataFrame:
    """Running maximum of positions (w5) and whether a line names its speaker (w6), read back from the events."""
    files = _files(spark, d)
    views = I.build_views(files.select("file_id", "speakers"), "audio_first")
    bounds = files.select("file_id", "trans_start", "trans_end", "n_codes", "num_channels")
    pieces = I.events(I.streams(views, _lines(spark, d)), bounds, CODEC, TOKENS).filter(F.col("seq") % 4 == 2)
    named = F.regexp_extract("piece", "^ ([A-Z]): ", 1)
    rows = pieces.join(bounds, "file_id").select("file_id", (F.col("seq") / 4).cast("int").alias("line_no"), "q", "trans_start", "n_codes", "num_channels", named.alias("prefix"))
    ends = _lines(spark, d).select("file_id", "line_no", (F.col("end_secs") * 50).cast("bigint").alias("own"))
    rows = rows.join(ends, ["file_id", "line_no"])
    at = F.least("trans_start", "n_codes") + (F.col("q") / F.col("num_channels")).cast("bigint")
    return rows.select("file_id", "line_no", at.alias("pos"), "prefix")


@query("select file_id, view, agent as agent_speaker, q, piece from merged where view = 'agent'", *_BASE, _EVENTS, _MERGED)
def o4_merge_event_streams(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    views = I.build_views(files.select("file_id", "speakers"), "agent")
    bounds = files.select("file_id", "trans_start", "trans_end", "n_codes", "num_channels")
    return I.merge_event_streams(I.events(I.streams(views, _lines(spark, d)), bounds, CODEC, TOKENS), TOKENS)


@query("select file_id, view, agent as agent_speaker, example_index::int as example_index, s, e, length from wn", *_BASE, _WINDOWS)
def x1_audio_windows(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    views = I.build_views(files.select("file_id", "speakers"))
    return I.windows(views, files.drop("speakers"), CODEC, CONTEXT, OVERLAP).select(*I.KEYS, "example_index", "s", "e", "length")


@query("""select w.file_id, w.view, w.agent as agent_speaker, example_index::int as example_index, q, piece from wn w join merged m on w.file_id = m.file_id and w.view = m.view and w.agent is not distinct from m.agent and (s = 0 or q > s) and q <= e""",
       *_BASE, _EVENTS, _MERGED, _WINDOWS)
def j10_events_in_windows(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    views = I.build_views(files.select("file_id", "speakers"))
    bounds = files.select("file_id", "trans_start", "trans_end", "n_codes", "num_channels")
    pieces = I.merge_event_streams(I.events(I.streams(views, _lines(spark, d)), bounds, CODEC, TOKENS), TOKENS)
    spans = I.windows(views, bounds, CODEC, CONTEXT, OVERLAP).filter("example_index = 0").select(*I.KEYS, "c", "d", "n")
    return I.events_in_windows(pieces, spans)


@query("select * from texts", _RECURSIVE, D.LOADED_SQL, _TEXT_ONLY)
def x2_text_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.text_only_examples(D.utterances(spark, d), TOKENS, 40, 10, THRESHOLD)


@query("select file_id, ts as trans_start, te as trans_end from bounds0", *_BASE)
def a5_transcript_bounds(spark: SparkSession, d: str) -> DataFrame:
    return I.transcript_bounds(_lines(spark, d), CODEC)


@query("select file_id, 2 as num_channels from files", *_BASE)
def a13_num_channels(spark: SparkSession, d: str) -> DataFrame:
    return I.num_channels(D.codes(spark, d))


@query("select file_id, n_codes::int as n_codes, ch::int as num_channels, ts as trans_start, te as trans_end, len(speakers)::int as speakers from files", *_BASE)
def j5_attach_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", "n_codes", "num_channels", "trans_start", "trans_end", F.size("speakers").alias("speakers"))


@query("select file_id, channel, 'p' || p as part_ts, list_sum(codes[case when p = 0 then 1 else n // 2 + 1 end : case when p = 0 then n // 2 else n end])::bigint as total from codes, (select unnest([0, 1]) as p)", D.UTTERANCES_SQL, D.CODES_SQL)
def s9_code_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts of channels as array files (a header of 128 bytes, then 32-bit numbers), decoded again."""
    low_first = lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    body = F.array_join(F.transform("codes", lambda x: low_first(F.lpad(F.hex(x.cast("bigint")), 8, "0"))), "")
    head = F.rpad(F.concat(F.lit("{'descr': '<i4', 'fortran_order': False, 'shape': ("), F.size("codes"), F.lit(",), }")), 117, " ")
    content = F.unhex(F.concat(F.lit("934E554D505901007600"), F.hex(F.encode(F.concat(head, F.lit("\n")), "UTF-8")), body))
    files = D.codes(spark, d).select(F.concat("file_id", F.lit("_c"), "channel", F.lit("_"), "part_ts").alias("name"), content.alias("content"))
    total = F.when(F.size("codes") > 0, F.aggregate("codes", F.lit(0).cast("bigint"), lambda a, v: a + v))
    return code_files(files).select("file_id", "channel", "part_ts", total.alias("total"))


@query("select file_id, channel, len(codes)::int as n, md5(array_to_string(codes, ',')) as digest from codes", D.UTTERANCES_SQL, D.CODES_SQL)
def o5_concat_code_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = I.concat_code_parts(D.codes(spark, d))
    return rows.select("file_id", "channel", F.size("codes").alias("n"), F.md5(F.array_join(F.transform("codes", lambda x: x.cast("string")), ",")).alias("digest"))


@query("select file_id, channel, array_to_string(list_transform(codes, lambda x: chr((x + 57344)::int)), '') as chars, true as same from codes", D.UTTERANCES_SQL, D.CODES_SQL)
def f5_codes_to_chars(spark: SparkSession, d: str) -> DataFrame:
    rows = I.concat_code_parts(D.codes(spark, d)).withColumn("chars", K.codes_to_chars(F.col("codes")))
    return rows.select("file_id", "channel", "chars", (K.chars_to_codes(F.col("chars")) == F.col("codes")).alias("same"))


@query("""select a.file_id, md5(array_to_string(list_transform(range(0, a.n), lambda i: a.codes[i + 1]::varchar || ',' || b.codes[i + 1]::varchar), ',')) as digest, true as same, a.codes[a.n] as hanging
 from codes a join codes b using (file_id) where a.channel = 0 and b.channel = 1""", D.UTTERANCES_SQL, D.CODES_SQL)
def f6_interleave_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = I.file_codes(I.concat_code_parts(D.codes(spark, d))).withColumn("x", K.interleave_channels(F.col("channels")))
    back = K.split_channel(F.col("x"), 1, 2) == F.get("channels", F.lit(1))
    hanging = K.hanging_codes(F.slice("x", 1, F.greatest(F.size("x") - 1, F.lit(0))), 2)
    return rows.select("file_id", F.md5(F.array_join(F.transform("x", lambda v: v.cast("string")), ",")).alias("digest"), back.alias("same"), F.get(hanging, F.lit(0)).alias("hanging"))


@query("select a.file_id, md5(array_to_string(b.codes, ',')) as first, md5(array_to_string(a.codes, ',')) as second from codes a join codes b using (file_id) where a.channel = 0 and b.channel = 1", D.UTTERANCES_SQL, D.CODES_SQL)
def f7_swap_agent_channel(spark: SparkSession, d: str) -> DataFrame:
    """All codes of both channels, by digest."""
    rows = I.file_codes(I.concat_code_parts(D.codes(spark, d))).withColumn("x", K.swap_agent_channel(F.col("channels"), F.lit(1)))
    digest = lambda i: F.md5(F.array_join(F.transform(F.get("x", F.lit(i)), lambda v: v.cast("string")), ","))
    return rows.select("file_id", digest(0).alias("first"), digest(1).alias("second"))


@query("select file_id, line_no::int as line_no, case speaker when 'B' then 'A' when 'A' then 'B' else speaker end as speaker from loaded", D.UTTERANCES_SQL, D.LOADED_SQL)
def f8_swap_agent_speaker(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("file_id", "line_no", I.swap_agent_speaker(F.col("speaker"), F.lit("B")).alias("speaker"))


@query("select file_id, line_idx, trunc(start_secs * 50 * 2)::bigint - trunc(start_secs * 50 * 2)::bigint % 2 as pos, round((trunc(start_secs * 50 * 2)::bigint - trunc(start_secs * 50 * 2)::bigint % 2)::double / 100, 6) as secs from utt", D.UTTERANCES_SQL)
def f9_secs_to_pos(spark: SparkSession, d: str) -> DataFrame:
    pos = K.secs_to_pos(F.col("start_secs"), 50.0, 2)
    return D.utterances(spark, d).select("file_id", "line_idx", pos.alias("pos"), F.round(K.pos_to_secs(pos, 50.0, 2), 6).alias("secs"))


@query("""select file_id, channel, list_sum(codes[trunc(0.5::double * 50)::int + 1 : trunc(1.3::double * 50)::int])::bigint as part, len(codes[trunc(0.5::double * 50)::int + 1:])::int as rest,
 list_sum(list_transform(range(0, n), lambda i: case when i >= 10 and i % 2 = 0 and (i - 10) // 2 < 3 then 7 else codes[i + 1] end))::bigint as written from codes""", D.UTTERANCES_SQL, D.CODES_SQL)  # fmt: skip
def f10_slice_by_time(spark: SparkSession, d: str) -> DataFrame:
    rows = I.concat_code_parts(D.codes(spark, d))
    none = F.lit(None).cast("double")
    total = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v))
    written = K.write_back(F.col("codes"), F.array(F.lit(7), F.lit(7), F.lit(7)), F.lit(10), 0)
    return rows.select("file_id", "channel", total(K.slice_by_time(F.col("codes"), F.lit(0.5), F.lit(1.3), 50.0, 1)).alias("part"), F.size(K.slice_by_time(F.col("codes"), F.lit(0.5), none, 50.0, 1)).alias("rest"), total(written).alias("written"))


@query("select file_id, view, '<|' || view || '|>' || case when view = 'audio_only' then '' else array_to_string(list_transform(speakers, lambda x: '<|speaker|> ' || x), '') end || '<|end_header|>' as header from views join files using (file_id)", *_BASE)
def f11_build_header(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).select("file_id", "speakers")
    rows = I.build_views(files).join(files, "file_id")
    return rows.select("file_id", "view", I.build_header(F.col("view"), F.col("speakers"), TOKENS).alias("header"))


@query("""select file_id, agent, '<|agent|><|speaker|> ' || agent || '<|speaker|> ' || other || coalesce('<|agent_voice|>' || array_to_string(list_transform(codes[1:25], lambda x: chr((x + 57344)::int)), ''), '') || '<|end_header|>' || case when text <> '' then ' ' || agent || ': ' || text else '' end || '<|audio|>' as prompt
 from (select v.file_id, agent, case when agent = speakers[1] then speakers[2] else speakers[1] end as other from views v join files using (file_id) where view = 'agent') p
 join (select file_id, speaker, coalesce(min_by(text, line_no), '') as text from loaded group by 1, 2) t on p.file_id = t.file_id and agent = t.speaker join (select file_id as f, codes from codes where channel = 0) k on p.file_id = f""".replace("select file_id, agent, '<", "select p.file_id, agent, '<"), *_BASE)  # fmt: skip
def f11_agent_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of a live agent: both speakers, a voice of half a second, and the agent's first line as opening text."""
    lines, files = _lines(spark, d), _files(spark, d).select("file_id", "speakers")
    first = lines.groupBy("file_id", F.col("speaker").alias("agent")).agg(F.min_by("text", "line_no").alias("text"))
    voice = I.concat_code_parts(D.codes(spark, d)).filter("channel = 0").select("file_id", K.codes_to_chars(F.slice("codes", 1, 25), CODEC.unicode_offset).alias("voice"))
    rows = I.build_views(files, "agent").select("file_id", F.col("agent_speaker").alias("agent")).join(files, "file_id").join(first, ["file_id", "agent"]).join(voice, "file_id")
    other = F.get(F.array_except("speakers", F.array("agent")), F.lit(0))
    return rows.select("file_id", "agent", I.agent_prompt(F.col("agent"), other, TOKENS, F.col("voice"), F.col("text")).alias("prompt"))


@query(f"select file_id, view, agent_speaker, example_index, regexp_replace(text, '[^{chr(0xE000)}-{chr(0x10FFFF)}]', '', 'g') as audio from every", *_ALL_VIEWS)
def f12_strip_non_audio(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d, "all").select(*I.KEYS, "example_index", strip_non_audio(F.col("text")).alias("audio"))


_C = f"[{chr(0xE000)}-{chr(0x10FFFF)}]"


@query(f"select file_id, view, agent_speaker, example_index, regexp_replace(text, '({_C}{{4}}){_C}+({_C}{{4}})', '\\1.........\\2', 'g') as shown from every", *_ALL_VIEWS)
def f13_shorten_codes(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d, "all").select(*I.KEYS, "example_index", shorten_codes(F.col("text")).alias("shown"))


@query("select file_id, channel, list_transform(codes, lambda x: x + 32000) as ids from codes", D.UTTERANCES_SQL, D.CODES_SQL)
def f21_token_ids(spark: SparkSession, d: str) -> DataFrame:
    return I.concat_code_parts(D.codes(spark, d)).select("file_id", "channel", K.token_ids(F.col("codes"), 32000).alias("ids"))


_SECONDS = f"""secs0 as (select *, array_to_string(list_transform(string_split(rtrim(text), '<|audio|>'), lambda p: string_split(p, '<|end_audio|>')[1]), '') as kept from every),
secs as (select file_id, view, agent_speaker, example_index, round(length(case when kept[1:1] = '<' then replace(replace(kept, '<', ''), '>', '') else kept end)::double / 2 / 50, 6) as reference, round(length(regexp_replace(text, '[^{chr(0xE000)}-{chr(0x10FFFF)}]', '', 'g'))::double / 2 / 50, 6) as audio_only from secs0)"""


@query("select * from secs", *_ALL_VIEWS, _SECONDS)
def f23_example_seconds(spark: SparkSession, d: str) -> DataFrame:
    both = [F.round(A.example_seconds(F.col("text"), CODEC, 2, TOKENS, m), 6).alias(m) for m in ("reference", "audio_only")]
    return _examples(spark, d, "all").select(*I.KEYS, "example_index", *both)


@query("""select view, count(*) as n, round(sum(reference), 3) as total_secs, round(sum(reference) / 3600, 6) as total_hours, max(reference) as max_secs, min(reference) as min_secs, round(quantile_cont(reference, 0.5), 4) as median_secs, round(avg(reference), 4) as mean_secs,
 round(stddev_pop(reference), 4) as std_secs from secs where view = 'audio_first' group by 1""", *_ALL_VIEWS, _SECONDS)  # fmt: skip
def a4_dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    lengths = _examples(spark, d, "audio_first").select(F.round(A.example_seconds(F.col("text"), CODEC, 2, TOKENS), 6).alias("seconds"))
    s = A.dataset_stats(lengths)
    r = lambda c, n: F.round(c, n).alias(c)
    return s.select(F.lit("audio_first").alias("view"), "n", r("total_secs", 3), r("total_hours", 6), "max_secs", "min_secs", r("median_secs", 4), r("mean_secs", 4), r("std_secs", 4))


# channels and voices

_MAP = """cm as (select file_id, speaker, case when conv_id % 3 = 0 then case when speaker = 'A' then 1 else 0 end when speaker = 'A' then 0 when conv_id % 2 = 0 then 1 else 0 end as channel, round(sum(end_secs - start_secs), 6) as duration_secs from loaded group by file_id, speaker, conv_id),
iso as (select *, count(*) over (partition by file_id, channel) = 1 as isolated from cm)"""


def _map(spark: SparkSession, d: str) -> DataFrame:
    """Speaker A on channel 1 and the others on 0 in every third file; else A on 0, the others on 1 in files of an even number and on 0 in the rest."""
    lines = _lines(spark, d)
    channel = F.when(F.col("conv_id") % 3 == 0, F.when(F.col("speaker") == "A", 1).otherwise(0)).when(F.col("speaker") == "A", 0).when(F.col("conv_id") % 2 == 0, 1).otherwise(0)
    return lines.groupBy("file_id", "speaker", channel.alias("channel")).agg(F.round(F.sum(F.col("end_secs") - F.col("start_secs")), 6).alias("duration_secs"))


@query("select file_id, speaker, channel, duration_secs, isolated from iso", D.UTTERANCES_SQL, D.LOADED_SQL, _MAP)
def a7_channel_isolated(spark: SparkSession, d: str) -> DataFrame:
    return C.channel_isolated(_map(spark, d))


@query("select file_id, speaker, channel, duration_secs from cm", D.UTTERANCES_SQL, D.LOADED_SQL, _MAP)
def s8_channel_map_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_channel_map(C.channel_map_json(_map(spark, d)))


@query("select cm.file_id, speaker, case when corpus_id in ('corp0', 'corp1') then channel else 1 - channel end as channel, duration_secs from cm join (select distinct file_id, corpus_id from utt) using (file_id)", D.UTTERANCES_SQL, D.LOADED_SQL, _MAP)
def s8_channel_map_kept(spark: SparkSession, d: str) -> DataFrame:
    """Maps of some corpora are written; then all with other channels, without overwriting: the first ones stay."""
    path, every = shared_folder(spark, "channel-map"), _map(spark, d)
    write_channel_map(every.filter(F.col("file_id").rlike("^corp[01]/")), path)
    write_channel_map(every.withColumn("channel", 1 - F.col("channel")), path)
    return C.parse_channel_map(spark.read.parquet(path))


_RANGES = """rg as (select l.*, trunc(start_secs * 50 * 1)::bigint as a, trunc(end_secs * 50 * 1)::bigint as b, end_secs - start_secs as secs, least(trunc(start_secs * 50 * 1)::bigint, n_codes) as ca, least(trunc(end_secs * 50 * 1)::bigint, n_codes) as cb, isolated and ch > 1 as isolated
  from loaded l join files using (file_id) left join iso using (file_id, speaker)),
alone as (select * from rg x where isolated or not exists (select 1 from rg y where x.file_id = y.file_id and x.speaker <> y.speaker and x.ca < y.cb and y.ca < x.cb and x.ca < x.cb and y.ca < y.cb))"""
_CANDIDATES = """cand as (select wn.file_id, agent as agent_speaker, example_index::int as example_index, line_no::int as line_no, secs from wn join files using (file_id) join alone on alone.file_id = wn.file_id and alone.speaker = wn.agent
  where wn.view = 'agent' and secs <= 6 and (b <= files.ts + s // files.ch or a >= files.ts + (s + c) // files.ch)),
ranked as (select *, row_number() over (partition by file_id, agent_speaker, example_index order by secs desc, line_no) - 1 as voice_rank from cand),
kept as (select * from ranked where voice_rank < 20 or secs >= 3),
chosen as (select * from (select *, count(*) over w as n, row_number() over (partition by file_id, agent_speaker, example_index order by voice_rank) - 1 as i from kept window w as (partition by file_id, agent_speaker, example_index))
  where i = ('0x' || substr(md5('42:' || file_id || ':' || agent_speaker || ':' || example_index), 1, 8))::bigint % n)"""


@query("select file_id, line_no::int as line_no, speaker from alone", *_BASE, _MAP, _RANGES)
def j7_non_overlapped_turns(spark: SparkSession, d: str) -> DataFrame:
    ranges = V.speech_ranges(_lines(spark, d), CODEC)
    return V.non_overlapped_turns(ranges, _files(spark, d), C.channel_isolated(_map(spark, d))).select("file_id", "line_no", "speaker")


def _voice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = _files(spark, d)
    alone = V.non_overlapped_turns(V.speech_ranges(_lines(spark, d), CODEC), files, C.channel_isolated(_map(spark, d)))
    spans = I.windows(I.build_views(files.select("file_id", "speakers"), "agent"), files.drop("speakers"), CODEC, CONTEXT, OVERLAP)
    return files, alone, spans


def _agent_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files, alone, spans = _voice(spark, d)
    rows = spans.join(files.select("file_id", "trans_start"), "file_id")
    per = lambda c: F.col("trans_start") + F.floor(c / F.col("num_channels"))
    wins = rows.select("file_id", "agent_speaker", "example_index", per(F.col("s")).alias("win_start"), per(F.col("s") + F.col("c")).alias("win_end"))
    return alone, wins


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return V.candidates_outside_window(*_agent_windows(spark, d))


@query("select file_id, agent_speaker, example_index, line_no from cand", *_BASE, _MAP, _RANGES, _WINDOWS, _CANDIDATES)
def j8_candidates_outside_window(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("file_id", "agent_speaker", "example_index", "line_no")


@query("select file_id, agent_speaker, example_index, line_no, voice_rank::int as voice_rank from kept", *_BASE, _MAP, _RANGES, _WINDOWS, _CANDIDATES)
def w7_rank_voice_candidates(spark: SparkSession, d: str) -> DataFrame:
    return V.rank_voice_candidates(_candidates(spark, d)).select("file_id", "agent_speaker", "example_index", "line_no", "voice_rank")


@query("select file_id, agent_speaker, example_index, line_no from chosen", *_BASE, _MAP, _RANGES, _WINDOWS, _CANDIDATES)
def x3_select_agent_voice(spark: SparkSession, d: str) -> DataFrame:
    return V.choose_agent_voice(*_agent_windows(spark, d)).select("file_id", "agent_speaker", "example_index", "line_no")


@query("""select file_id, n_codes::int as n_codes, ch::int as num_channels, ts as trans_start, te as trans_end, len(speakers)::int as speakers,
 case when ch = 1 then '' else coalesce(m, '') end as channels from files left join (select file_id, string_agg(speaker || '=' || channel, ',' order by speaker) as m from cm group by 1) using (file_id)""",
       D.UTTERANCES_SQL, _MIXED_CODES, D.LOADED_SQL, _FILES, _MAP)
def j5_attach_channel_map(spark: SparkSession, d: str) -> DataFrame:
    """Mono and stereo files with their channel map: a mono file has none."""
    files = I.attach_transcripts(I.code_lengths(_mixed(spark, d)), _lines(spark, d), CODEC, channel_map=_map(spark, d))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("channel_map")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return files.select("file_id", "n_codes", "num_channels", "trans_start", "trans_end", F.size("speakers").alias("speakers"), shown.alias("channels"))


_MAPPED = """leads as (select v.file_id, view, agent, case when ch = 1 then 0 else coalesce(channel, 0) end as lead from views v join files f on v.file_id = f.file_id left join cm on v.file_id = cm.file_id and cm.speaker = coalesce(agent, 'A'))"""
_VOICED = """voices as (select c.file_id, agent_speaker, example_index, array_to_string(list_transform(k.codes[a + 1 : b], lambda x: chr((x + 57344)::int)), '') as voice
  from chosen c join rg using (file_id, line_no) join cm on cm.file_id = c.file_id and cm.speaker = agent_speaker join files f on f.file_id = c.file_id join codes k on k.file_id = c.file_id and k.channel = case when f.ch = 1 then 0 else cm.channel end),
voiced as (select ex.file_id, view, ex.agent_speaker, ex.example_index, case when view = 'agent' and voice is not null then replace(text, '<|end_header|>', '<|agent_voice|>' || voice || '<|end_header|>') else text end as text
  from ex left join voices v on ex.file_id = v.file_id and ex.agent_speaker = v.agent_speaker and ex.example_index = v.example_index)"""
_WITH_MAP = (*_BASE, _MAP, _RANGES, _MAPPED, *_AUDIO, _CANDIDATES, _VOICED)


def _mapped_examples(spark: SparkSession, d: str, view: str) -> DataFrame:
    isolated = C.channel_isolated(_map(spark, d))
    return E.training_examples(D.utterances(spark, d), D.codes(spark, d), view, CODEC, TOKENS, CONTEXT, OVERLAP, THRESHOLD, isolated, text_context=40, text_overlap=10)


@query("select * from voiced where view = 'agent'", *_WITH_MAP)
def x3_agent_examples_with_voice(spark: SparkSession, d: str) -> DataFrame:
    """Agent examples with the agent's channel first and the voice sample of that channel in their headers."""
    return _mapped_examples(spark, d, "agent")


@query("select * from voiced union all select file_id, 'text_only', null, example_index, text from texts", _RECURSIVE, *_WITH_MAP[1:], _TEXT_ONLY)
def x9_all_examples_with_map(spark: SparkSession, d: str) -> DataFrame:
    """All views with a channel map: the first channel is that of speaker A, or of the agent."""
    return _mapped_examples(spark, d, "all")


@query("select * from voiced union all select file_id, 'text_only', null, example_index, text from texts join files using (file_id)", "recursive " + D.UTTERANCES_SQL.lstrip(), _MIXED_CODES, *_WITH_MAP[2:], _TEXT_ONLY)
def x9_mono_and_stereo_examples(spark: SparkSession, d: str) -> DataFrame:
    """All views of mono and stereo files with a channel map, which the mono ones ignore; files without codes have no examples."""
    isolated = C.channel_isolated(_map(spark, d))
    return E.training_examples(D.utterances(spark, d), _mixed(spark, d), "all", CODEC, TOKENS, CONTEXT, OVERLAP, THRESHOLD, isolated, text_context=40, text_overlap=10)


@query("select file_id, 'text_only' as view, null::varchar as agent_speaker, example_index, text from texts join files using (file_id)", "recursive " + D.UTTERANCES_SQL.lstrip(), _MIXED_CODES, D.LOADED_SQL, _FILES, _TEXT_ONLY)
def x9_text_only_examples(spark: SparkSession, d: str) -> DataFrame:
    """The text-only view alone: of files that have codes."""
    return E.training_examples(D.utterances(spark, d), _mixed(spark, d), "text_only", CODEC, TOKENS, CONTEXT, OVERLAP, THRESHOLD, text_context=40, text_overlap=10)
