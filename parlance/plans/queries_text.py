"""Queries of sources, text rules, transcripts, files and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import channels as C
from ..operators import splits as S
from ..operators import stats as A
from ..operators import transcripts as R
from ..session import shared_folder
from ..sources import readers, writers
from . import fixtures as D
from .registry import query



def _chain(col: str, rules: list[tuple[str, str]]) -> str:
    for pattern, into in rules:
        col = f"regexp_replace({col}, '{pattern}', '{into}', 'g')"
    return col


# The cleaning rules without look-around, for an engine that lacks it.
_SQL_RULES = [
    ("<comma>", ","), ("<period>", "."), ("<questionmark>", "?"), ("<exclamationpoint>", "!"), ("<sil>", "[sil]"), ("<music>", "[music]"), ("<noise>", "[noise]"), ("<other>", "[other]"),
    (r" \[!\]", "!"), (r"\x15[0-9]+?_[0-9]+?\x15", ""), (r'\+[",]', ""), (r"\+/\.", ""), ("&-", ""), ("[°☺⁎]", " "), (r'[^\pL\pN_ !?.,;"\x27`()&=%\-\[\]]', ""), ("ʔ", ""),
    (r"&[l,n]=.+?(\s|$)", r"\1"), (r"(?i)&=(?:lengthened|tsk|in|nonvocal|ex)(\s|$)", r"\1"), (r"\(\( *(.*?) *\)\)", r"\1"),
    (r"([ _][\pL\pN_])\.?_", r"\1."), (r"^([\pL\pN_])\.?_", r"\1."), ("_", " "), (" {2,}", " "), (r" ([!?.,;\x27])", r"\1"), (r" (n\x27)", r"\1"), (r"^\s+|\s+$", ""),
]
_CLEAN = _chain("line", _SQL_RULES)
_ASR = "lower(line)"
for _a, _b in X.ASR_LITERALS:
    _ASR = f"replace({_ASR}, '{_a}', '{_b}')"


@query(f"select doc_id, line_idx::int as line_idx, {_CLEAN} as clean from dl", D.LINES_SQL)
def f1_clean_line(spark: SparkSession, d: str) -> DataFrame:
    return D.document_lines(spark, d).select("doc_id", "line_idx", X.clean_line(F.col("line")).alias("clean"))


@query(rf"select doc_id, line_idx::int as line_idx, regexp_replace({_ASR}, '^\s+|\s+$', '', 'g') as asr from dl", D.LINES_SQL)
def f2_clean_asr_text(spark: SparkSession, d: str) -> DataFrame:
    return D.document_lines(spark, d).select("doc_id", "line_idx", X.clean_asr_text(F.col("line")).alias("asr"))


_TTS = _chain("line", [(r"\([0-9]*?\.[0-9]*?\)", "..."), (r"(?i)(?:\s|^)i?[hx]+[.,?!]*(\s|$)", r"\1"), (r"0 ?\[", "["), ("0[.]", ""), (r"\[.*?\]", ""), (r"&=.*?(\s|$)", r"\1"), (r"\s+", " "), (r"^\s+|\s+$", "")])


@query(rf"select doc_id, line_idx::int as line_idx, {_TTS} as tts from dl", D.LINES_SQL)
def f3_sanitize_for_tts(spark: SparkSession, d: str) -> DataFrame:
    return D.document_lines(spark, d).select("doc_id", "line_idx", X.sanitize_for_tts(F.col("line")).alias("tts"))


@query(r"""select doc_id, line_idx::int as line_idx, not (contains(lower(line),'noise') or contains(lower(line),'wind') or contains(lower(line),'blow') or contains(lower(line),'mn') or contains(lower(line),'breath')
 or contains(lower(line),'hh') or contains(lower(line),'cough') or contains(lower(line),'laugh')) as allowed, coalesce(list_last(regexp_extract_all(line, '\S+')) in ('the', 'and', 'of', 'la'), false) as backchannel from dl""", D.LINES_SQL)  # fmt: skip
def f4_allowed_text_flag(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("line")
    return D.document_lines(spark, d).select("doc_id", "line_idx", X.allowed_text_flag(c).alias("allowed"), X.last_token_in(c, ["the", "and", "of", "la"]).alias("backchannel"))


@query("""select file_id, len(list_distinct(regexp_extract_all(s, '([A-Z]): ', 1)))::int as speakers from (select file_id, string_agg(speaker || ': ' || text, ' ' order by line_idx) as s from utt group by 1)""", D.UTTERANCES_SQL)
def a9_count_speakers(spark: SparkSession, d: str) -> DataFrame:
    said = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "speaker", "text"))), lambda x: F.concat(x["speaker"], F.lit(": "), x["text"]))
    seq = D.utterances(spark, d).groupBy("file_id").agg(F.array_join(said, " ").alias("s"))
    return seq.select("file_id", X.count_speakers_in_text(F.col("s")).alias("speakers"))


@query("""select file_id, (i - 1)::int as turn, parts[i][1:1] as speaker, ltrim(replace(ltrim(parts[i][3:]), '%s', '')) as text from (select file_id, parts, unnest(range(1, len(parts) + 1)) as i
 from (select file_id, string_split(regexp_replace(string_agg(speaker || ': ' || text, ' ' order by line_idx), ' ([A-Z]):', chr(30) || '\\1:', 'g'), chr(30)) as parts from utt group by 1))""" % X.EXTERNAL_MARKER, D.UTTERANCES_SQL)  # fmt: skip
def f14_parse_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the sequences that all lines of a file are joined to; a tag inside of a line begins a turn too."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "speaker", "text"))), lambda x: F.concat(x["speaker"], F.lit(": "), x["text"]))
    seq = D.utterances(spark, d).groupBy("file_id").agg(F.array_join(said, " ").alias("s"))
    return seq.select("file_id", F.posexplode(X.turns_of_sequence(F.col("s"))).alias("turn", "t")).select("file_id", "turn", "t.speaker", "t.text")


@query(r"""select event_id, (ms // 3600000)::varchar || ':' || lpad((ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || '.' || lpad((ms % 1000)::varchar, 3, '0') as stamp
 from (select event_id, round(value * 137 * 1000)::bigint as ms from events)""")
def f15_format_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "events").select("event_id", X.format_timestamp(F.col("value") * 137).alias("stamp"))


@query("""select file_id, line_idx, printf('%d.%02d', s // 100, s % 100) || ' ' || printf('%d.%02d', e // 100, e % 100) || ' ' || speaker || ': ' || text as line
 from (select *, round(start_secs * 100)::bigint as s, round(end_secs * 100)::bigint as e from utt)""", D.UTTERANCES_SQL)
def s7_transcript_text(spark: SparkSession, d: str) -> DataFrame:
    return writers.transcript_text(D.utterances(spark, d)).select("file_id", "line_idx", "line")


@query("""select file_id, line_idx, round(start_secs * 100)::bigint as start_cs, round(end_secs * 100)::bigint as end_cs, speaker, text from utt where length(text) > 0""", D.UTTERANCES_SQL)
def s6_transcript_round_trip(spark: SparkSession, d: str) -> DataFrame:
    lines = writers.transcript_text(D.utterances(spark, d)).select("file_id", "line_idx", "line")
    rows = readers.transcript_lines(lines)
    cs = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return rows.select("file_id", "line_idx", cs("start_secs").alias("start_cs"), cs("end_secs").alias("end_cs"), "speaker", "text")


_FISHER = r"""select doc_id, line_idx::int as line_idx, array_to_string(p[1:3], ' ') as prefix, text from (select doc_id, line_idx, p, """ + _chain("line", _SQL_RULES) + r""" as text
 from (select doc_id, line_idx, array_to_string(p[4:], ' ') as line, p from (select doc_id, line_idx, regexp_extract_all(line, '\S+') as p from dl) where len(p) > 0 and p[1][1:1] <> '#')) where length(text) > 0"""


@query(_FISHER, D.LINES_SQL)
def s3_fisher_lines(spark: SparkSession, d: str) -> DataFrame:
    return readers.fisher_lines(D.document_lines(spark, d)).select("doc_id", "line_idx", "prefix", "text")


_FIRST_SEEN = """first as (select file_id, speaker, min(line_idx) as f from utt group by all),
seen as (select file_id, speaker, chr((65 + (dense_rank() over (partition by file_id order by f) - 1) % 26)::int) as letter from first)"""


@query("""select '/podcast/P0000/' || utt.file_id as file_id, line_idx, start_secs, end_secs, letter as speaker, lower(text) as text from utt join seen using (file_id, speaker) where length(text) > 0""",
       D.UTTERANCES_SQL.replace("array_to_string(w, ' ') as text", _chain("lower(array_to_string(w, ' '))", _SQL_RULES) + " as text"), _FIRST_SEEN)
def s4_gigaspeech(spark: SparkSession, d: str) -> DataFrame:
    """Utterances as one nested document for each file, read back."""
    segment = F.struct(F.col("speaker"), F.col("text").alias("text_tn"), F.col("start_secs").alias("begin_time"), F.col("end_secs").alias("end_time"))
    nested = D.utterances(spark, d).groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", segment.alias("s")))), lambda x: x["s"]).alias("segments"))
    docs = nested.select(F.array(F.struct(F.concat(F.lit("/podcast/P0000/"), "file_id").alias("path"), "segments")).alias("audios"))
    return readers.gigaspeech_utterances(docs)


@query("""select conv_id::varchar as recording, line_idx, round(10 + start_secs, 6) as start_secs, round(10 + start_secs + (end_secs - start_secs), 6) as end_secs, letter as speaker, text from utt join seen using (file_id, speaker) where length(text) > 0""",
       D.UTTERANCES_SQL.replace("array_to_string(w, ' ') as text", _chain("array_to_string(w, ' ')", _SQL_RULES) + " as text"), _FIRST_SEEN)
def s5_libriheavy(spark: SparkSession, d: str) -> DataFrame:
    sup = F.struct(F.col("speaker"), F.col("start_secs").alias("start"), (F.col("end_secs") - F.col("start_secs")).alias("duration"), F.struct(F.array("text").alias("texts")).alias("custom"))
    rows = D.utterances(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", sup.alias("s")))), lambda x: x["s"]).alias("supervisions"))
    cuts = rows.select(F.lit(10.0).alias("start"), F.struct(F.col("conv_id").cast("string").alias("id")).alias("recording"), "supervisions")
    return readers.libriheavy_utterances(cuts).select("recording", "line_idx", F.round("start_secs", 6).alias("start_secs"), F.round("end_secs", 6).alias("end_secs"), "speaker", "text")


@query("""select page_id, path from paths where (contains(path, '/en/') or contains(path, '/de/')) and not contains(path, '.org')""", D.PATHS_SQL)
def p1_filter_paths(spark: SparkSession, d: str) -> DataFrame:
    return R.filter_paths(D.page_paths(spark, d), ["/en/", "/de/"], [".org"]).select("page_id", "path")


@query(r"""select page_id, regexp_replace(path, '\.[^./]*$', '') as file_id, string_split(regexp_replace(path, '\.[^./]*$', ''), '/')[1] as corpus_id, regexp_extract(regexp_replace(path, '\.[^./]*$', ''), '^(.*)/[^/]*$', 1) as folder from paths""", D.PATHS_SQL)
def p2_derive_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.derive_ids(D.page_paths(spark, d)).select("page_id", "file_id", "corpus_id", "folder")


@query("""select doc_id, line_idx::int as line_idx, line from dl where length(line) > 0""", D.LINES_SQL)
def p3_drop_blank(spark: SparkSession, d: str) -> DataFrame:
    return R.drop_blank(D.document_lines(spark, d), "line").select("doc_id", "line_idx", "line")


@query("""select file_id, line_idx, round(start_secs * 1000 / 1000 + conv_id, 6) as start_secs, round(end_secs * 1000 / 1000 + conv_id, 6) as end_secs from utt""", D.UTTERANCES_SQL)
def p4_shift_times(spark: SparkSession, d: str) -> DataFrame:
    ms = D.utterances(spark, d).withColumn("start_secs", F.col("start_secs") * 1000).withColumn("end_secs", F.col("end_secs") * 1000)
    rows = R.shift_times(ms, F.col("conv_id").cast("double"), milliseconds=True)
    return rows.select("file_id", "line_idx", F.round("start_secs", 6).alias("start_secs"), F.round("end_secs", 6).alias("end_secs"))


@query("""select l_orderkey, l_linenumber, l_quantity from lineitem order by l_orderkey, l_linenumber limit 1000""")
def p5_limit_examples(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: the first examples in a stable order."""
    return R.limit_examples(D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 1000, "l_orderkey", "l_linenumber")


@query("""select file_id, line_idx, sub_idx, m0 + sub_idx * 10 as mark_start_ms, m0 + sub_idx * 10 + 5 as mark_end_ms from (select file_id, line_idx, (start_secs * 1000)::bigint as m0,
 unnest(case when conv_id % 3 = 0 then [0] else range(0, conv_id % 3 + 1) end)::int as sub_idx from utt)""", D.UTTERANCES_SQL)
def p7_expand_time_marks(spark: SparkSession, d: str) -> DataFrame:
    """Tiers with one to three inline marks."""
    rows = D.utterances(spark, d).withColumn("m0", F.round(F.col("start_secs") * 1000).cast("bigint"))
    mark = lambda i: F.concat(F.lit("\x15"), F.col("m0") + i * 10, F.lit("_"), F.col("m0") + i * 10 + 5, F.lit("\x15"))
    n = F.col("conv_id") % 3 + 1
    text = F.concat("text", mark(0), F.when(n > 1, F.concat(F.lit(" b "), mark(1))).otherwise(""), F.when(n > 2, F.concat(F.lit(" c "), mark(2), F.lit(" lost"))).otherwise(""))
    marked = rows.select("file_id", "line_idx", text.alias("text"), F.col("m0").alias("mark_start_ms"), (F.col("m0") + 5).alias("mark_end_ms"))
    return R.expand_time_marks(marked).select("file_id", "line_idx", "sub_idx", "mark_start_ms", "mark_end_ms")


@query("""select * from (select file_id, line_idx, first_value(case when line_idx % 3 <> 0 then start_secs end ignore nulls) over w as start_secs, first_value(case when line_idx % 3 <> 0 then end_secs end ignore nulls) over w as end_secs from utt
 window w as (partition by file_id order by line_idx rows between current row and unbounded following)) where start_secs is not null""", D.UTTERANCES_SQL)
def w1_backfill_time_marks(spark: SparkSession, d: str) -> DataFrame:
    """A third of the lines has no time marks."""
    timed = F.col("line_idx") % 3 != 0
    rows = D.utterances(spark, d).withColumn("start_secs", F.when(timed, F.col("start_secs"))).withColumn("end_secs", F.when(timed, F.col("end_secs")))
    return R.backfill_time_marks(rows).select("file_id", "line_idx", "start_secs", "end_secs")


@query("""select file_id, line_idx, start_secs, end_secs, case speaker when 'S' then 'A' when 'U' then 'B' else 'C' end as speaker, text from
 (select file_id, line_idx, speaker, text, first_value(case when line_idx % 3 <> 0 then start_secs end ignore nulls) over w as start_secs, first_value(case when line_idx % 3 <> 0 then end_secs end ignore nulls) over w as end_secs
 from utt where text not in ('.', '0.') window w as (partition by file_id order by line_idx rows between current row and unbounded following)) where start_secs is not null""",
       D.UTTERANCES_SQL.replace("array_to_string(w, ' ') as text", _chain("array_to_string(w, ' ')", [*_SQL_RULES[:9], (r"\[[^%\]].*?\]", ""), *_SQL_RULES[9:]]) + " as text"))
def s2_chat_lines(spark: SparkSession, d: str) -> DataFrame:
    """Main-tier lines with participants, a third of them untimed: lettered, cleaned, blank ones dropped, times filled back."""
    ms = lambda c: F.when(F.col("line_idx") % 3 != 0, F.round(F.col(c) * 1000).cast("bigint"))
    rows = D.utterances(spark, d).select("file_id", "line_idx", "speaker", "text", ms("start_secs").alias("mark_start_ms"), ms("end_secs").alias("mark_end_ms"))
    return R.clean_chat(rows.withColumn("participants", F.array(F.lit("S"), F.lit("U"), F.lit("A")))).select("file_id", "line_idx", "start_secs", "end_secs", "speaker", "text")


@query("select file_id, line_idx, letter as speaker from utt join seen using (file_id, speaker)", D.UTTERANCES_SQL, _FIRST_SEEN)
def w2_letters_by_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return R.letters_by_first_seen(D.utterances(spark, d)).select("file_id", "line_idx", "speaker")


@query("select file_id, line_idx, case speaker when 'S' then 'A' when 'U' then 'B' else 'C' end as speaker from utt", D.UTTERANCES_SQL)
def w2_letters_by_header(spark: SparkSession, d: str) -> DataFrame:
    rows = D.utterances(spark, d).withColumn("participants", F.array(F.lit("S"), F.lit("U"), F.lit("A")))
    return R.letters_by_header(rows).select("file_id", "line_idx", "speaker")


_DEDUPE = """select file_id, line_idx from kept"""
_DEDUPE_CTE = """ordered as (select *, row_number() over (partition by file_id order by start_secs, line_idx) as i from utt),
scan as (select file_id, i, [{'l': line_idx, 's': start_secs, 'e': end_secs, 'w': speaker}] as k from ordered where i = 1
  union all select o.file_id, o.i, case
    when scan.k[-1].s = o.start_secs and scan.k[-1].w = o.speaker and o.end_secs > scan.k[-1].e then list_append(scan.k[:-2], {'l': o.line_idx, 's': o.start_secs, 'e': o.end_secs, 'w': o.speaker})
    when scan.k[-1].e = o.end_secs and scan.k[-1].w = o.speaker and o.start_secs > scan.k[-1].s then scan.k
    when o.start_secs < scan.k[-1].e then scan.k
    else list_append(scan.k, {'l': o.line_idx, 's': o.start_secs, 'e': o.end_secs, 'w': o.speaker}) end
  from scan join ordered o on o.file_id = scan.file_id and o.i = scan.i + 1),
kept as (select file_id, unnest(k).l as line_idx from scan qualify i = max(i) over (partition by file_id))"""


@query(_DEDUPE, "recursive " + D.UTTERANCES_SQL.lstrip(), _DEDUPE_CTE)
def w3_dedupe_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = D.utterances(spark, d).select("file_id", "line_idx", "start_secs", "end_secs", "speaker")
    return R.dedupe_overlaps(rows).select("file_id", "line_idx")


@query("select file_id, line_idx, (row_number() over (partition by file_id order by start_secs, end_secs, line_idx) - 1)::int as line_no from utt", D.UTTERANCES_SQL)
def o1_sort_lines(spark: SparkSession, d: str) -> DataFrame:
    return R.sort_lines(D.utterances(spark, d)).select("file_id", "line_idx", "line_no")


@query("select file_id, speaker, round(d, 6) as duration_secs, round(share, 6) as share from share where coalesce(share >= 0.1, true)", D.UTTERANCES_SQL, D.LOADED_SQL)
def a1_speaker_proportions(spark: SparkSession, d: str) -> DataFrame:
    rows = R.speaker_proportions(D.utterances(spark, d).filter(F.length("text") > 0), 0.1)
    return rows.select("file_id", "speaker", F.round("duration_secs", 6).alias("duration_secs"), F.round("share", 6).alias("share"))


@query("select file_id, line_idx, speaker, line_no::int as line_no from loaded", D.UTTERANCES_SQL, D.LOADED_SQL)
def a2_remap_speakers(spark: SparkSession, d: str) -> DataFrame:
    return R.load_transcripts(D.utterances(spark, d), 0.1).select("file_id", "line_idx", "speaker", "line_no")


@query("""select page_id, part, num, case when part = 'fe_03_p1_tran' then 'fisher_eng_tr_sp_d' || case when num <= 7 then 1 when num <= 16 then 2 when num <= 25 then 3 when num <= 34 then 4 when num <= 43 then 5 when num <= 52 then 6 else 7 end
 else 'fe_03_p2_sph' || case when num <= 66 then 1 when num <= 75 then 2 when num <= 83 then 3 when num <= 91 then 4 when num <= 99 then 5 when num <= 108 then 6 else 7 end end as partition
 from (select page_id, case when page_id % 2 = 0 then 'fe_03_p1_tran' else 'fe_03_p2_tran' end as part, (case when page_id % 2 = 0 then page_id % 59 else 58 + page_id % 59 end)::int as num from pages)""")  # fmt: skip
def j4_fisher_partition(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("page_id") % 2 == 0
    rows = D.table(spark, d, "pages").select("page_id", F.when(even, "fe_03_p1_tran").otherwise("fe_03_p2_tran").alias("part"), (F.col("page_id") % 59 + F.when(even, 0).otherwise(58)).cast("int").alias("num"))
    return R.fisher_partition(rows)


@query("select file_id, line_idx, text from utt where length(text) > 0 union all select file_id, line_idx::int, line from dl where length(line) > 0", D.UTTERANCES_SQL, D.LINES_SQL)
def o2_union_sources(spark: SparkSession, d: str) -> DataFrame:
    talk = D.utterances(spark, d).select("file_id", "line_idx", "text")
    lines = D.document_lines(spark, d).select("file_id", "line_idx", F.col("line").alias("text"))
    return R.drop_blank(R.union_sources(talk, lines))


# files and pairs


_AUDIO = r"""stems as (select page_id, regexp_replace(path, '\.[^./]*$', '') as stem from paths), audio as (select stem || x.e as path, stem, x.r, page_id % 2 + 1 as num_channels from stems, (select unnest([{'e': '.flac', 'r': 2}, {'e': '.wav', 'r': 0}]) as x) where (page_id % 3 = 0 and x.r = 0) or (page_id % 4 = 1 and x.r = 2)),
best as (select stem, min_by(path, r) as path, min_by(num_channels, r) as num_channels from audio group by 1)"""


def _stems(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stems = D.page_paths(spark, d).select("page_id", F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"))
    make = lambda ext, when: stems.filter(when).select("stem", F.concat("stem", F.lit(ext)).alias("path"), (F.col("page_id") % 2 + 1).alias("num_channels"))
    return stems, make(".wav", F.col("page_id") % 3 == 0).unionByName(make(".flac", F.col("page_id") % 4 == 1))


@query("select page_id, stems.stem, path from stems join best using (stem) where num_channels > 1", D.PATHS_SQL, _AUDIO)
def j1_match_audio(spark: SparkSession, d: str) -> DataFrame:
    stems, audio = _stems(spark, d)
    return C.match_audio_to_transcripts(stems, audio, num_channels="num_channels")[0].select("page_id", "stem", "path")


@query("select page_id, stem from stems anti join best using (stem)", D.PATHS_SQL, _AUDIO)
def j1_missing_audio(spark: SparkSession, d: str) -> DataFrame:
    stems, audio = _stems(spark, d)
    return C.match_audio_to_transcripts(stems, audio)[1]


@query("select doc_id from documents anti join labels using (doc_id)")
def j2_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    return C.skip_existing(D.table(spark, d, "documents").select("doc_id"), D.table(spark, d, "labels"), "doc_id")


@query("select count(*) as sources, count(b.stem) as paired, count(*) - count(b.stem) as unpaired from stems left join (select distinct stem from audio) b using (stem) where not ends_with(stem, '-raw')", D.PATHS_SQL, _AUDIO)
def j3_verify_pairs(spark: SparkSession, d: str) -> DataFrame:
    stems, audio = _stems(spark, d)
    return C.verify_pairs(stems, audio)


@query(r"""select folder, round(sum(n / 50.0::double) / 3600, 6) as hours, count(*) as files from (select regexp_extract(regexp_replace(path, '\.[^./]*$', ''), '^(.*)/[^/]*$', 1) as folder, n from paths) group by rollup (folder)""", D.PATHS_SQL)
def a3_duration_by_folder(spark: SparkSession, d: str) -> DataFrame:
    rows = A.duration_by_folder(R.derive_ids(D.page_paths(spark, d)), F.col("n") / F.lit(50.0))
    return rows.select("folder", F.round("hours", 6).alias("hours"), "files")


@query("select source as corpus_id, count(*) as files from documents group by 1")
def a8_corpus_file_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus_file_counts(D.document_lines(spark, d))


_SPLIT = """files as (select distinct source || '/doc_' || doc_id as file_id, source as corpus_id from documents),
placed as (select *, row_number() over (partition by corpus_id order by md5('42:' || file_id), file_id) - 1 as i, count(*) over (partition by corpus_id) as n from files),
splits as (select file_id, corpus_id, case when i < greatest(1, trunc(n * 0.94::double)) then 'train' when i < greatest(1, trunc(n * 0.94::double)) + greatest(1, trunc(n * 0.02::double)) then 'dev' else 'test' end as split from placed)"""


@query("select * from splits", _SPLIT)
def w4_file_split(spark: SparkSession, d: str) -> DataFrame:
    files = D.table(spark, d, "documents").select(F.concat("source", F.lit("/doc_"), "doc_id").alias("file_id"))
    return S.file_split(S.corpus_files(files))


@query("select doc_id, line_idx::int as line_idx, split from dl join splits using (file_id)", D.LINES_SQL, _SPLIT)
def j9_assign_split(spark: SparkSession, d: str) -> DataFrame:
    lines = D.document_lines(spark, d)
    return S.assign_split(lines, S.file_split(S.corpus_files(lines))).select("doc_id", "line_idx", "split")


@query("select file_id, corpus_id, split, count(*) as lines from dl join splits using (file_id, corpus_id) group by all", D.LINES_SQL, _SPLIT)
def s11_write_splits(spark: SparkSession, d: str) -> DataFrame:
    """The list of files and the lines by split, written and read back."""
    lines, path = D.document_lines(spark, d), shared_folder(spark, "splits")
    writers.write_splits(lines, S.file_split(S.corpus_files(lines)), path)
    examples = spark.read.parquet(f"{path}/examples").groupBy("file_id", "split").agg(F.count("*").alias("lines"))
    return readers.read_file_splits(spark, f"{path}/file_splits").join(examples, ["file_id", "split"])


@query("select corpus_id, split, count(*) as files from splits group by all", _SPLIT)
def s11_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    files = D.table(spark, d, "documents").select(F.concat("source", F.lit("/doc_"), "doc_id").alias("file_id"))
    return S.file_split(S.corpus_files(files)).groupBy("corpus_id", "split").agg(F.count("*").alias("files"))


def _one_file_each(rows: DataFrame, root: str) -> None:
    """(corpus, conv, value): a text file for each conversation in a folder of its own, below one for its corpus."""
    rows.repartition("corpus", "conv").write.partitionBy("corpus", "conv").text(root)


@query("""select 'corpus=' || corpus_id || '/conv=' || conv_id as folder, 'corpus=' || corpus_id as corpus_id, 1::bigint as files, sum(strlen(coalesce(text, '')) + 1)::bigint as bytes from utt where conv_id % 5 <> 3 group by corpus_id, conv_id""", D.UTTERANCES_SQL)
def s1_list_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of transcripts, one a conversation, but those of an excluded corpus; names that Spark gives are left out."""
    root = shared_folder(spark, "listed")
    _one_file_each(D.utterances(spark, d).select(F.col("corpus_id").alias("corpus"), F.col("conv_id").alias("conv"), F.coalesce("text", F.lit("")).alias("value")), root)
    files = readers.list_files(spark, root, ".txt", ("conv=",), ("corpus=corp3/",))
    return files.groupBy("folder", "corpus_id").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("""select conv_id, 3 + row_number() over (partition by conv_id order by line_idx)::int as line_idx, speaker, text || ' ' || chr(21) || (start_secs * 1000)::bigint || '_' || end_ms || chr(21) as text, round(start_secs * 1000)::bigint as mark_start_ms, end_ms as mark_end_ms, 'U,A,S' as participants from utt""", D.UTTERANCES_SQL)
def s2_chat_files(spark: SparkSession, d: str) -> DataFrame:
    """CHAT files, one a conversation, written and read: a header, and main tiers whose second word is on a line of its own."""
    root = shared_folder(spark, "chat")
    mark = F.concat(F.lit(" \x15"), F.round(F.col("start_secs") * 1000).cast("bigint"), F.lit("_"), "end_ms", F.lit("\x15"))
    tier = F.concat(F.lit("*"), "speaker", F.lit(":\t"), F.regexp_replace("text", "^([^ ]+) ", "$1\n\t"), mark, F.lit("\n%com:\ta note"))
    lines = D.utterances(spark, d).groupBy("corpus_id", "conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", tier.alias("t")))), lambda x: x["t"]).alias("t"))
    head = F.lit("@UTF8\n@Begin\n@Participants:\tU User, A Agent, S System\n@Comment:\tnone\n")
    _one_file_each(lines.select(F.col("corpus_id").alias("corpus"), F.col("conv_id").alias("conv"), F.concat(head, F.array_join("t", "\n")).alias("value")), root)
    rows = readers.read_chat_utterances(spark, root)
    conv = F.regexp_extract("file_id", "conv=([0-9]+)/", 1).cast("bigint")
    place = 2 + F.ceil(F.col("line_idx") / 2).cast("int")  # each main tier is followed by a dependent one
    return rows.select(conv.alias("conv_id"), place.alias("line_idx"), "speaker", "text", "mark_start_ms", "mark_end_ms", F.array_join("participants", ",").alias("participants"))


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 < floor(count(*) over () * 5 / 100) as is_validation from orders")
def x8_head_validation(spark: SparkSession, d: str) -> DataFrame:
    return S.head_validation(D.table(spark, d, "orders").select("o_orderkey"), 5, "o_orderkey")


@query("select l_orderkey, l_linenumber, case when l_orderkey % 100 < 5 then 'validation' when l_orderkey % 100 > 5 then 'train' end as split from lineitem")
def x8_modulo_split(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.modulo_split(F.col("l_orderkey"), 5).alias("split"))


@query("select file_id, line_idx, text from utt", D.UTTERANCES_SQL)
def s10_write_examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples written with their metadata, and read back."""
    path = shared_folder(spark, "examples")
    rows = D.utterances(spark, d).select("file_id", "line_idx", "text")
    writers.write_examples(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query("select text from conversations")
def s12_training_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as JSON lines, and read back as training text."""
    path = f"{shared_folder(spark, 'text')}.json"
    writers.write_examples(D.table(spark, d, "conversations").select("conv_id", "text"), path, "json")
    return readers.read_training_text(spark, path)
