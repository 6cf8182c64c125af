"""Codes and transcripts interleaved into training examples.

Codes stay one array a file; text and tokens are events at positions, which windows take by arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import codes_to_chars, interleave_channels, swap_agent_channel
from ..functions.text import words
from ..schemas import VIEWS, CodecParams, Tokens

KEYS = ["file_id", "view", "agent_speaker"]
#: A block of codes has so many strides of windows.
BLOCK_STRIDES = 16


def concat_code_parts(parts: DataFrame) -> DataFrame:
    """(file_id, channel, codes): the parts of a channel in the order of their names."""
    ordered = F.array_sort(F.collect_list(F.struct("part_ts", "codes")))
    return parts.groupBy("file_id", "channel").agg(F.flatten(F.transform(ordered, lambda p: p["codes"])).alias("codes"))


def file_codes(channels: DataFrame) -> DataFrame:
    """(file_id, channels, num_channels, n_codes): one array of channel arrays a file. Channels of unequal length are an error."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("channel", "codes"))), lambda c: c["codes"])
    out = channels.groupBy("file_id").agg(ordered.alias("channels"), (F.max("channel") + 1).alias("num_channels"), F.min(F.size("codes")).alias("n_codes"), F.max(F.size("codes")).alias("_most"))
    same = F.when(F.col("n_codes") == F.col("_most"), F.col("n_codes")).otherwise(F.raise_error(F.lit("channels differ in length")))
    return out.withColumn("n_codes", same).drop("_most")


def code_lengths(parts: DataFrame) -> DataFrame:
    """(file_id, num_channels, n_codes) from the sizes of the parts: no code is shuffled. Channels of unequal length are an error."""
    each = parts.select("file_id", "channel", F.size("codes").alias("n")).groupBy("file_id", "channel").agg(F.sum("n").cast("int").alias("n"))
    out = each.groupBy("file_id").agg((F.max("channel") + 1).alias("num_channels"), F.min("n").alias("n_codes"), F.max("n").alias("_most"))
    same = F.when(F.col("n_codes") == F.col("_most"), F.col("n_codes")).otherwise(F.raise_error(F.lit("channels differ in length")))
    return out.withColumn("n_codes", same).drop("_most")


def block_sizes(codec: CodecParams, context_secs: float, overlap_secs: float, longest_secs: float = 0.0, strides: int = BLOCK_STRIDES) -> tuple[int, int]:
    """Codes of a channel in a block, and behind it: whatever begins in a block and lasts no longer than a window, or longest_secs, is in its row."""
    codes = lambda secs: math.ceil(secs * codec.framerate * codec.num_codebooks)
    return max(1, strides * codes(context_secs - overlap_secs)), codes(max(context_secs, longest_secs))


def part_offsets(parts: DataFrame) -> DataFrame:
    """(file_id, channel, part_ts, at): the codes of a channel before each of its parts. It reads sizes alone. A part that is there twice is an error."""
    same = ["file_id", "channel", "part_ts"]
    sizes = parts.groupBy(*same).agg(F.sum(F.size("codes")).alias("n"), F.count("*").alias("_k"))
    once = F.when(F.col("_k") == 1, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("a part is there twice: "), "file_id", F.lit(" "), "part_ts")))
    order = Window.partitionBy("file_id", "channel").orderBy("part_ts")
    return sizes.withColumn("n", once).select(*same, (F.sum("n").over(order) - F.col("n")).cast("int").alias("at"))


def code_blocks(parts: DataFrame, offsets: DataFrame, block: int, halo: int) -> DataFrame:
    """(file_id, block, channels): the codes from block * number on, `block` of them and `halo` more, an array a channel.

    A part is cut where it lies, so that a recording of any length is dealt over blocks by one shuffle of its codes. `offsets` are those of
    part_offsets, a row a part; Spark joins them by a broadcast as long as they are small.
    """
    rows = parts.join(offsets, ["file_id", "channel", "part_ts"]).withColumn("_n", F.size("codes"))
    first = F.greatest(F.lit(0), F.floor((F.col("at") - block - halo) / block) + 1)
    last = F.greatest(F.floor((F.col("at") + F.col("_n") - 1) / block), F.floor(F.col("at") / block))

    def cut(b: Column) -> Column:
        lo, hi = F.greatest(b * block, F.col("at")), F.least((b + 1) * block + halo, F.col("at") + F.col("_n"))
        return F.struct(b.alias("block"), lo.alias("lo"), F.slice("codes", (lo - F.col("at") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("codes"))

    cuts = rows.select("file_id", "channel", F.explode(F.transform(F.sequence(first, last), cut)).alias("c"))
    own = cuts.groupBy("file_id", F.col("c.block").cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("channel", "c.lo", "c.codes"))).alias("_p"), F.max("channel").alias("_last"))
    channel = lambda c: F.flatten(F.transform(F.filter("_p", lambda p: p["channel"] == c), lambda p: p["codes"]))
    return own.select("file_id", "block", F.transform(F.sequence(F.lit(0), F.col("_last")), channel).alias("channels"))


def own_channel_map(channel_map: DataFrame, files: DataFrame) -> DataFrame:
    """The channel map (file_id, speaker letter, channel and more) of files (file_id, num_channels) that have channels to tell apart: a mono file
    ignores its map. A channel that a file lacks is an error; a null one stays null."""
    rows = channel_map.join(files.filter("num_channels > 1").select("file_id", "num_channels"), "file_id")
    lacks = (F.col("channel") >= F.col("num_channels")) | (F.col("channel") < 0)
    known = F.when(lacks, F.raise_error(F.concat(F.lit("no channel "), "channel", F.lit(" in "), "file_id"))).otherwise(F.col("channel"))
    return rows.withColumn("channel", known.cast("int")).drop("num_channels")


def num_channels(channels: DataFrame) -> DataFrame:
    return channels.groupBy("file_id").agg((F.max("channel") + 1).alias("num_channels"))


def transcript_bounds(lines: DataFrame, codec: CodecParams) -> DataFrame:
    """(file_id, trans_start, trans_end) in codes of a channel."""
    at = lambda c: (c * F.lit(codec.framerate) * F.lit(codec.num_codebooks)).cast("bigint")
    return lines.groupBy("file_id").agg(at(F.min("start_secs")).alias("trans_start"), at(F.max("end_secs")).alias("trans_end"))


def build_views(files: DataFrame, wanted: str = "all") -> DataFrame:
    """(file_id, view, agent_speaker) of files with their array of speakers: all views that a file can have, or one."""
    none = F.lit(None).cast("string")
    row = lambda view, agent=none: F.struct(F.lit(view).alias("view"), agent.alias("agent_speaker"))
    text = F.when(F.size("speakers") > 0, F.array(*[row(v) for v in ("text_only", "audio_first", "text_first")]))
    agents = F.when(F.size("speakers") == 2, F.transform("speakers", lambda s: row("agent", s)))
    empty = F.array().cast("array<struct<view:string,agent_speaker:string>>")
    every = F.concat(F.array(row("audio_only")), F.coalesce(text, empty), F.coalesce(agents, empty))
    out = files.select("file_id", F.explode(every).alias("v")).select("file_id", "v.view", "v.agent_speaker")
    return out if wanted == "all" else out.filter(F.col("view") == wanted)


def swap_agent_speaker(speaker: Column, agent: Column) -> Column:
    """The agent's letter and A exchanged."""
    return F.when(agent.isNull(), speaker).when(speaker == agent, F.lit("A")).when(speaker == "A", agent).otherwise(speaker)


def streams(views: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of each view but the text-only one. In the agent view the agent's stream (1) has its text first, that of the others (0) its audio first.

    Each stream of a view has a closing line without a speaker; the audio-only view has that alone.
    """
    spoken = views.filter(F.col("view").isin("audio_first", "text_first", "agent")).join(lines.select("file_id", "line_no", "start_secs", "end_secs", "speaker", "text"), "file_id")
    spoken = spoken.withColumn("speaker", swap_agent_speaker(F.col("speaker"), F.col("agent_speaker")))
    spoken = spoken.withColumn("stream", F.when((F.col("view") == "agent") & (F.col("speaker") == "A"), 1).otherwise(0))
    closing = views.filter(F.col("view") != "text_only").withColumn("stream", F.explode(F.when(F.col("view") == "agent", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    nothing = {"line_no": F.lit(2147483647), "start_secs": F.lit(None).cast("double"), "end_secs": F.lit(None).cast("double"), "speaker": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
    return spoken.unionByName(closing.withColumns(nothing))


def events(lines: DataFrame, bounds: DataFrame, codec: CodecParams, tokens: Tokens) -> DataFrame:
    """(file_id, view, agent_speaker, q, stream, seq, piece) of text and tokens, q in interleaved codes of the span.

    bounds: (file_id, trans_start, trans_end, n_codes, num_channels). A line goes to the running maximum of
    its positions; audio between two positions gets a start and an end token, even where codes have run out.
    """
    rows = lines.join(bounds, "file_id")
    audio_only = F.col("view") == "audio_only"
    lo = F.when(audio_only | F.col("trans_start").isNull(), F.lit(0)).otherwise(F.col("trans_start"))
    hi = F.when(audio_only | F.col("trans_end").isNull(), F.col("n_codes")).otherwise(F.col("trans_end"))
    audio_first = (F.col("view") == "audio_first") | ((F.col("view") == "agent") & (F.col("stream") == 0))
    secs = F.when(audio_first, F.col("end_secs")).otherwise(F.col("start_secs"))
    at = (secs * F.lit(codec.framerate) * F.lit(codec.num_codebooks)).cast("bigint")
    rows = rows.withColumn("lo", lo).withColumn("at", F.when(F.col("speaker").isNull(), hi).otherwise(at - at % codec.num_codebooks))
    order = Window.partitionBy(*KEYS, "stream").orderBy("line_no")
    rows = rows.withColumn("pos", F.greatest("lo", F.max("at").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("before", F.coalesce(F.lag("pos").over(order), F.col("lo"))).withColumn("_spoke", F.lag("speaker").over(order))
    audio = F.col("pos") > F.col("before")
    q = lambda p: ((F.least(p, F.col("n_codes")) - F.least(F.col("lo"), F.col("n_codes"))) * F.col("num_channels")).cast("bigint").alias("q")
    piece = lambda p, k, text: F.struct(q(p), (F.col("line_no").cast("bigint") * 4 + k).alias("seq"), text.alias("piece"))
    token = F.when(audio, F.array(piece(F.col("before"), 0, F.lit(tokens.audio)), piece(F.col("pos"), 1, F.lit(tokens.end_audio))))
    said = F.when(~audio & (F.col("_spoke") == F.col("speaker")), F.concat(F.lit(" "), "text")).otherwise(F.concat(F.lit(" "), "speaker", F.lit(": "), "text"))
    text = F.when(F.col("speaker").isNotNull(), F.array(piece(F.col("pos"), 2, said)))
    empty = F.array().cast("array<struct<q:bigint,seq:bigint,piece:string>>")
    return rows.select(*KEYS, "stream", F.explode(F.concat(F.coalesce(token, empty), F.coalesce(text, empty))).alias("e")).select(*KEYS, "e.q", "stream", "e.seq", "e.piece")


def merge_event_streams(pieces: DataFrame, tokens: Tokens) -> DataFrame:
    """(keys, q, piece): what stands at one position as one string, the streams in order.

    In the agent view doubled tokens become one, an empty stretch goes, and so does a leading start token before text.
    """
    ordered = F.array_sort(F.collect_list(F.struct("stream", "seq", "piece")))
    rows = pieces.groupBy(*KEYS, "q").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("piece"))
    start, end = tokens.audio, tokens.end_audio
    clean = F.col("piece")
    for found, into in ((start + start, start), (end + end, end), (start + end, "")):
        clean = F.replace(clean, F.lit(found), F.lit(into))
    rows = rows.withColumn("piece", F.when(F.col("view") == "agent", clean).otherwise(F.col("piece")))
    leading = (F.col("view") == "agent") & (F.col("q") == 0) & F.startswith("piece", F.lit(start)) & (F.length("piece") > len(start))
    return rows.withColumn("piece", F.when(leading, F.substring(F.col("piece"), F.lit(len(start) + 1), F.length("piece"))).otherwise(F.col("piece")))


def audio_windows(length: Column, context: Column, overlap: Column) -> Column:
    """How many windows of `context` codes, each `overlap` back from the end of the one before, cover a length."""
    return F.when(length <= context, F.lit(1)).otherwise(1 + F.ceil((length - context) / (context - overlap)))


def build_header(view: Column, speakers: Column, tokens: Tokens, voice: Column | None = None) -> Column:
    """View token, the speakers (not for audio only), the voice if there is one, and the end token."""
    first = F.coalesce(*[F.when(view == v, F.lit(tokens.view(v))) for v in VIEWS])
    each = F.array_join(F.transform(speakers, lambda s: F.concat(F.lit(f"{tokens.speaker} "), s)), "")
    header = F.concat(first, F.when(view == "audio_only", F.lit("")).otherwise(each))
    if voice is not None:
        header = F.concat(header, F.coalesce(F.concat(F.lit(tokens.agent_voice), voice), F.lit("")))
    return F.concat(header, F.lit(tokens.end_header))


def agent_prompt(agent: Column, user: Column, tokens: Tokens, voice: Column, opening: Column | None = None) -> Column:
    """The prompt that a live agent starts from: the header with both speakers and the voice, the opening text unless it is null or
    empty, and the token of audio."""
    header = F.concat(F.lit(tokens.agent), *[F.concat(F.lit(f"{tokens.speaker} "), s) for s in (agent, user)], F.lit(tokens.agent_voice), F.coalesce(voice, F.lit("")), F.lit(tokens.end_header))
    said = F.lit("") if opening is None else F.when(F.length(opening) > 0, F.concat(F.lit(" "), agent, F.lit(": "), opening)).otherwise(F.lit(""))
    return F.concat(header, said, F.lit(tokens.audio))


def windows(views: DataFrame, bounds: DataFrame, codec: CodecParams, context_secs: float, overlap_secs: float) -> DataFrame:
    """(keys, example_index, s, e, length, skip): windows over the interleaved codes of a view's span. skip: codes of a channel before the span."""
    rows = views.filter(F.col("view") != "text_only").join(bounds, "file_id")
    whole = (F.col("view") == "audio_only") | F.col("trans_start").isNull()
    lo = F.when(whole, F.lit(0)).otherwise(F.least("trans_start", "n_codes"))
    hi = F.when(whole, F.col("n_codes")).otherwise(F.least("trans_end", "n_codes"))
    unit = F.col("num_channels") * codec.num_codebooks
    size = lambda secs: (F.lit(secs * codec.framerate) * unit).cast("bigint")
    rows = rows.withColumn("length", (F.greatest(hi - lo, F.lit(0)) * F.col("num_channels")).cast("bigint")).withColumn("skip", lo.cast("int")).withColumn("c", size(context_secs)).withColumn("d", F.col("c") - size(overlap_secs))
    good = F.when((F.col("c") % unit != 0) | (F.col("d") % unit != 0), F.raise_error(F.lit("windows must hold whole frames"))).otherwise(audio_windows(F.col("length"), F.col("c"), F.col("c") - F.col("d")))
    rows = rows.withColumn("n", good.cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(*KEYS, F.col("k").alias("example_index"), "num_channels", (F.col("k") * F.col("d")).alias("s"), F.least(F.col("k") * F.col("d") + F.col("c"), F.col("length")).alias("e"), "length", "skip", "c", "d", "n")


def events_in_windows(pieces: DataFrame, spans: DataFrame) -> DataFrame:
    """Pieces with the indexes of the windows that hold them, by arithmetic: (s = 0 or q > s) and q <= e.

    spans: (keys, c, d, n) of each view."""
    rows = pieces.join(spans, [pieces["file_id"] == spans["file_id"], pieces["view"] == spans["view"], pieces["agent_speaker"].eqNullSafe(spans["agent_speaker"])])
    rows = rows.select(*[pieces[c] for c in KEYS], "q", "piece", "c", "d", "n")
    first = F.greatest(F.lit(0), F.ceil((F.col("q") - F.col("c")) / F.col("d")))
    last = F.least(F.col("n") - 1, F.greatest(F.lit(0), F.ceil(F.col("q") / F.col("d")) - 1))
    rows = rows.withColumn("a", first.cast("int")).withColumn("b", last.cast("int")).filter("a <= b")
    return rows.select(*KEYS, F.explode(F.sequence("a", "b")).alias("example_index"), "q", "piece")


def lead_channels(spans: DataFrame, channel_map: DataFrame | None) -> DataFrame:
    """spans with `lead`, the channel that comes first: that of the agent in the agent view, of speaker A in the others; 0 if the
    map (file_id, speaker letter, channel) doesn't know it."""
    if channel_map is None:
        return spans.withColumn("lead", F.lit(0))
    known = channel_map.select("file_id", F.col("speaker").alias("_who"), F.col("channel").cast("int").alias("_channel"))
    rows = spans.withColumn("_who", F.coalesce("agent_speaker", F.lit("A"))).join(known, ["file_id", "_who"], "left")
    return rows.withColumn("lead", F.coalesce("_channel", F.lit(0))).drop("_who", "_channel")


def render(spans: DataFrame, placed: DataFrame, blocks: DataFrame, codec: CodecParams, block: int) -> DataFrame:
    """(keys, example_index, s, e, length, body): slices of audio and the pieces between them, in order.

    spans: windows with their `lead` channel. The windows that begin in a block come to its codes (code_blocks) as one row, which is cut into
    their slices, so the work grows with the audio of the windows, is dealt by stretches of a file, and no row stands for a single code.
    """
    same = lambda a, b: [a["file_id"] == b["file_id"], a["view"] == b["view"], a["agent_speaker"].eqNullSafe(b["agent_speaker"]), a["example_index"] == b["example_index"]]
    own = placed.groupBy(*KEYS, "example_index").agg(F.array_sort(F.collect_list(F.struct("q", "piece"))).alias("pieces"))
    kept = ["view", "agent_speaker", "example_index", "s", "e", "length", "lead", "pieces"]
    at = F.col("skip") + F.floor(F.col("s") / F.col("num_channels"))
    rows = spans.join(own, same(spans, own), "left").select(*[spans[c] for c in ("file_id", *kept[:-1])], "num_channels", "pieces", at.alias("at")).withColumn("block", F.floor(F.col("at") / block).cast("int"))
    wins = rows.groupBy("file_id", "block").agg(F.collect_list(F.struct(*kept, "at", "num_channels")).alias("_windows")).join(blocks, ["file_id", "block"], "left")

    def cut(w: Column) -> Column:
        n = F.greatest(((w["e"] - w["s"]) / w["num_channels"]).cast("int"), F.lit(0))
        silent = F.array_repeat(F.array().cast("array<int>"), w["num_channels"])  # the audio ended before
        part = F.transform(F.coalesce("channels", silent), lambda c: F.slice(c, (w["at"] - F.col("block") * block + 1).cast("int"), n))
        return F.struct(*[w[c].alias(c) for c in kept], part.alias("part"))

    rows = wins.select("file_id", F.explode(F.transform("_windows", cut)).alias("w")).select("file_id", "w.*")
    # the audio is carried by the fold, so that it is made once and not for every piece
    audio = codes_to_chars(interleave_channels(swap_agent_channel(F.col("part"), F.col("lead"))), codec.unicode_offset)
    start = F.struct(F.col("s").alias("from"), F.col("s").alias("at"), audio.alias("audio"), F.lit("").alias("t"))
    text = lambda acc, n: F.substring(acc["audio"], (acc["at"] - acc["from"] + 1).cast("int"), n)
    step = lambda acc, p: F.struct(acc["from"].alias("from"), p["q"].alias("at"), acc["audio"].alias("audio"), F.concat(acc["t"], text(acc, (p["q"] - acc["at"]).cast("int")), p["piece"]).alias("t"))
    done = lambda acc: F.concat(acc["t"], text(acc, F.lit(2147483647)))
    body = F.aggregate(F.coalesce("pieces", F.array().cast("array<struct<q:bigint,piece:string>>")), start, step, done)
    return rows.select(*KEYS, "example_index", "s", "e", "length", body.alias("body"))


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def text_windows(df: DataFrame, context: int = 3000, overlap: int = 750) -> DataFrame:
    """(file_id, example_index, start_word, end_word, text) over an array of words and the speakers' array.

    The next window starts `overlap` words before the end of the last, rolled forward to the next speaker's word or to that end.
    The places of the speakers' words are an index that each window is found by with one search.
    """

    @F.arrow_udf("array<struct<a:int,b:int>>")
    def jumps(sizes: pa.Array, turns: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(turns).to_numpy(zero_copy_only=False))])
        places, out = turns.flatten().to_numpy(zero_copy_only=False), []
        for n, i, j in zip(sizes.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own, start, spans = places[i:j], 0, []
            while not spans or spans[-1][1] < n:
                end = start + context
                spans.append((start, min(end, n)))
                k = int(np.searchsorted(own, end - overlap))
                start = min(int(own[k]), end) if k < len(own) else end
            out.append([{"a": a, "b": b} for a, b in spans])
        return pa.array(out, _SPANS)

    tags = F.transform("speakers", lambda s: F.concat(s, F.lit(":")))
    turns = F.array_compact(F.transform("words", lambda w, i: F.when(F.array_contains(F.col("_tags"), w), i)))
    rows = df.withColumn("_tags", tags).select("file_id", "words", F.posexplode(jumps(F.size("words"), turns)).alias("example_index", "w"))
    text = F.array_join(F.slice("words", F.col("w.a") + 1, F.greatest(F.col("w.b") - F.col("w.a"), F.lit(0))), " ")
    return rows.select("file_id", "example_index", F.col("w.a").alias("start_word"), F.col("w.b").alias("end_word"), text.alias("text"))


def text_only_words(lines: DataFrame) -> DataFrame:
    """(file_id, words, speakers) of the " X: text" pieces of a file in order."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "speaker", "text"))), lambda x: F.concat(x["speaker"], F.lit(": "), x["text"]))
    rows = lines.groupBy("file_id").agg(F.array_join(said, " ").alias("t"), F.array_sort(F.collect_set("speaker")).alias("speakers"))
    return rows.select("file_id", words(F.col("t")).alias("words"), "speakers")


def attach_transcripts(codes: DataFrame, lines: DataFrame, codec: CodecParams, need_text: bool = False, channel_map: DataFrame | None = None) -> DataFrame:
    """Files with their bounds and speakers: (file_id, channels, num_channels, n_codes, trans_start, trans_end, speakers), and with a channel
    map their `channel_map`, speaker to channel, empty for a mono file (see own_channel_map)."""
    who = lines.groupBy("file_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    out = codes.join(transcript_bounds(lines, codec), "file_id", "inner" if need_text else "left").join(who, "file_id", "left")
    out = out.withColumn("speakers", F.coalesce("speakers", F.array().cast("array<string>")))
    if channel_map is None:
        return out
    known = own_channel_map(channel_map, codes).groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "channel")))).alias("channel_map"))
    return out.join(known, "file_id", "left").withColumn("channel_map", F.coalesce("channel_map", F.create_map().cast("map<string,int>")))
