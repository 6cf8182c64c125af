"""Training examples from codes and transcripts: the flagship job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import interleave as I
from ..operators import voice as V
from ..operators.transcripts import load_transcripts
from ..schemas import CodecParams, Tokens
from ..session import staged


def training_examples(
    utterances: DataFrame, code_parts: DataFrame, view: str = "all", codec: CodecParams = CodecParams(), tokens: Tokens = Tokens(), context_secs: float = 80.0, overlap_secs: float = 20.0,
    threshold: float = 0.1, channel_map: DataFrame | None = None, seed: int = 42, text_context: int = 3000, text_overlap: int = 750,
    block_strides: int = I.BLOCK_STRIDES,
) -> DataFrame:
    """(file_id, view, agent_speaker, example_index, text) of one view, or of all. Files without codes have no examples.

    Transcripts, views, events and windows are small tables by file, made once. The codes are shuffled once, by file and block (see
    code_blocks), and cut into the slices of the windows that begin there. With a channel map (file_id, speaker letter, channel, isolated) the
    agent's channel comes first, that of speaker A in the views without an agent, and agent examples have a voice sample; a mono file ignores
    the map, and a channel that a file lacks is an error.
    """
    lines = staged(load_transcripts(utterances, threshold), "lines")
    texts = text_only(lines, tokens, text_context, text_overlap).select("file_id", F.lit("text_only").alias("view"), F.lit(None).cast("string").alias("agent_speaker"), "example_index", "text")
    if view == "text_only":
        return texts.join(code_parts.select("file_id").distinct(), "file_id", "left_semi")
    block, halo = I.block_sizes(codec, context_secs, overlap_secs, V.LONGEST_SECS, block_strides)
    blocks = I.code_blocks(code_parts, staged(I.part_offsets(code_parts), "offsets"), block, halo)
    files = staged(I.attach_transcripts(I.code_lengths(code_parts), lines, codec), "files")
    bounds = files.select("file_id", "trans_start", "trans_end", "n_codes", "num_channels")
    views = I.build_views(files.select("file_id", "speakers"), view)
    pieces = I.merge_event_streams(I.events(I.streams(views, lines), bounds, codec, tokens), tokens)
    spans = I.windows(views, bounds, codec, context_secs, overlap_secs)
    placed = I.events_in_windows(pieces, spans.filter("example_index = 0").select(*I.KEYS, "c", "d", "n"))
    known = None if channel_map is None else staged(I.own_channel_map(channel_map, files), "channels")
    body = I.render(I.lead_channels(spans, known), placed, blocks, codec, block).join(files.select("file_id", "speakers"), "file_id")
    voice = None
    if known is not None:
        body = body.join(agent_voices(lines, files, blocks, spans, known, codec, block, seed), [*I.KEYS[:1], "agent_speaker", "example_index"], "left")
        voice = F.when(F.col("view") == "agent", F.col("voice"))
    out = body.select(*I.KEYS, "example_index", F.concat(I.build_header(F.col("view"), F.col("speakers"), tokens, voice), "body").alias("text"))
    if view != "all":
        return out
    return out.unionByName(texts.join(files.select("file_id"), "file_id", "left_semi"))


def agent_voices(lines: DataFrame, files: DataFrame, blocks: DataFrame, spans: DataFrame, channel_map: DataFrame, codec: CodecParams, block: int, seed: int = 42) -> DataFrame:
    """(file_id, agent_speaker, example_index, voice): the characters of the sample chosen for each agent example, cut from the block that it begins in."""
    chosen = chosen_voices(lines, files, spans, channel_map, codec, seed)
    rows = chosen.join(channel_map.select("file_id", F.col("speaker").alias("agent_speaker"), "channel"), ["file_id", "agent_speaker"], "left")
    at = F.floor(F.col("start_code") / block).cast("int")
    first = (F.col("start_code") - at * block + 1).cast("int")
    wanted = F.struct("agent_speaker", "example_index", F.coalesce("channel", F.lit(0)).alias("channel"), first.alias("first"), F.greatest((F.col("end_code") - F.col("start_code")).cast("int"), F.lit(0)).alias("n"))
    own = rows.groupBy("file_id", at.alias("block")).agg(F.collect_list(wanted).alias("_voices")).join(blocks, ["file_id", "block"], "left")
    codes = lambda v: F.coalesce(F.slice(F.get("channels", v["channel"]), v["first"], v["n"]), F.array().cast("array<int>"))
    cut = lambda v: F.struct(v["agent_speaker"].alias("agent_speaker"), v["example_index"].alias("example_index"), codes(v).alias("part"))
    rows = own.select("file_id", F.explode(F.transform("_voices", cut)).alias("v")).select("file_id", "v.*")
    return rows.select("file_id", "agent_speaker", "example_index", I.codes_to_chars(F.col("part"), codec.unicode_offset).alias("voice"))


def chosen_voices(lines: DataFrame, files: DataFrame, spans: DataFrame, channel_map: DataFrame, codec: CodecParams, seed: int = 42) -> DataFrame:
    ranges = V.speech_ranges(lines, codec)
    alone = V.non_overlapped_turns(ranges, files, channel_map)
    examples = spans.filter(F.col("view") == "agent").join(files.select("file_id", "trans_start"), "file_id")
    per = lambda c: F.col("trans_start") + F.floor(F.col(c) / F.col("num_channels"))
    full = examples.withColumn("e", F.col("s") + F.col("c"))  # the window as asked for, not cut to the audio
    wins = full.select("file_id", "agent_speaker", "example_index", per("s").alias("win_start"), per("e").alias("win_end"))
    return V.choose_agent_voice(alone, wins, seed)


def text_only(lines: DataFrame, tokens: Tokens = Tokens(), context: int = 3000, overlap: int = 750) -> DataFrame:
    """(file_id, example_index, text) of the text-only view of loaded lines."""
    words = I.text_only_words(lines)
    wins = I.text_windows(words, context, overlap).join(words.select("file_id", "speakers"), "file_id")
    return wins.select("file_id", "example_index", F.concat(I.build_header(F.lit("text_only"), F.col("speakers"), tokens), F.lit(" "), "text").alias("text"))


def text_only_examples(utterances: DataFrame, tokens: Tokens = Tokens(), context: int = 3000, overlap: int = 750, threshold: float = 0.1) -> DataFrame:
    """(file_id, example_index, text) of the text-only view."""
    return text_only(load_transcripts(utterances, threshold), tokens, context, overlap)
