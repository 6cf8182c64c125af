"""Schemas of the sources, codec parameters and the tokens of training examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

UTTERANCES = T.StructType().add("file_id", "string").add("corpus_id", "string").add("line_idx", "integer").add("start_secs", "double").add("end_secs", "double").add("speaker", "string").add("text", "string")
CHANNEL = T.StructType().add("channel", "integer").add("duration_secs", "double")
CHANNEL_MAP = T.MapType(T.StringType(), CHANNEL)
_SEGMENT = T.StructType().add("speaker", "string").add("text_tn", "string").add("begin_time", "double").add("end_time", "double")
GIGASPEECH = T.StructType().add("audios", T.ArrayType(T.StructType().add("path", "string").add("segments", T.ArrayType(_SEGMENT))))
_SUPERVISION = T.StructType().add("speaker", "string").add("start", "double").add("duration", "double").add("custom", T.StructType().add("texts", T.ArrayType(T.StringType())))
LIBRIHEAVY = T.StructType().add("start", "double").add("recording", T.StructType().add("id", "string")).add("supervisions", T.ArrayType(_SUPERVISION))
CODES = T.StructType().add("file_id", "string").add("channel", "integer").add("part_ts", "string").add("codes", T.ArrayType(T.IntegerType()))
FILE_SPLITS = T.StructType().add("file_id", "string").add("corpus_id", "string").add("split", "string")


@dataclass(frozen=True)
class CodecParams:
    """Of the audio codec: codebooks, codes in each, frames a second, and the code point of code 0."""

    num_codebooks: int = 1
    codebook_size: int = 131072
    framerate: float = 50.0
    unicode_offset: int = 0xE000


@dataclass(frozen=True)
class Tokens:
    """The special tokens of an example."""

    audio: str = "<|audio|>"
    end_audio: str = "<|end_audio|>"
    end_header: str = "<|end_header|>"
    speaker: str = "<|speaker|>"
    agent_voice: str = "<|agent_voice|>"
    audio_only: str = "<|audio_only|>"
    text_only: str = "<|text_only|>"
    audio_first: str = "<|audio_first|>"
    text_first: str = "<|text_first|>"
    agent: str = "<|agent|>"

    def view(self, name: str) -> str:
        return getattr(self, name)


VIEWS = ("audio_only", "text_only", "audio_first", "text_first", "agent")
