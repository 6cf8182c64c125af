"""Readers: each gives a DataFrame with a declared schema."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_line, nonempty, strip
from ..operators.transcripts import filter_paths, letters_by_first_seen
from ..schemas import FILE_SPLITS, GIGASPEECH, LIBRIHEAVY

GIGASPEECH_PATHS = r"/podcast/P0000/|/youtube/P00[0-3][0-9]/"


def relative_id(path, root: str):
    """A path below root, without its extension."""
    clean = F.regexp_replace(path, r"^file:/*", "/")
    below = F.substring(clean, F.lit(len(root.rstrip("/").replace("file://", "")) + 2), F.length(clean))
    return F.regexp_replace(F.when(F.contains(clean, F.lit(root.rstrip("/").replace("file://", ""))), below).otherwise(clean), r"\.[^./]*$", "")


def list_files(spark: SparkSession, root: str, suffix: str = "", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, file_id, folder, corpus_id) of the files below root; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    files = filter_paths(files.filter(F.endswith("path", F.lit(suffix))), include, exclude)
    files = files.withColumn("file_id", relative_id(F.col("path"), root))
    return files.withColumn("folder", F.regexp_extract("file_id", r"^(.*)/[^/]*$", 1)).withColumn("corpus_id", F.split("file_id", "/")[0])


def read_chat_utterances(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, line_idx, speaker, text, mark_start_ms, mark_end_ms, participants) of the main-tier lines of CHAT files.

    A main tier begins with *SPEAKER: and goes on over lines that begin with a tab.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file_id"), F.regexp_replace("value", r"\r?\n\t", " ").alias("value"))
    names = F.regexp_extract("value", r"(?m)^@Participants:\s*(.*)$", 1)
    rows = files.withColumn("participants", F.transform(F.split(names, r"\s*,\s*"), lambda p: F.split(p, r"\s+")[0]))
    rows = rows.select("file_id", "participants", F.posexplode(F.split("value", r"\r?\n")).alias("line_idx", "line")).filter(F.startswith("line", F.lit("*")))
    mark = "\x15([0-9]+)_([0-9]+)\x15"
    text = F.regexp_extract("line", r"^\*([^:]+):\s*(.*)$", 2)
    ms = lambda g: F.nullif(F.regexp_extract("line", mark, g), F.lit("")).cast("bigint")
    return rows.select("file_id", "line_idx", F.regexp_extract("line", r"^\*([^:]+):", 1).alias("speaker"), text.alias("text"), ms(1).alias("mark_start_ms"), ms(2).alias("mark_end_ms"), "participants")


def fisher_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """prefix (the first three words) and cleaned text of lines that aren't blank, comments, or empty when cleaned."""
    rows = df.withColumn("_l", strip(F.col(line))).filter((F.col("_l") != "") & ~F.startswith("_l", F.lit("#")))
    parts = F.split("_l", r"(?U)\s+")
    rows = rows.withColumn("_p", parts).withColumn("prefix", F.array_join(F.slice("_p", 1, 3), " ")).withColumn("_t", F.array_join(F.slice("_p", 4, 2147483643), " "))
    return rows.withColumn("text", nonempty(clean_line(F.col("_t")))).drop("_l", "_p", "_t")


def read_fisher_lines(spark: SparkSession, path: str) -> DataFrame:
    return fisher_lines(spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")))


def gigaspeech_utterances(df: DataFrame) -> DataFrame:
    """Utterances of the wanted audios of a document (audios[].segments[]), lower-cased and cleaned; speakers in order of appearance."""
    rows = df.select(F.explode("audios").alias("a")).filter(F.col("a.path").rlike(GIGASPEECH_PATHS))
    rows = rows.select(F.col("a.path").alias("file_id"), F.posexplode("a.segments").alias("line_idx", "s"))
    rows = rows.select("file_id", "line_idx", F.col("s.begin_time").alias("start_secs"), F.col("s.end_time").alias("end_secs"), "s.speaker", F.lower("s.text_tn").alias("text"))
    return letters_by_first_seen(rows).withColumn("text", nonempty(clean_line(F.col("text"))))


def read_gigaspeech(spark: SparkSession, path: str) -> DataFrame:
    """One document is one task: convert it once, then work from Parquet."""
    return gigaspeech_utterances(spark.read.schema(GIGASPEECH).json(path, multiLine=True))


def libriheavy_utterances(df: DataFrame) -> DataFrame:
    """Utterances of cuts: the start of the cut is added to the supervision's; speakers are lettered within a cut."""
    cut = F.sha2(F.to_json(F.struct("recording.id", "start")), 256)
    rows = df.select(F.col("recording.id").alias("recording"), F.col("start").alias("cut_start"), cut.alias("file_id"), F.posexplode("supervisions").alias("line_idx", "s"))
    begin = F.col("cut_start") + F.col("s.start")
    rows = rows.select("recording", "cut_start", "file_id", "line_idx", begin.alias("start_secs"), (begin + F.col("s.duration")).alias("end_secs"), "s.speaker", F.get("s.custom.texts", F.lit(0)).alias("text"))
    return letters_by_first_seen(rows).withColumn("text", nonempty(clean_line(F.col("text"))))


def read_libriheavy(spark: SparkSession, paths: list[str]) -> DataFrame:
    return libriheavy_utterances(spark.read.schema(LIBRIHEAVY).json(paths))


def transcript_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """start_secs, end_secs, speaker and text of "start end SPK: text" lines; blank lines and empty texts go."""
    rows = df.withColumn("_l", strip(F.col(line))).filter(F.col("_l") != "").withColumn("_p", F.split("_l", r"(?U)\s+"))
    rows = rows.withColumn("start_secs", F.try_element_at("_p", F.lit(1)).cast("double")).withColumn("end_secs", F.try_element_at("_p", F.lit(2)).cast("double"))
    rows = rows.withColumn("speaker", F.regexp_replace(F.try_element_at("_p", F.lit(3)), ":+$", "")).withColumn("text", F.array_join(F.slice("_p", 4, 2147483643), " "))
    return rows.filter(F.length("text") > 0).drop("_l", "_p")


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(file_id, line_idx, start_secs, end_secs, speaker, text) of transcript files below root."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(relative_id(F.col("_metadata.file_path"), root).alias("file_id"), "value")
    rows = files.select("file_id", F.posexplode(F.split("value", r"\r?\n")).alias("line_idx", "line"))
    return transcript_lines(rows).select("file_id", "line_idx", "start_secs", "end_secs", "speaker", "text")


def read_channel_map(spark: SparkSession, root: str) -> DataFrame:
    from ..operators.channels import parse_channel_map

    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*_channel_map.json")
    name = F.regexp_replace(relative_id(F.col("_metadata.file_path"), root), "_channel_map$", "")
    return parse_channel_map(files.select(name.alias("file_id"), F.col("value").alias("json")))


CODE_FILE = r"^(.+)_c(\d+)[_.](.*)$"


def _npy(raw: bytes) -> np.ndarray:
    """A .npy file's array, from its header and its bytes."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    size, start = struct.unpack("<H", raw[8:10]) + (10,) if raw[6] == 1 else struct.unpack("<I", raw[8:12]) + (12,)
    header = ast.literal_eval(raw[start : start + size].decode("latin-1"))
    return np.frombuffer(raw, header["descr"], offset=start + size).reshape(header["shape"], order="F" if header["fortran_order"] else "C")


def read_codes(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), num_codebooks: int = 1, size: int = 131072) -> DataFrame:
    """(file_id, channel, part_ts, codes) of the .npy files below root: name_c<channel>[_<part>].npy; other names are an error.

    Of several codebooks the first `num_codebooks` are taken, frame by frame.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root)
    files = filter_paths(files, include, exclude).select(relative_id(F.col("path"), root).alias("name"), "content")
    return code_files(files, num_codebooks, size)


def code_files(files: DataFrame, num_codebooks: int = 1, size: int = 131072) -> DataFrame:
    """(file_id, channel, part_ts, codes) of array files (name, content)."""
    part = lambda g: F.regexp_extract(F.concat("name", F.lit(".")), CODE_FILE, g)
    named = F.when(part(1) == "", F.raise_error(F.concat(F.lit("no channel in the name "), "name"))).otherwise(part(1))
    files = files.select(named.alias("file_id"), part(2).alias("channel"), F.regexp_replace(part(3), r"\.$", "").alias("part_ts"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = []
            for raw in b["content"]:
                x = _npy(bytes(raw))
                x = x.reshape(-1, x.shape[-1])[:num_codebooks]
                codes.append((x.astype(np.int64) + np.arange(len(x))[:, None] * size).T.ravel().astype(np.int32))
            yield pd.DataFrame({"file_id": b["file_id"], "channel": b["channel"].astype("int32"), "part_ts": b["part_ts"], "codes": codes})

    return files.mapInPandas(decode, "file_id string, channel int, part_ts string, codes array<int>")


def read_file_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SPLITS).csv(path, header=True)


def read_training_text(spark: SparkSession, path: str, keep_linebreaks: bool = True) -> DataFrame:
    """(text) of a csv, json or txt file: its column text, or its first one; other extensions are an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "txt":
        rows = spark.read.text(path).withColumnRenamed("value", "text")
        return rows.withColumn("text", F.concat("text", F.lit("\n"))) if keep_linebreaks else rows
    if kind not in ("csv", "json"):
        raise ValueError(f"a {kind} file isn't training text")
    rows = spark.read.csv(path, header=True) if kind == "csv" else spark.read.json(path)
    return rows.select(F.col("text" if "text" in rows.columns else rows.columns[0]).alias("text"))
