"""Utterances: lettering, cleaning, times, order, shares of speakers, partitions of a corpus."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line

# Number ranges (both ends included) of the partitions of a telephone corpus.
FISHER_PARTITIONS = [
    ("fe_03_p1_tran", 0, 7, "fisher_eng_tr_sp_d1"),
    ("fe_03_p1_tran", 8, 16, "fisher_eng_tr_sp_d2"),
    ("fe_03_p1_tran", 17, 25, "fisher_eng_tr_sp_d3"),
    ("fe_03_p1_tran", 26, 34, "fisher_eng_tr_sp_d4"),
    ("fe_03_p1_tran", 35, 43, "fisher_eng_tr_sp_d5"),
    ("fe_03_p1_tran", 44, 52, "fisher_eng_tr_sp_d6"),
    ("fe_03_p1_tran", 53, 58, "fisher_eng_tr_sp_d7"),
    ("fe_03_p2_tran", 58, 66, "fe_03_p2_sph1"),
    ("fe_03_p2_tran", 67, 75, "fe_03_p2_sph2"),
    ("fe_03_p2_tran", 76, 83, "fe_03_p2_sph3"),
    ("fe_03_p2_tran", 84, 91, "fe_03_p2_sph4"),
    ("fe_03_p2_tran", 92, 99, "fe_03_p2_sph5"),
    ("fe_03_p2_tran", 100, 108, "fe_03_p2_sph6"),
    ("fe_03_p2_tran", 109, 116, "fe_03_p2_sph7"),
]


def in_file() -> Window:
    return Window.partitionBy("file_id")


def letter(i: Column) -> Column:
    """A, B, C ... and again A after Z, for 0, 1, 2 ..."""
    return F.char(F.lit(65) + i % 26)


def filter_paths(df: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), path: str = "path") -> DataFrame:
    """Rows whose path has any of `include` (if given) and none of `exclude`."""
    c, include = F.col(path), list(include)
    keep = reduce(lambda x, s: x | c.contains(s), include, F.lit(False)) if include else F.lit(True)
    return df.filter(reduce(lambda x, s: x & ~c.contains(s), exclude, keep))


def derive_ids(df: DataFrame, path: str = "path") -> DataFrame:
    """file_id (path without extension), corpus_id (its first part) and folder (all but its last)."""
    stem = F.regexp_replace(F.col(path), r"\.[^./]*$", "")
    return df.withColumn("file_id", stem).withColumn("corpus_id", F.split(stem, "/")[0]).withColumn("folder", F.regexp_extract(stem, r"^(.*)/[^/]*$", 1))


def drop_blank(df: DataFrame, text: str = "text", chat: bool = False) -> DataFrame:
    """Without empty lines, or (chat) without those that are "." or "0."."""
    return df.filter(~F.col(text).isin(".", "0.")) if chat else df.filter(F.length(text) > 0)


def shift_times(df: DataFrame, offset: Column | None = None, milliseconds: bool = False) -> DataFrame:
    scale, offset = F.lit(1000.0 if milliseconds else 1.0), F.lit(0.0) if offset is None else offset
    return df.withColumn("start_secs", F.col("start_secs") / scale + offset).withColumn("end_secs", F.col("end_secs") / scale + offset)


def limit_examples(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stable order."""
    return df.orderBy(*order).limit(n)


def expand_time_marks(df: DataFrame, text: str = "text") -> DataFrame:
    """An utterance with two inline time marks or more becomes one for each: the text up to its mark. One with none or one stays.

    Marks are U+0015 start_end U+0015 in milliseconds; the first must be the utterance's own (mark_start_ms, mark_end_ms).
    """
    mark = "\x15([0-9]+)_([0-9]+)\x15"
    part = lambda group: F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.*?{mark})"), F.lit(group))
    rows = df.withColumn("_pieces", F.arrays_zip(part(1).alias("t"), part(2).alias("a"), part(3).alias("b")))
    first = F.get("_pieces", F.lit(0))
    own = (first["a"].cast("bigint") == F.col("mark_start_ms")) & (first["b"].cast("bigint") == F.col("mark_end_ms"))
    checked = F.when((F.size("_pieces") > 0) & ~F.coalesce(own, F.lit(False)), F.raise_error(F.lit("the first time mark isn't the utterance's own"))).otherwise(F.lit(0))
    kept = F.array(F.struct(F.col(text).alias("t"), F.col("mark_start_ms").cast("string").alias("a"), F.col("mark_end_ms").cast("string").alias("b")))
    rows = rows.withColumn("_bad", checked).withColumn("_p", F.when(F.size("_pieces") > 1, F.col("_pieces")).otherwise(kept))
    rows = rows.select(*[c for c in df.columns if c not in (text, "mark_start_ms", "mark_end_ms")], "_bad", F.posexplode("_p").alias("sub_idx", "_e"))
    return rows.select(*[c for c in rows.columns if c not in ("_bad", "_e")], (F.col("_e.a").cast("bigint") + F.col("_bad")).alias("mark_start_ms"), F.col("_e.b").cast("bigint").alias("mark_end_ms"), F.regexp_replace("_e.t", r"(?U)^\s+", "").alias(text))


def backfill_time_marks(df: DataFrame) -> DataFrame:
    """Untimed utterances get the times of the next timed one of the file; trailing ones go. Blank ones must be gone before."""
    ahead = in_file().orderBy("line_idx").rowsBetween(0, Window.unboundedFollowing)
    times = F.first(F.when(F.col("start_secs").isNotNull(), F.struct("start_secs", "end_secs")), ignorenulls=True).over(ahead)
    return df.withColumn("_t", times).filter("_t is not null").withColumn("start_secs", F.col("_t.start_secs")).withColumn("end_secs", F.col("_t.end_secs")).drop("_t")


def letters_by_first_seen(df: DataFrame) -> DataFrame:
    """Speakers of a file as letters in the order of their first line, empty lines included."""
    rows = df.withColumn("_first", F.min("line_idx").over(Window.partitionBy("file_id", "speaker")))
    return rows.withColumn("speaker", letter(F.dense_rank().over(in_file().orderBy("_first")) - 1)).drop("_first")


def letters_by_header(df: DataFrame, participants: str = "participants") -> DataFrame:
    """Speakers as letters in the order of the file's list of participants."""
    return df.withColumn("speaker", letter(F.array_position(participants, F.col("speaker")) - 1))


def dedupe_overlaps(df: DataFrame, key: str = "file_id") -> DataFrame:
    """A recording's lines against the last one that was kept: a longer one with the same start and speaker replaces it,
    one that starts before its end goes. What is kept decides, so this is a fold and no lag.

    A line that starts behind the end of all lines before it meets none of them: there a recording is cut, and each stretch is folded on its own.
    """
    order = Window.partitionBy(key).orderBy("start_secs", "line_idx")
    ended = F.max("end_secs").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("start_secs") > ended) & (F.col("end_secs") >= F.col("start_secs")), F.lit(False)).cast("int")
    # the fold carries places in the stretch, and the last kept line's times; lines stay where they are
    rows = df.withColumn("_cut", cut).withColumn("_stretch", F.sum("_cut").over(order))
    lines = F.array_sort(F.collect_list(F.struct("start_secs", "line_idx", F.struct(*df.columns).alias("row"))))
    stretches = rows.groupBy(key, "_stretch").agg(lines.alias("_l")).select("_l")
    kind = f"struct<n:int,at:int,start:double,end:double,who:{df.schema['speaker'].dataType.simpleString()},kept:array<int>>"
    first = F.from_json(F.lit('{"n": 0, "at": -1, "kept": []}'), kind)

    def step(acc: Column, line: Column) -> Column:
        row = line["row"]
        same = acc["who"].eqNullSafe(row["speaker"])
        longer = (acc["start"] == row["start_secs"]) & same & (row["end_secs"] > acc["end"])
        goes = (row["start_secs"] < acc["end"]) | ((acc["end"] == row["end_secs"]) & same & (row["start_secs"] > acc["start"]))
        begun = acc["at"] >= 0
        replace, skip = begun & F.coalesce(longer, F.lit(False)), begun & F.coalesce(goes, F.lit(False))
        kept = F.when(replace, acc["kept"]).when(skip, acc["kept"]).when(begun, F.concat(acc["kept"], F.array(acc["at"]))).otherwise(acc["kept"])
        stays = ~replace & skip
        now = lambda old, new: F.when(stays, old).otherwise(new)
        return F.struct(
            (acc["n"] + 1).alias("n"), now(acc["at"], acc["n"]).alias("at"), now(acc["start"], row["start_secs"]).alias("start"), now(acc["end"], row["end_secs"]).alias("end"),
            now(acc["who"], row["speaker"]).alias("who"), kept.alias("kept"),
        ).cast(kind)

    places = F.aggregate("_l", first, step, lambda acc: F.concat(acc["kept"], F.array(acc["at"])))
    kept = stretches.select(F.explode(F.transform(places, lambda i: F.get("_l", i)["row"])).alias("row"))
    return kept.select(*[F.col("row")[f].alias(f) for f in df.columns])


def sort_lines(df: DataFrame) -> DataFrame:
    """line_no: the place in the file by start, end and original index."""
    return df.withColumn("line_no", F.row_number().over(in_file().orderBy("start_secs", "end_secs", "line_idx")) - 1)


def speaker_proportions(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(file_id, speaker, duration_secs, share) of the speakers whose share of the file is the threshold or more; a file without any duration has null shares and keeps all.

    Durations are summed in the order of lines, totals in that of speakers: another order gives other last digits, which decide at the threshold.
    """
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    own = Window.partitionBy("file_id", "speaker").orderBy("line_idx", "start_secs", "end_secs").rowsBetween(*whole)
    each = df.select("file_id", "speaker", F.sum(F.col("end_secs") - F.col("start_secs")).over(own).alias("duration_secs")).groupBy("file_id", "speaker").agg(F.max("duration_secs").alias("duration_secs"))
    shares = each.withColumn("share", F.try_divide("duration_secs", F.sum("duration_secs").over(in_file().orderBy("speaker").rowsBetween(*whole))))
    return shares.filter(F.coalesce(F.col("share") >= threshold, F.lit(True)))


def remap_speakers(kept: DataFrame) -> DataFrame:
    """(file_id, speaker, letter): the kept speakers in sorted order without gaps."""
    return kept.select("file_id", "speaker", letter(F.dense_rank().over(in_file().orderBy("speaker")) - 1).alias("letter"))


def load_transcripts(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Lines with a text of the speakers that hold the threshold, re-lettered and in order (line_no)."""
    df = df.filter(F.length("text") > 0)
    letters = remap_speakers(speaker_proportions(df, threshold))
    return sort_lines(df.join(letters, ["file_id", "speaker"]).withColumn("speaker", F.col("letter")).drop("letter"))


def fisher_partition(df: DataFrame, part: str = "part", num: str = "num") -> DataFrame:
    """partition of each (part, number); a number that no range holds is an error."""
    ranges = df.sparkSession.createDataFrame(FISHER_PARTITIONS, "_part string, _lo int, _hi int, partition string")
    rows = df.join(F.broadcast(ranges), (F.col(part) == F.col("_part")) & F.col(num).between(F.col("_lo"), F.col("_hi")), "left").drop("_part", "_lo", "_hi")
    return rows.withColumn("partition", F.coalesce("partition", F.raise_error(F.concat(F.lit("no partition for "), F.col(part), F.lit(" "), F.col(num)))))


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)


def clean_chat(df: DataFrame) -> DataFrame:
    """Raw utterances with participants and marks in ms to lettered, cleaned, timed lines."""
    rows = letters_by_header(df).withColumn("text", clean_line(F.col("text"), remove_bracketed=True))
    rows = rows.withColumn("start_secs", F.col("mark_start_ms") / F.lit(1000.0)).withColumn("end_secs", F.col("mark_end_ms") / F.lit(1000.0))
    return backfill_time_marks(drop_blank(rows, chat=True)).drop("mark_start_ms", "mark_end_ms", "participants")
