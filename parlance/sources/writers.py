"""Writers: few large files, partitioned where a reader prunes by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import two_decimals
from ..operators.channels import channel_map_json, skip_existing


def transcript_text(df: DataFrame) -> DataFrame:
    """line: "start end SPK: text", times with two decimals by hundredths."""
    hundredths = lambda c: two_decimals(F.round(F.col(c) * 100))
    return df.withColumn("line", F.concat_ws(" ", hundredths("start_secs"), hundredths("end_secs"), F.concat("speaker", F.lit(":")), "text"))


def write_transcripts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines by corpus; the lines of a file are in one part, in order."""
    out = transcript_text(df).repartition("file_id").sortWithinPartitions("file_id", "line_idx")
    out.select("corpus_id", "file_id", "line_idx", "line").write.mode(mode).partitionBy("corpus_id").parquet(path)


def write_channel_map(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """(file_id, json) of each file; without overwrite those that are there stay and only new files are added."""
    new = channel_map_json(df)
    if overwrite:
        new.write.mode("overwrite").parquet(path)
        return
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        new = skip_existing(new, spark.read.parquet(path))
    new.write.mode("append").parquet(path)


def write_examples(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Examples with their metadata in one table (parquet or json), or their texts alone (text)."""
    out = df.select("text") if kind == "text" else df
    out.write.mode(mode).format(kind).save(path)


def write_splits(examples: DataFrame, splits: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The list of files as CSV, and the examples by split."""
    from ..operators.splits import assign_split

    splits.select("file_id", "corpus_id", "split").write.mode(mode).csv(f"{path}/file_splits", header=True)
    assign_split(examples, splits).write.mode(mode).partitionBy("split").parquet(f"{path}/examples")
