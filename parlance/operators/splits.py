"""Train, dev and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Files of a corpus are ranked by so many hexadecimal digits of their hash first.
HASH_DIGITS = 3


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `_place`, the number of each row in a stable order, from 0, and `_total`, how many there are.

    Rows are sorted by range and written, so that a lost task can't number them anew; each partition's rows are offset by those before it.
    """
    ordered = staged(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    offsets = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    rows = ordered.join(F.broadcast(offsets.select("_part", "_first", "_before", "_total")), "_part")  # a row a partition
    return rows.withColumn("_place", F.col("_before") + F.col("_id") - F.col("_first")).drop("_part", "_id", "_first", "_before")


def corpus_files(examples: DataFrame) -> DataFrame:
    """(file_id, corpus_id) of all examples; the corpus is the first part of the file's path."""
    return examples.select("file_id").distinct().withColumn("corpus_id", F.split("file_id", "/")[0])


def corpus_file_counts(examples: DataFrame) -> DataFrame:
    return corpus_files(examples).groupBy("corpus_id").agg(F.count("*").alias("files"))


def file_split(files: DataFrame, seed: int = 42, train: float = 0.94, dev: float = 0.02, test: float = 0.04) -> DataFrame:
    """(file_id, corpus_id, split): the files of a corpus in the order of a hash, cut by ratio; one dev file at least, if there are two.

    A corpus is ranked by the first bits of the hash: files are counted by these, and only those that share them are put in order together.
    """
    if min(train, dev, test) <= 0 or abs(train + dev + test - 1) > 1e-9:
        raise ValueError("ratios must be positive and have the sum 1")
    rows = files.select("file_id", "corpus_id", F.md5(F.concat(F.lit(f"{seed}:"), "file_id")).alias("_h")).withColumn("_k", F.substring("_h", 1, HASH_DIGITS))
    counts = rows.groupBy("corpus_id", "_k").agg(F.count("*").alias("_c"))
    corpus = Window.partitionBy("corpus_id")
    before = F.sum("_c").over(corpus.orderBy("_k")) - F.col("_c")
    offsets = counts.select(F.col("corpus_id").alias("_corpus"), F.col("_k").alias("_key"), before.alias("_before"), F.sum("_c").over(corpus).alias("_n"))
    rows = rows.join(offsets, F.col("corpus_id").eqNullSafe(F.col("_corpus")) & (F.col("_k") == F.col("_key")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("corpus_id", "_k").orderBy("_h", "file_id")) - 1
    rows = rows.withColumn("_i", place)
    part = lambda ratio: F.greatest(F.lit(1), (F.col("_n") * F.lit(ratio)).cast("int"))
    split = F.when(F.col("_i") < part(train), "train").when(F.col("_i") < part(train) + part(dev), "dev").otherwise("test")
    return rows.select("file_id", "corpus_id", split.alias("split"))


def assign_split(examples: DataFrame, splits: DataFrame) -> DataFrame:
    """Examples with their file's split; a file without one is an error. The list of files joins by key, small or large."""
    rows = examples.join(splits.select("file_id", F.col("split")), "file_id", "left")
    return rows.withColumn("split", F.coalesce("split", F.raise_error(F.concat(F.lit("no split for "), "file_id"))))


def head_validation(df: DataFrame, percent: int, *order: str) -> DataFrame:
    """is_validation: the first percent of the rows in a stable order.

    Places come from a range sort, see numbered.
    """
    rows = numbered(df, *order)
    return rows.withColumn("is_validation", F.col("_place") < F.floor(F.col("_total") * percent / 100)).drop("_place", "_total")


def modulo_split(index: Column, percent: int) -> Column:
    """Validation below the percentage, training above it; a row at it is in neither."""
    m = F.pmod(index, F.lit(100))
    return F.when(m < percent, "validation").when(m > percent, "train")
