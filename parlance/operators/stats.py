"""Durations, lengths and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_non_audio
from ..schemas import CodecParams, Tokens
from ..session import staged


def duration_by_folder(files: DataFrame, seconds: Column) -> DataFrame:
    """(folder, hours, files) of each folder; the row without a folder is the total."""
    return files.rollup("folder").agg((F.sum(seconds) / 3600).alias("hours"), F.count("*").alias("files"))


def code_seconds(codes: Column, framerate: float) -> Column:
    return F.size(codes) / F.lit(framerate)


def example_seconds(text: Column, codec: CodecParams, channels: int, tokens: Tokens, measure: str = "reference") -> Column:
    """Length of an example. audio_only counts code characters; reference also counts what stands before the first audio token."""
    if measure == "audio_only":
        n = F.length(strip_non_audio(text))
    else:
        right = F.regexp_replace(text, r"(?U)\s+\z", "")
        kept = F.array_join(F.transform(F.split(right, F.lit("\\Q" + tokens.audio + "\\E")), lambda p: F.substring_index(p, tokens.end_audio, 1)), "")
        n = F.length(F.when(F.startswith(kept, F.lit("<")), F.replace(F.replace(kept, F.lit("<"), F.lit("")), F.lit(">"), F.lit(""))).otherwise(kept))
    return n / F.lit(codec.num_codebooks * channels) / F.lit(codec.framerate)


def dataset_stats(lengths: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row: n (rows without a length too), and of the lengths sum, extremes, median, mean and deviation, null if there are none.

    Lengths are counted first and each different one is sorted by range, so no task has them all, however many share one; the
    median is where the running counts pass the middle.
    """
    counted = lengths.groupBy(F.col(seconds).cast("double").alias("v")).agg(F.count("*").alias("rows"))
    counted = staged(counted.orderBy("v").withColumn("part", F.spark_partition_id()), "lengths")
    rows = counted.withColumn("w", F.when(F.col("v").isNotNull(), F.col("rows")).otherwise(0))
    parts = rows.groupBy("part").agg(F.sum("w").alias("n"), F.sum(F.col("v") * F.col("w")).alias("s"))
    every, upto = Window.partitionBy(F.lit(0)), Window.orderBy("part")  # a row a partition
    parts = parts.select("part", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(every).alias("total"), (F.sum("s").over(every) / F.nullif(F.sum("n").over(every), F.lit(0))).alias("mean"))
    rows = rows.join(F.broadcast(parts), "part").withColumn("to", F.col("before") + F.sum("w").over(Window.partitionBy("part").orderBy("v")))
    at = lambda place: F.max(F.when((F.col("to") - F.col("w") <= place) & (place < F.col("to")), F.col("v")))
    n, total, off = F.nullif(F.sum("w"), F.lit(0)), F.sum(F.col("v") * F.col("w")), F.col("v") - F.col("mean")
    return rows.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), total.alias("total_secs"), (total / 3600).alias("total_hours"), F.max("v").alias("max_secs"),
        F.min("v").alias("min_secs"), ((at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2).alias("median_secs"),
        (total / n).alias("mean_secs"), F.sqrt(F.sum(F.col("w") * off * off) / n).alias("std_secs"),
    )


def exact_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, n): of each key's values that aren't null. Values are counted, then each different one is sorted by range, so that no task has
    a key whole; the median is where the running counts pass the middle."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("w"))
    rows = staged(counted.orderBy("k", "v").withColumn("part", F.spark_partition_id()), "values")
    parts = rows.groupBy("k", "part").agg(F.sum("w").alias("s"))  # a row a partition, and one a key
    own = Window.partitionBy("k")
    parts = parts.select(F.col("k").alias("_k"), F.col("part").alias("_part"), (F.sum("s").over(own.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(own).alias("n"))
    rows = rows.join(parts, F.col("k").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_part")))
    rows = rows.withColumn("to", F.col("before") + F.sum("w").over(Window.partitionBy("k", "part").orderBy("v")))
    at = lambda place: F.max(F.when((F.col("to") - F.col("w") <= place) & (place < F.col("to")), F.col("v")))
    found = rows.groupBy("k").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"), F.max("n").alias("n"))
    return found.withColumnRenamed("k", key)


def token_accuracy(df: DataFrame, labels: str = "labels", preds: str = "preds") -> DataFrame:
    """(accuracy, n): each prediction against the next label; labels of -100 don't count."""
    n = F.size(labels)
    pairs = F.arrays_zip(F.slice(labels, 2, F.greatest(n - 1, F.lit(0))).alias("l"), F.slice(preds, 1, F.greatest(n - 1, F.lit(0))).alias("p"))
    rows = df.select(F.explode(pairs).alias("x")).filter("x.l <> -100")
    return rows.agg(F.avg((F.col("x.l") == F.col("x.p")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def perplexity(loss: Column) -> Column:
    """exp of the mean loss; infinite beyond the range of doubles."""
    return F.exp(F.avg(loss))


def silence_centroid(embeddings: DataFrame, silent: Column) -> DataFrame:
    """(centroid): the mean embedding of the silent codes, one row."""
    each = embeddings.filter(silent).select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def silence_distances(embeddings: DataFrame, centroid: DataFrame) -> DataFrame:
    """(code, distance) from silence."""
    rows = embeddings.join(F.broadcast(centroid))  # one row
    square = F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("code", F.sqrt(square).alias("distance"))


def silence_distance_ratio(codes: DataFrame, distances: DataFrame, key: str = "chunk_id", most: int = 1 << 20) -> DataFrame:
    """(key, score): mean distance of own codes over that of other codes, rows (key, own, code).

    The table of codes is the codebook, whose size is checked before it is broadcast.
    """
    table = F.broadcast(distances) if distances.count() <= most else distances
    mean = lambda own: F.avg(F.when(F.col("own") == own, F.col("distance")))
    return codes.join(table, "code").groupBy(key).agg((mean(True) / (mean(False) + 1e-5)).alias("score"))


def pad_labels(df: DataFrame, batch: str, ids: str = "input_ids", pad: int = 0, multiple: int = 8) -> DataFrame:
    """ids padded to the batch's longest, rounded up to a multiple; labels are the ids with padding as -100."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_m"))
    length = (F.ceil(F.col("_m") / multiple) * multiple).cast("int")
    rows = df.join(longest, batch).withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad), length - F.size(ids))))
    return rows.withColumn("labels", F.transform(ids, lambda x: F.when(x == pad, F.lit(-100)).otherwise(x))).drop("_m")
