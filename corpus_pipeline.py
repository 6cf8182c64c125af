"""A training-corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import stored
from parlance.llm.decontaminate import decontaminate
from parlance.llm.language_id import UNKNOWN, held_out, language_udf, train
from parlance.llm.pieces import encode
from parlance.llm.pii import redact
from parlance.llm.similar import deduplicate
from parlance.session import prepare

#: Documents must score more than this in the language stage.
LEAST = 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without letters, and those of score LEAST or less, all of whose
    words are in scripts that no learned language writes. The model learns from those not held out."""
    prepare(spark)
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    if not model.langs:  # nothing is learned that could reject a script
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_udf(docs, model)(F.col("text"))
    return docs.filter((found["lang"] != UNKNOWN) & (found["score"] > LEAST))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose sets of five-word shingles are 0.8 alike or more, the document of the smallest id stays."""
    prepare(spark)
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go."""
    prepare(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    prepare(spark)
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, score, nbest): the best segmentation of each text, and the scores of the next ones."""
    prepare(spark)
    return encode(docs).drop("text")


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: SQL has no XXH64, so SimHash groups can't be expressed; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
