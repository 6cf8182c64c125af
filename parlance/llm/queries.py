"""The registered queries of the corpus operators: each applies its operator to the whole of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), _sha256(ids).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import SHARDS, shard

    placed = shard(_table(spark, sf_dir, "documents"), grow_to=SHARDS + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_shard")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, as_text, scores_as_text, spans

    found = _table(spark, sf_dir, "documents").select("doc_id", spans(F.col("text")).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = as_text(F.filter("s", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *map(count, BASE), _sha256(base).alias("base_sha256"), as_text(F.col("s")).alias("spans"), scores_as_text(F.col("s")).alias("scores"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import lookup, surt, write

    pages = _table(spark, sf_dir, "pages")
    read = lookup(write(pages), pages.select(surt(F.col("url")).alias("key"), "page_id"), payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import mux_text, parse

    stored = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), mux_text(F.col("text")).alias("media"))
    read = stored.select("doc_id", "n_bytes", "media", parse(F.col("media")).alias("p"))
    last = F.expr("substring(p.payload, -32, 32)")
    names = ("tracks", "clusters", "blocks", "cues", "cues_hit", "duration_ms", "mean_sample")
    feature = F.concat_ws(";", F.concat(F.lit("packets="), F.size("p.packets")), *(F.concat(F.lit(f"{n}="), F.col(f"p.{n}")) for n in names))
    payload = (F.octet_length("p.payload").cast("bigint").alias("payload_bytes"), F.sha2("p.payload", 256).alias("payload_sha256"), F.crc32(last).alias("tail_crc32"))
    return read.select("doc_id", "n_bytes", *payload, F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import as_text
    from .secret_scan import BASE, secrets

    found = _table(spark, sf_dir, "documents").select("doc_id", secrets(F.col("text")).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = as_text(F.filter("s", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *map(count, BASE), _sha256(base).alias("base_sha256"), as_text(F.col("s")).alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import decode_udf, encode

    found = encode(_table(spark, sf_dir, "documents"))
    back = found.withColumn("decoded", decode_udf()(F.col("ids")))
    same = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "score", F.get("nbest", F.lit(0))["ids_sha256"].alias("ids_sha256"), "nbest", same)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removed

    found = removed(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    found = identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import agreements

    return agreements(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import fill_in_middle, restored

    found = fill_in_middle(_table(spark, sf_dir, "documents"))
    counts = (F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"))
    return found.select("doc_id", "n", "form", *counts, _sha256(F.col("output")).alias("output_sha256"), _sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored
    from .fingerprints import as_hex, edits, likeness, near_rows

    found = near_rows(stored(edits(_table(spark, sf_dir, "documents")), "edits"))
    own, edited, following = (F.col(c) for c in ("own", "edited", "next"))
    likes = (likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"))
    return found.select("doc_id", "n_chars", "edited_sha256", as_hex(own).alias("fingerprint"), as_hex(edited).alias("edited_fingerprint"), *likes, "n_near")


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_sharding, op3_pii, op4_warc, op5_matroska, op6_secrets, op7_simhash, op8_pieces, op9_substring_dedup, op10_language_id, op11_alignment, op12_fill_in_middle, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
