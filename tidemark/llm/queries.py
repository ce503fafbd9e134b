"""The registered queries: each applies one operator to its whole table.

The operators have interfaces of their own; what a query adds is the choice of
parameters and the digest columns of its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, line_dedup, minhash, mixing, sharding, token_sst, url_filter, warc
from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return judged.select("doc_id", "n_shingles", "component_id", "kept")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.PREFIX_RULES + url_filter.OWN_RULES)
    own = [r.text for r in url_filter.OWN_RULES]
    return judged.select("page_id", "host", "path", F.when(~F.col("rule").isin(own), F.col("rule")).alias("rule"), "verdict")


def op3_token_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_sst.write_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_sst.read_tables(spark, manifest)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=1000)
    records = warc.read_archives(spark, manifest, whole=True)
    return records.select(F.col("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn_from=~langid.held_out(F.col("doc_id")))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build_index(vectors, k=5), vectors.filter("vec_id % 50 = 0"), k=5)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_token_sst": op3_token_sst,
    "op4_warc": op4_warc,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_shard": op7_shard,
    "op8_ann": op8_ann,
    "op9_mix": op9_mix,
    "op10_line_dedup": op10_line_dedup,
}
