"""Queries ``opN_<name>`` of the training-data operators: production
parameters, whole tables, digest columns derived from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm import alignment, bpe, common, language_id, packing, resharding, warc
from envspark.llm.common import documents
from envspark.llm.decontamination import decontaminate
from envspark.llm.embedding_dedup import embedding_dedup
from envspark.llm.negatives import mine_negatives
from envspark.llm.simhash import simhash_dedup
from envspark.llm.substring_dedup import substring_dedup
from envspark.llm.suffix_dedup import suffix_dedup
from envspark.llm.url_filter import url_filter

VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
OLD_SHARDS, SHARDS = 12, 16
#: A verbatim run of this many tokens of a benchmark item contaminates, whatever share of the item it is.
TILE_TOKENS = 13
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return bpe.with_digests(bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)) \
        .select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_tile=TILE_TOKENS)


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS))
    out = resharding.reshard(documents(spark, sf_dir), common.new_path(spark, "shards"), SHARDS, old)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), width=400).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(documents(spark, sf_dir), shingle=4, max_bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES) \
        .select("page_id", "host", "path", "rule", "verdict")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), packing.word_tokenizer(vocabulary_path(WORD_VOCABULARY)), window=4096, end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(documents(spark, sf_dir), alignment.byte_level_side(vocabulary_path()),
                          alignment.piece_side(vocabulary_path(PIECE_VOCABULARY)))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine_negatives(moved, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_embedding_near_dedup, op2_language_id, op3_bpe, op4_benchmark_decontamination, op5_resharding,
        op6_suffix_array_dedup, op7_simhash_near_dedup, op8_url_filter, op9_warc, op10_substring_dedup,
        op11_packing, op12_tokenizer_alignment, op13_hard_negatives)
}
