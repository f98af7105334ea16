"""Training-data pipeline: language ID, SimHash near-dedup, suffix-array dedup,
benchmark decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` applies them one after the
other, each written as Parquet and read again.

* language_id: learns from the labelled rows of its input that are not held
  out; documents of null text or without a letter go.  The prediction decides
  ``lang`` where it is null, and where it differs with a score of at least
  ``RELABEL_SCORE``.  Where nothing could be learned the others stay as they are.
* simhash_near_dedup: of each group of documents within 4 bits, one stays.
* suffix_array_dedup: bytes of repeated ``PASSAGE_BYTES``-byte strings go from the text (and
  with them the rest of a character that a cut divides); ``n_chars`` follows.
* decontamination: documents that hold half of a benchmark item, or ``TILE_TOKENS``
  tokens of one in a row, go.
* bpe: token ids, their number, and digests of the ids and the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm import bpe, common, language_id
from envspark.llm.decontamination import decontaminate
from envspark.llm.queries import TILE_TOKENS, vocabulary_path
from envspark.llm.simhash import keep_one
from envspark.llm.suffix_dedup import kept_text, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Width of the suffix-array stage: a passage of 51 words is at least 203 bytes
#: long where its words have three letters on average, so 200 bytes catch it.
#: (op6 has its own width, 400 bytes, from its contract.)
PASSAGE_BYTES = 200

#: A label gives way to another predicted language from this score on.  Over the labelled
#: documents of sf0.1, 95 % of the predictions that agree with the label score 0.78 or more, half of the others below 0.53.
RELABEL_SCORE = 0.75


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    docs = docs.where(language_id.has_letter("text"))
    if model is None:
        return docs.select(*COLUMNS)
    sure = F.col("lang").isNull() | (F.col("score") >= RELABEL_SCORE)
    return language_id.predict(docs, model, keep=COLUMNS) \
        .withColumn("lang", F.when(sure & (F.col("lang_pred") != language_id.UNKNOWN), F.col("lang_pred"))
                    .otherwise(F.coalesce("lang", "lang_pred"))).select(*COLUMNS)


def stage_simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs.select(*COLUMNS), shingle=4, max_bits=4)


def stage_suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup(docs, width=PASSAGE_BYTES, keep=("doc_id", "lang", "source"))
    return out.withColumn("text", kept_text("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, keep=COLUMNS, min_tile=TILE_TOKENS).where("NOT contaminated").select(*COLUMNS)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return bpe.with_digests(bpe.decode(bpe.encode(docs, path, keep=("doc_id", "lang", "source")), path)) \
        .select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", stage_language_id),
    ("simhash_near_dedup", stage_simhash_near_dedup),
    ("suffix_array_dedup", stage_suffix_array_dedup),
    ("benchmark_decontamination", stage_decontamination),
    ("bpe", stage_bpe),
]

#: SQL has no SimHash, tiling or BPE; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
