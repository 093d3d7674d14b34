"""The registered queries: each applies one operator to its whole table and returns the columns that are asked of it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import langid, lm, media, mixing, packing, pii, quality, sharding, simhash, vectors

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int, held: int) -> Column:
    """Whether the CRC-32 of the column as text leaves `held` when divided by `folds`; a null is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == held, F.lit(False))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "repeats")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", fold("doc_id", 3, 1))
    return langid.identify(docs, langid.fit(docs.filter("not held_out")), ["doc_id", "held_out"])


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 16).withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(table(spark, sf_dir, "documents")))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 7, 2))
    model, counts = lm.fit(docs.filter("not held_out").select("text"))
    return lm.score(docs, model, counts, ["doc_id", "held_out"])


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_mix_sources, op2_pack_sequences, op3_quality_filter, op4_language_id, op5_jump_shards, op6_simhash_duplicates,
        op7_transport_streams, op8_lm_scores, op9_surrogates, op10_vector_duplicates,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """None can be said in SQL whole: each depends on a seeded hash, a tokenizer, a trained model or XXH64."""
    return {}
