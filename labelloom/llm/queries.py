"""The registered queries: thin digests of the operators' results over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import bpe, decontaminate, kneser_ney, language, media, sharding, simhash, token_store, toxicity, wrapper
from labelloom.llm.common import fold_of, materialise, table

SHARDS = 24


def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(fold_of("doc_id", 3) != 1))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.to_json("lang_shares").alias("lang_shares"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.verified(spark, store)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that overlap benchmark items, with the best overlap for each item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sharding.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return written.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's perplexity under the model of trusted text, its language's threshold, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = materialise(kneser_ney.with_perplexity(docs, trusted, left_out=kneser_ney.ALL_FOLDS).drop("text"), "perplexity")
    return kneser_ney.judged(scored)


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_png(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", filtering="least")
    stored = stored.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    back = media.read_png(stored)
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
    )


QUERIES = {
    "op1_wrapper_text": op1_wrapper_text,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_language_mixture": op4_language_mixture,
    "op5_token_store": op5_token_store,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_png_media": op10_png_media,
}

#: Where SQL cannot express an operator, tests/llm compares it with a brute-force version.
ORACLES: dict[str, str] = {}
