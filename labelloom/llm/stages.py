"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import bpe, decontaminate, kneser_ney, simhash, toxicity
from labelloom.llm.common import fold_of, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its limit or above go. It learns from the labels of this
    stage's own documents, in the same folds as the query of the operator.

    A null or empty text scores by the intercept; texts of any length are scored whole; a score equal to the
    limit goes; repeated rows are judged alike and each kept or not; without labels nothing goes; an empty
    table gives an empty table; all columns pass through, and one named `_toxicity` is not expected.
    """
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.train(docs, labels), out="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.REJECT).drop("_toxicity")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above their language's perplexity go; the model learns from this stage's trusted documents.

    A null or empty text has no perplexity and stays; one at the threshold stays; a null language is one of its
    own; repeated rows are judged alike; without trusted documents all stay; an empty table gives an empty table;
    columns named `trusted`, `perplexity`, `unseen`, `threshold` or `keep` are not expected, others pass through.
    """
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = materialise(kneser_ney.with_perplexity(docs, trusted, left_out=kneser_ney.ALL_FOLDS), "quality")
    return kneser_ney.judged(scored).where("keep").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (sets of five-word shingles, similarity 0.8) stays, that of
    the least id; of different texts with that id the one of least hash, of rows that repeat it one.

    Documents without an id stay. A null, empty or wordless text is like any other such; a text of fewer than
    five words is one shingle; texts of any length are compared whole; an empty table gives an empty table.
    """
    return simhash.representatives(docs, words=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items go.

    A null or empty text or item overlaps nothing; one overlap at the limits is enough; repeated rows are judged
    alike; an empty benchmark lets all stay; an empty table gives an empty table; all columns pass through.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, packed, and the text that they decode to.

    A null text counts as empty, with no ids; texts of any length are encoded whole; repeated rows are encoded
    alike; an empty table gives an empty table; doc_id, lang and source pass through, other columns go.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), path, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", "lang", "source", bpe.n_ids(F.col("ids")).alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))
