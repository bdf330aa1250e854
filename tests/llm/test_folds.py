"""Thresholds of quality come from every trusted document, each scored by a model that has not seen it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import kneser_ney as K
from labelloom.llm import queries
from tests.llm.test_models import slow_model


@pytest.mark.parametrize("max_sent", [2_000_000, 300])
def test_every_trusted_document_is_scored_unseen(spark, sf_dir, max_sent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60 and n_chars < 3000").select("doc_id", "text", "lang")
    fold = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(K.FOLDS))).collect()}
    got = {r["doc_id"]: r for r in K.with_perplexity(docs, docs.where("doc_id % 3 < 2").select("doc_id"), max_sent=max_sent, left_out=K.ALL_FOLDS).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    trusted = {i for i in texts if i % 3 < 2}
    assert {fold[i] for i in trusted} == set(K.ALL_FOLDS)
    assert {i for i, r in got.items() if r["unseen"] is not None} == trusted
    for k in K.ALL_FOLDS:
        p = slow_model([texts[i] for i in trusted if fold[i] != k])
        for i in sorted(j for j in trusted if fold[j] == k)[:3]:
            padded = bytes(K.ORDER - 1) + texts[i]
            want = np.exp(-sum(np.log(p(padded[at : at + K.ORDER])) for at in range(len(texts[i]))) / len(texts[i]))
            assert got[i]["unseen"] == pytest.approx(want, rel=1e-4)


def test_a_fold_without_others_has_no_unseen(spark):
    docs = spark.createDataFrame([(1, "only text", "en"), (2, "another", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in K.with_perplexity(docs, docs.where("doc_id in (1, 3)").select("doc_id"), left_out=K.ALL_FOLDS).collect()}
    assert got[1]["unseen"] is None and got[1]["perplexity"] > 0 and got[2]["unseen"] is None and got[3]["perplexity"] is None


def test_the_query_takes_thresholds_from_every_trusted_document(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.kneser_ney, "judged", lambda scored: seen.append(scored) or scored)
    queries.op9_quality(spark, sf_dir)
    assert seen[0].where("trusted").count() == seen[0].where("trusted and unseen is not null").count() > 0
