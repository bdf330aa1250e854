import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from labelloom.llm import bpe, queries, stages
from labelloom.llm import simhash as S


def test_stages_are_listed():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0.4 * len(texts) < len(out) < len(texts)
    assert all(r["text"] == texts[r["doc_id"]] for r in out)
    assert len({r["text"] for r in out}) == len(out)


def test_near_dedup_by_brute_force(spark, sf_dir):
    """Of texts linked by a similarity of 0.8 the least id stays, and every text without such a link."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in stages.near_dedup(spark, docs, sf_dir).collect()}
    shingles = {r["doc_id"]: frozenset(S.shingle_hashes(r["text"], 5).tolist()) for r in docs.collect()}
    ids = sorted(shingles)
    least = {i: i for i in ids}
    for x in ids:
        for y in ids:
            if x < y and len(shingles[x] & shingles[y]) >= 0.8 * len(shingles[x] | shingles[y]):
                a, b = least[x], least[y]
                least = {i: min(a, b) if r in (a, b) else r for i, r in least.items()}
    want = {i for i in ids if least[i] == i}
    assert want <= kept and len(kept - want) <= 0.01 * len(ids)


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, docs, empty, labels, tmp_path, k):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "quick brown fox jumps"), (1, None)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    assert "doc_id" in out.columns and out.count() <= docs.count()
    if k < 4:
        assert out.columns == docs.columns
    assert stage(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    rows = out.count()
    source = "pages" if name.startswith("op1_") else "documents"
    assert rows > 0 and (name.startswith("op6_") or rows == spark.read.parquet(f"{sf_dir}/{source}.parquet").count())


def test_ids_column_unpacks(spark):
    row = spark.range(1).select(F.lit(bytes([1, 0, 0, 0, 0, 1, 0, 0])).alias("ids")).select(bpe.unpack(F.col("ids")).alias("x")).first()
    assert row["x"] == [1, 256]
