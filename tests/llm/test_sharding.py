from collections import Counter

from labelloom.llm import sharding


def test_rows_law(docs, empty):
    out = sharding.write_shards(docs, 4).collect()
    assert len(out) == docs.count()
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert sharding.write_shards(empty, 4).count() == 0


def test_files_of_a_shard_hold_it_in_order(spark, tmp_path):
    from labelloom.llm.common import shared_dir

    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    out = sharding.write_shards(docs, 7)
    ranges: dict[int, list] = {}
    for name in out.inputFiles():
        slots = [r["slot"] for r in spark.read.parquet(name).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))
        ranges.setdefault(int(name.split("shard=")[1].split("/")[0]), []).append((slots[0], len(slots)))
    assert len(ranges) == 7 and shared_dir(spark) in out.inputFiles()[0].replace("file:///", "file:///")
    assert all(sum(n for _, n in r) in (142, 143) for r in ranges.values())


def test_order_does_not_depend_on_the_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    a = {r["doc_id"]: r["place"] for r in sharding.shuffled(docs, bucket_bytes=10_000).collect()}
    b = {r["doc_id"]: r["place"] for r in sharding.shuffled(docs.repartition(3).orderBy("text"), bucket_bytes=10_000).collect()}
    c = {r["doc_id"]: r["place"] for r in sharding.shuffled(docs, seed=18).collect()}
    assert a == b and sorted(a.values()) == list(range(len(a))) and a != c


def test_fisher_yates_is_a_fair_permutation():
    first = Counter(int(sharding.fisher_yates(5, [k])[0]) for k in range(2000))
    assert sorted(sharding.fisher_yates(50, [1]).tolist()) == list(range(50))
    assert all(300 < first[k] < 500 for k in range(5))
