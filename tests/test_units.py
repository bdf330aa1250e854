"""Small literal cases with answers worked out by hand."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelloom import ml
from labelloom.checkpoints import ready
from labelloom.functions import scalars as S
from labelloom.functions import text as X
from labelloom.operators import joins, qa, sampling
from labelloom.operators import labels as L
from labelloom.sources import files, merges


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_domain_suffixes(spark):
    pages = spark.createDataFrame([(1, "a.b.com"), (2, "sports.a.b.com"), (3, "sportsa.b.com")], "page_id long, host string")
    rules = spark.createDataFrame([("a.b.com",), (".b.com",)], "domain string")
    got = {(r["page_id"], r["domain"]) for r in joins.suffix_join(pages, "host", rules, "domain").collect()}
    assert got == {(1, "a.b.com"), (1, ".b.com"), (2, "a.b.com"), (2, ".b.com"), (3, ".b.com")}


def test_keyword_weights(spark):
    pages = spark.createDataFrame([(1, ["big", "cat"], ["a", "big", "cat"]), (2, ["x"], ["big", "cat"]), (3, ["big", "cat"], ["x"])], "page_id long, title_tokens array<string>, body_tokens array<string>")
    keys = spark.createDataFrame([(1, "big cat", 0, 7), (2, "cat", 5, 9)], "label_id long, phrase string, title_weight int, body_weight int")
    got = {(r["page_id"], r["label_id"]): r["score"] for r in L.keyword_scores(pages, keys, 2).collect()}
    assert got == {(1, 1): 7, (1, 2): 5, (2, 1): 7, (2, 2): 9, (3, 1): 0, (3, 2): 5}


def test_target_counts_once_for_each_active_video(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = L.page_scores(L.target_scores(frame([(1, 9)], "page_id long, target_id long"), frame([(5, 9), (6, 9)], "video_id long, target_id long"), frame([(1, 5), (1, 6)], "page_id long, video_id long"), frame([(3, 9, 40)], "label_id long, target_id long, weight int")))
    assert got.first()["score"] == 120


def test_roll_up_overrides_and_delta(spark):
    ready(spark)
    edges = spark.createDataFrame([(1, 2, 100), (2, 3, 100)], "parent_id long, child_id long, weight long")
    labels = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "label_id long, threshold long")
    scores = spark.createDataFrame([(7, 3, 100), (8, 3, 99)], "page_id long, label_id long, score long")
    verdicts = spark.createDataFrame([(9, 2, 3, False), (9, 2, 1, True), (9, 3, 3, True), (8, 3, 1, True)], "page_id long, label_id long, level int, result boolean")
    held = L.overrides(verdicts, edges)
    assert {(r["page_id"], r["label_id"]): r["result"] for r in held.collect()} == {(9, 2): False, (9, 3): False, (8, 3): True}
    true = L.roll_up(scores, edges, labels, held)
    assert {tuple(r) for r in true.collect()} == {(7, 3), (7, 2), (7, 1), (8, 3), (8, 2), (8, 1)}
    stored = spark.createDataFrame([(7, 1), (9, 1)], "page_id long, label_id long")
    gone = {tuple(r) for r in L.delta(true, stored).where("change = 'delete'").collect()}
    assert gone == {("delete", 9, 1)}


def test_closure_ends_on_a_cycle_and_rank_refuses_it(spark):
    ready(spark)
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "p long, c long")
    assert joins.closure(ring, "p", "c").count() == 9
    with pytest.raises(ValueError):
        joins.longest_path_rank(ring, "p", "c")
    r = {x["node"]: x["rank"] for x in joins.longest_path_rank(spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "p long, c long"), "p", "c").collect()}
    assert r == {0: 0, 1: 1, 2: 2}


def test_last_detection(spark):
    active = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 9)], "page_id long, video_id long")
    videos = spark.createDataFrame([(1, 10), (2, None), (3, 5)], "video_id long, last_detection long")
    assert {tuple(r) for r in L.last_detection(active, videos).collect()} == {(1, None), (2, 5), (3, None)}


def test_votes(spark):
    rows = spark.createDataFrame([("a", w, w < 3) for w in range(4)] + [("b", w, w < 2) for w in range(4)] + [("c", w, w < 1) for w in range(4)], "hit string, worker int, answer boolean")
    assert {r["hit"]: r["result"] for r in qa.votes(rows, ["hit"], "answer", 3).collect()} == {"a": True, "b": None, "c": False}
    three = spark.createDataFrame([("x", 1, True), ("x", 2, True), ("x", 3, False), ("y", 1, True), ("y", 2, False), ("z", 1, True), ("z", 2, True)], "hit string, worker int, answer boolean")
    assert [tuple(r) for r in qa.minority(three, ["hit"], "worker", "answer").collect()] == [("x", 3)]
    item = spark.createDataFrame([(1, [1, 2, 3], [2], 10)], "hit int, items array<int>, clicked array<int>, seconds int")
    assert sorted((r["item"], r["answer"], r["seconds"]) for r in qa.explode_items(item, "items", "clicked", "seconds").collect()) == [(1, False, 4), (2, True, 4), (3, False, 4)]


def test_scalars(spark):
    assert [one(spark, S.length_label(F.lit(s))) for s in (239, 240, 1199, 1200)] == ["Short", "Medium", "Medium", "Long"]
    assert one(spark, S.percent(F.lit(3), F.lit(1))) == 75.0 and one(spark, S.percent(F.lit(0), F.lit(0))) == 0.0
    assert [one(spark, qa.inventory_change(F.lit(n), F.lit(10), 5)[0]) for n in (51, 50, 1)] == ["increase", None, "decrease"]
    assert [one(spark, sampling.quota(F.lit(10), F.lit(s), F.lit(5))) for s in (8, 12)] == [2, 0]
    assert one(spark, S.int_list(F.lit("1|5||9"))) == [1, 5, 9] and one(spark, S.split_id(F.lit("a_b_7"))[0]) == "a_b"
    assert one(spark, S.condensed_index(F.lit(1), F.lit(3), F.lit(4))) == 4
    assert one(spark, F.size(S.grid_boxes(F.lit(30), F.lit(20), 10, 10))) == 6


def test_text(spark):
    assert one(spark, X.url_ngrams(F.lit("http://abcde?x=1"))) == ["abcd", "bcde", "abcde"]
    assert one(spark, X.url_ngrams(F.lit("abc"))) == []
    assert one(spark, X.truncated(F.lit("abcdef"), 3)) == "abcde" and one(spark, X.truncated(F.lit("abc d"), 3)) == "abc"
    assert one(spark, X.tokens(F.lit("It's A_b, ok! --"))) == ["its", "ab", "ok"]
    assert one(spark, X.without_control(F.lit("a​b\x07"))) == "ab"
    words, entities = F.array(*[F.lit(x) for x in "a b c".split()]), F.array(F.lit("a b c"), F.lit("b"))
    assert one(spark, X.entity_spans(words, entities)) == ["a b c"]
    assert one(spark, X.to_ascii(F.lit("Fußgänger – été"))) == "Fussganger - ete"


def test_stems():
    pairs = {"running": "run", "flies": "fli", "ties": "tie", "happily": "happili", "relational": "relat", "conditional": "condit", "hopping": "hop", "hoping": "hope", "generously": "generous", "national": "nation", "skies": "sky", "controlling": "control", "agreed": "agre", "cries": "cri", "consistency": "consist", "adjustment": "adjust", "rate": "rate", "the": "the", "by": "by"}
    assert {w: X.english_stem(w) for w in pairs} == pairs


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "e", 2)], "k long, v string, seq int")
    assert {tuple(r) for r in merges.upsert(old, new, ["k"], "seq").collect()} == {(1, "a"), (2, "c"), (3, "e")}
    assert {tuple(r) for r in merges.insert_ignore(old, new.drop("seq"), ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert merges.delete_where(spark.createDataFrame([(1,), (None,)], "k long"), F.col("k") == 1).count() == 1


def test_swap(spark, tmp_path):
    a, b = str(tmp_path / "t"), str(tmp_path / "fresh")
    spark.range(3).write.parquet(a)
    spark.range(5).write.parquet(b)
    merges.swap(spark, a, b)
    assert spark.read.parquet(a).count() == 5 and spark.read.parquet(a + ".old").count() == 3


def test_files(spark, tmp_path):
    assert files.statements("SELECT ';' AS a; -- x; y\nSELECT \"b;c\";;") == ["SELECT ';' AS a", 'SELECT "b;c"']
    (tmp_path / "f.tsv").write_text("2\tz\n3\tc\n3\td\n")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert {tuple(r) for r in files.bulk_load(old, str(tmp_path / "f.tsv"), ["k"], "replace").collect()} == {(1, "a"), (2, "z"), (3, "d")}
    assert {tuple(r) for r in files.bulk_load(old, str(tmp_path / "f.tsv"), ["k"], "ignore").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    lines = spark.createDataFrame([("VDR\t1\t2",), ("TBR\t3\thi",)], "value string")
    assert files.demux(lines)["TBR"].collect()[0].asDict() == {"box_id": 3, "text": "hi"}
    with pytest.raises(PySparkException):
        files.log_fields(spark.createDataFrame([("QQQ\t1",)], "value string")).collect()
    ids, store = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "t")], "k long, text string")
    assert {tuple(r) for r in files.text_of(ids, store, "k", "text").collect()} == {(1, "t"), (2, "")}
    with pytest.raises(PySparkException):
        files.text_of(ids, store, "k", "text", silent=False).collect()


def test_array_models():
    boxes = np.array([[0, 0, 10, 10], [0, 0, 10, 10], [20, 20, 5, 5]])
    assert ml.box_nms(boxes) == [0, 2]
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1], [50, 50]])
    assert ml.cut(ml.linkage(x, "single"), 5, 2).tolist() == [0, 0, 1, 1, 2]
    src = np.random.default_rng(0).random((12, 2)) * 10
    m = np.array([[2.0, 0.5], [-0.5, 1.0], [3.0, -2.0]])
    dst = np.c_[src, np.ones(12)] @ m
    dst[:3] += 40
    got, near = ml.ransac(src, dst, 0.1)
    assert near.sum() == 9 and np.allclose(got, m)
    assert np.allclose(ml.affine_fit(src[3:7], dst[3:7])[0], m)
    y = np.repeat([0, 1], 50)
    pts = np.random.default_rng(1).standard_normal((100, 3)) + np.c_[y * 6, y * 0, y * 0]
    p = pts @ ml.discriminant(pts, y, 1)
    assert abs(p[y == 0].mean() - p[y == 1].mean()) > 4


def test_streams(spark, tmp_path):
    from labelloom.streaming import flows

    lines = spark.createDataFrame([("VDR\t1\t2",), ("VDR\t1\t3",), ("TDR\t4\t5",)], "value string")
    lines.write.parquet(str(tmp_path / "in"))
    source = flows.read(spark, str(tmp_path / "in"), lines.schema)
    for _ in range(2):  # a second run has nothing left to read
        assert flows.drained(flows.flush_log(source, str(tmp_path / "out"), str(tmp_path / "check")))
        assert spark.read.parquet(str(tmp_path / "out" / "VDR")).count() == 2
    hits = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "hit long, at string").withColumn("at", F.col("at").cast("timestamp"))
    hits.write.parquet(str(tmp_path / "hits"))
    seen: list[int] = []
    flows.drained(flows.once_each(flows.read(spark, str(tmp_path / "hits"), hits.schema), "hit", "at", "1 hour", lambda b: seen.extend(r["hit"] for r in b.collect()), str(tmp_path / "check2")))
    assert sorted(seen) == [1, 2]


def test_nearest_in_blocks(spark, monkeypatch):
    from labelloom.operators import vectors as V

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id long, v array<double>")
    want = {tuple(r) for r in V.nearest(rows.where("id % 3 = 0"), rows, "id", "v", 4).collect()}
    monkeypatch.setattr(V, "SENT_QUERIES", 6)
    assert {tuple(r) for r in V.nearest(rows.where("id % 3 = 0"), rows, "id", "v", 4).collect()} == want and len(want) == 80


def test_numbered(spark):
    from labelloom.operators.ordering import numbered

    rows = spark.createDataFrame([(f"k{i:03}",) for i in range(100)][::-1], "k string")
    assert {r["k"]: r["n"] for r in numbered(rows, ["k"], "n").collect()} == {f"k{i:03}": i + 1 for i in range(100)}


def test_phrases_with_and_without_the_join(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b c a b".split()), (2, ["b"]), (3, [])], "id long, t array<string>")
    keys = spark.createDataFrame([("a b",), ("b",), ("b c a",), ("c c",), ("x",)], "p string")
    want = {(1, "a b"), (1, "b"), (1, "b c a"), (2, "b")}
    for few in (100, 0):
        monkeypatch.setattr(joins, "FEW_PHRASES", few)
        got = [(r["id"], r["p"]) for r in joins.phrase_join(rows, "t", keys, "p", 3).collect()]
        assert set(got) == want and len(got) == len(want)


def test_large_graphs_as_small_ones(spark, monkeypatch):
    """The ways for large label graphs give what the ways for small ones do, verdicts included."""
    import random

    from labelloom.checkpoints import ready
    from labelloom.operators import joins
    from labelloom.operators import labels as L

    ready(spark)
    rng = random.Random(2)
    edges = spark.createDataFrame([(p, c, rng.randint(20, 60)) for c in range(1, 12) for p in rng.sample(range(c), min(c, 2))], "parent_id long, child_id long, weight long")
    labels = spark.createDataFrame([(k, rng.randint(20, 110)) for k in range(12)], "label_id long, threshold long")
    scores = spark.createDataFrame([(p, rng.randrange(14), rng.randint(-20, 90)) for p in range(60) for _ in range(5)], "page_id long, label_id long, score long")
    verdicts = spark.createDataFrame([(p, k, rng.random() < 0.5) for p in range(0, 70, 3) for k in rng.sample(range(14), 3)], "page_id long, label_id long, result boolean")

    def found():
        true = L.roll_up(scores, edges, labels, verdicts)
        tables = (true, joins.closure(edges, "parent_id", "child_id"), joins.longest_path_rank(edges, "parent_id", "child_id"))
        return [sorted(map(tuple, t.collect())) for t in tables]

    small = found()
    monkeypatch.setattr(L, "SMALL_LABELS", 1)
    monkeypatch.setattr(joins, "SMALL_GRAPH", 1)
    assert small == found() and len(small[0]) > 50


def test_copied_groups_of_boxes_go_through_whole(spark, sf_dir):
    """Boxes of an image that lie in several batches are still one group."""
    import numpy as np

    from labelloom import ml
    from labelloom.queries import QUERIES

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    once = sorted(map(tuple, QUERIES["suppressed_boxes"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert once == sorted(map(tuple, QUERIES["suppressed_boxes"](spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by_image: dict = {}
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for r in lines.selectExpr("l_orderkey i", "xxhash64(l_partkey, l_suppkey, l_linenumber, l_quantity) b", "l_partkey p", "l_suppkey s", "l_linenumber n", "l_extendedprice e").collect():
        by_image.setdefault(r["i"], []).append((-r["e"], r["b"], (r["p"] % 40, r["s"] % 40, r["n"] * 4 + 5, r["n"] * 3 + 5)))
    slow = []
    for image, boxes in by_image.items():
        boxes.sort()
        slow += [(image, boxes[k][1]) for k in ml.box_nms(np.array([x[2] for x in boxes]))]
    assert once == sorted(slow)
