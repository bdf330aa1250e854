import numpy as np

from labelloom.llm import decontaminate as D


def brute(docs, items):
    """Pairs whose token lists share a run of at least the wanted matches."""
    out = set()
    for i, t in docs:
        line = " " + " ".join(D.tokens_of(t or "")) + " "
        out |= {(i, k) for k, x in items if D.tokens_of(x or "") and " " + " ".join(D.tokens_of(x)) + " " in line}
    return out


def test_whole_items_by_brute_force(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(docs, bench).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert want <= got and len(got - want) <= 1 + len(want) // 5
    again = {(r["doc_id"], r["item_id"]) for r in D.overlaps(docs, bench, max_windows=500).collect()}
    assert again == got
    kept = {r["doc_id"] for r in D.clean(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {i for i, _ in got}
    assert kept == {r["doc_id"] for r in D.clean(docs, bench, max_windows=500).collect()}


def test_substitutions():
    rng, hashes = np.random.default_rng(0), D._Hashes()
    items = [(k, [f"t{x}" for x in rng.integers(0, 4000, 40)]) for k in range(50)]
    index = D.Index([(k, hashes.of(w)) for k, w in items])
    found = clean = 0
    for k, w in items:
        changed = [f"z{rng.integers(0, 10**9)}" if rng.random() < 0.1 else x for x in w]
        around = [f"t{x}" for x in rng.integers(0, 4000, 200)]
        found += k in index.overlaps(hashes.of(around[:90] + changed + around[90:]))
        clean += not index.overlaps(hashes.of(around))
    assert found >= 47 and clean == 50


def test_substitutions_at_the_limit():
    """A fifth of the tokens substituted, which is the identity of 0.8: at least 0.9 found at every length."""
    rng, hashes = np.random.default_rng(2), D._Hashes()
    for n in (20, 30, 40, 100):
        items = [(k, [f"t{x}" for x in rng.integers(0, 4000, n)]) for k in range(100)]
        index = D.Index([(k, hashes.of(w)) for k, w in items])
        texts = []
        for _, w in items:
            changed = list(w)
            for p in rng.choice(n, n // 5, replace=False):
                changed[p] = f"z{rng.integers(0, 10**9)}"
            texts.append(hashes.of([f"t{x}" for x in rng.integers(0, 4000, 90)] + changed + ["t1", "t2"]))
        assert sum(k in found for k, found in enumerate(index.overlaps_of_many(texts))) >= 90


def test_best_stretch_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        same = rng.random(int(rng.integers(1, 40))) < 0.8
        middle = int(rng.integers(0, len(same)))
        same[middle] = True
        every = [(int(same[a:b].sum()), -b, -a) for a in range(middle + 1) for b in range(middle + 1, len(same) + 1) if same[a:b].mean() >= 0.8 - 1e-12]
        most, b, a = max(every)
        assert D.best_stretch(same, middle) == (-a, -b, most)


def test_many_texts_are_as_each_and_repeats_are_bounded():
    hashes = D._Hashes()
    index = D.Index([(0, hashes.of(["a"] * 1000)), (1, hashes.of(["a"] * 700 + ["b"] * 300)), (2, hashes.of("one two three".split()))])
    texts = [hashes.of(["a"] * 4000), hashes.of([]), hashes.of("x one two three y".split()), hashes.of(["b"] * 20 + ["a"] * 5)]
    import time

    began = time.time()
    got = index.overlaps_of_many(texts)
    assert time.time() - began < 20 and got == [index.overlaps(t) for t in texts]
    assert got[0][0][2:] == (1000, 1000) and got[0][1][3] >= 700 and got[1] == {} and got[2] == {2: (1, 0, 3, 3)} and 1 in got[3]


def test_short_items_and_odd_rows(spark, docs, empty):
    bench = spark.createDataFrame([(0, "quick brown"), (1, None), (2, ""), (3, "not in there at all"), (3, "word word word")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(docs, bench).collect()}
    assert got == {(4, 0), (9, 0), (6, 3)}
    assert D.overlaps(empty, bench).count() == 0 and D.overlaps(docs, bench.where("false")).count() == 0
    assert D.clean(docs, bench).columns == docs.columns
