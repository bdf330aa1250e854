import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import simhash as S


def slow_fingerprint(text: str, n: int) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\t\x1c\n", max_size=80))
def test_fingerprint(text):
    assert S.fingerprint(text, 4) == slow_fingerprint(text, 4)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 300), st.integers(0, 8), st.integers(1, 6), st.sampled_from([1, 4]))
def test_comparison_by_brute_force(seed, n, flips, buckets, radius):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, n)]
    for _ in range(flips):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    fp = np.unique(fp)
    bucket = rng.integers(0, buckets, len(fp))
    a, b = S.joining_links(bucket, fp, radius)
    near = [(i, j) for i in range(len(fp)) for j in range(i) if bucket[i] == bucket[j] and bin(int(fp[i] ^ fp[j])).count("1") <= radius]
    assert roots(len(fp), zip(a.tolist(), b.tolist(), strict=True)) == roots(len(fp), near)
    assert len(a) < max(1, len(fp))


def test_wide_comparison():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (3, 8), dtype=np.uint64)
    fp = np.repeat(base, 20, axis=0)
    for i in range(len(fp)):
        for bit in rng.choice(512, int(rng.integers(0, 60)), replace=False):
            fp[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    a, b = S.joining_links(np.zeros(len(fp), int), fp, 60)
    near = [(i, j) for i in range(len(fp)) for j in range(i) if sum(bin(int(x)).count("1") for x in fp[i] ^ fp[j]) <= 60]
    assert roots(len(fp), zip(a.tolist(), b.tolist(), strict=True)) == roots(len(fp), near)


@pytest.mark.parametrize("at_once,split_above", [(200_000, 100_000), (40, 15)])
def test_links_with_hot_buckets(spark, at_once, split_above):
    rng = np.random.default_rng(1)
    one = lambda n: np.uint64(1) << rng.integers(0, 30, n).astype(np.uint64)
    fp = np.unique(np.concatenate([np.uint64(12345) ^ one(150) ^ one(150) ^ one(150), rng.integers(0, 2**63, 150, dtype=np.uint64)])).view(np.int64)
    rows = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    place = {int(x): k for k, x in enumerate(fp)}
    got = [(place[r["a"]], place[r["b"]]) for r in S.links_within(rows, "fp", 4, at_once, split_above).collect()]
    near = [(i, j) for i in range(len(fp)) for j in range(i) if bin(int(fp[i] ^ fp[j]) & (1 << 64) - 1).count("1") <= 4]
    assert roots(len(fp), got) == roots(len(fp), near)


def test_components(spark, sf_dir, docs, empty):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in S.components(rows).collect()}
    texts = sorted((r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect())
    fp = [slow_fingerprint(t, 4) for _, t in texts]
    near = [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 4]
    want = roots(len(fp), near)
    for k, (i, _) in enumerate(texts):
        assert got[i] == (fp[k] - (1 << 64) * (fp[k] >> 63), texts[want[k]][0])
    odd = S.components(docs).collect()
    assert len(odd) == docs.count() and {r["component_id"] for r in odd if r["doc_id"] in (0, 1, 2)} == {0}
    assert S.components(empty).count() == 0 and S.near_components(empty).count() == 0


def similar_rows(groups: int) -> list[tuple[int, str]]:
    """Groups of texts of 200 words with 1 to 9 substituted words each: similarities from 0.5 to 1."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for c in range(6):
            copy = list(base)
            for p in rng.choice(200, 2 * c, replace=False):
                copy[p] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("split_above", [30_000, 4])
def test_near_components_by_brute_force(spark, split_above):
    """No link below the similarity of 0.8; of the pairs from 0.8 on, at least 0.95 are found (here those of 0.8 to 0.85 alone)."""
    rows = similar_rows(60)
    sets = {i: S.shingle_set(t, 5) for i, t in rows}
    near = [(i, j, s) for i in sets for j in range(i - i % 6, i) if (s := S.jaccard(sets[i], sets[j])) >= 0.8]
    want = roots(len(rows), [(i, j) for i, j, _ in near])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["_id"]: r["least"]["_id"] for r in S.near_components(table, split_above=split_above, sets_split_above=split_above).collect()}
    assert all(want[i] == want[g] for i, g in got.items())
    close = [(i, j) for i, j, s in near if s < 0.85]
    assert len(close) > 30 and sum(got[i] == got[j] for i, j in close) >= 0.95 * len(close)
    assert sum(got[i] == got[j] for i, j, _ in near) >= 0.99 * len(near)


def test_different_texts_of_one_id_both_stay(spark):
    rows = [(1, "one two three four five six", "a"), (1, "something else altogether it is here", "b"), (1, "one two three four five six", "c"), (2, "one two three four five six", "d"), (None, "one two three four five six", "e")]
    kept = S.representatives(spark.createDataFrame(rows, "doc_id long, text string, _sha string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:3]) for r in kept) == [(0, "one"), (1, "one"), (1, "som")] and len(kept[0]) == 3


def test_similar_in_whole_buckets(monkeypatch):
    """Rows of a bucket say what the comparison of two sets says, empty sets included."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: rng.integers(0, 61)], rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)]) for _ in range(40)] + [base[:0], base[:0]]
    sets += [np.unique(np.r_[np.delete(base, k), base[:1]]) for k in range(20)]
    bucket = np.repeat([3, 1, 2], [22, 20, 20])
    monkeypatch.setattr(S, "GATHERED", 100)
    for asked in (0, 3):
        monkeypatch.setattr(S, "ASKED", asked)
        similar = S.Similar(bucket, sets, 0.8)
        pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if bucket[i] == bucket[j]]
        got = [similar(i, j) for i, j in pairs]
        assert got == [S.jaccard(sets[i], sets[j]) >= 0.8 for i, j in pairs] and 0 < sum(got) < len(got)
        assert similar.rows


def test_bands():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert S.bands_of(a).tolist() == S.bands_of(a.copy()).tolist() and len(set(S.bands_of(a).tolist())) == S.BANDS
    assert not set(S.bands_of(a).tolist()) & set(S.bands_of(a[:10] + np.uint64(5)).tolist())
    assert S.jaccard(np.arange(8), np.arange(10)) == 0.8 and S.jaccard(a[:0], a[:0]) == 1 and S.jaccard(a[:0], a[:3]) == 0
