import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labelloom.llm import token_store as S

PATH = P.path("word_bpe_49k.json")
CONTENT = open(PATH, encoding="utf-8").read()
ENCODER = S.WordEncoder(CONTENT, 2, S.words_expression(CONTENT))
THEIRS = Tokenizer.from_str(CONTENT)
PIECES = ["a", "The", "é", "É", "İ", "Σ", "ß", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "'s", "'S", "!!", "<", "<|startoftext|>", "<|ENDOFTEXT|>", "你好", "😀", "é", "Å", "ǅ", "ſ", "-", "_", ".", ",", "word,"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join) | st.text(max_size=40), max_size=6))
def test_as_the_library(texts):
    for text, packed in zip(texts, ENCODER.encode(texts), strict=True):
        assert np.frombuffer(packed, ENCODER.kind).tolist() == [*THEIRS.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 20_000), st.integers(0, 2**32 - 1))
def test_cuts(n, seed):
    ids = np.random.default_rng(seed).integers(0, 49_000, n)
    ends = S.cuts(ids)
    assert (ends[-1] if ends else 0) == n and ends == sorted(set(ends))
    sizes = np.diff([0, *ends])
    assert all(s <= S.MOST for s in sizes) and all(s >= S.LEAST for s in sizes[:-1])
    if n > 9000:  # a passage is cut alike wherever it stands
        moved = S.cuts(np.r_[np.arange(777), ids])
        assert len({e + 777 for e in ends} & set(moved)) >= len(ends) // 2


@given(st.lists(st.binary(max_size=50), max_size=6))
def test_joined_crc(parts):
    crc, whole = 0, b"".join(parts)
    for p in parts:
        crc = S.crc32_joined(crc, zlib.crc32(p), len(p))
    assert crc == zlib.crc32(whole)


@given(st.lists(st.lists(st.binary(max_size=300), min_size=1, max_size=6), max_size=5))
def test_crc_of_parts(rows):
    for r in rows:
        sizes = np.array([len(p) for p in r], np.int64)
        after = sizes.sum() - np.cumsum(sizes)
        got = S.crc32_before(np.array([zlib.crc32(p) for p in r], np.int64), after)
        assert int(np.bitwise_xor.reduce(got)) == zlib.crc32(b"".join(r))


def test_cuts_of_many_are_those_of_each():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 49_000, n) for n in (0, 1, 70, 5000, 0, 300, 9000)]
    bounds = np.cumsum([0, *map(len, streams)]).tolist()
    assert S.cuts_of_many(np.concatenate(streams), bounds) == [S.cuts(s) for s in streams]


def test_merkle_root_notices_changes():
    leaves = [bytes([k]) * 16 for k in range(5)]
    assert S.merkle_root(leaves) != S.merkle_root(leaves[::-1])
    assert len({S.merkle_root(leaves[:k]) for k in range(6)}) == 6


def test_store(spark, docs, empty):
    store = S.write_store(docs, PATH, 2)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = sorted(S.verified(spark, store).collect(), key=lambda r: r["start"])
    whole = sorted(S.read_documents(spark, store).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows] and all(r["intact"] for r in got)
    want: dict = {}
    for r in rows:
        ids = np.array([*THEIRS.encode(r["text"] or "", add_special_tokens=False).ids, 2])
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    start = 0
    for g, w in zip(got, whole, strict=True):
        assert g["start"] == start == w["start"] and (g["n_tokens"], g["ids_crc32"]) in want[g["doc_id"]]
        assert zlib.crc32(np.frombuffer(w["ids"], "<u2").astype("<u4").tobytes()) == g["ids_crc32"]
        start += g["n_tokens"]
    chunks = store.read(spark, "chunks")
    assert chunks.count() == chunks.select("hash").distinct().count() == store.read(spark, "manifest").selectExpr("explode(hashes) h").distinct().count()
    in_files = [r[0] for r in store.read(spark, "manifest").coalesce(1).select("doc_id").collect()]
    assert sorted(in_files, key=lambda x: (x is not None, x or 0)) == [r["doc_id"] for r in rows]
    assert S.verified(spark, S.write_store(empty, PATH, 2)).count() == 0


def test_damage_is_found(spark, docs):
    store = S.write_store(docs, PATH, 2)
    bad = S.Store(store.path + "-bad", store.width)
    from pyspark.sql import functions as F

    store.read(spark, "chunks").withColumn("ids", F.expr("if(octet_length(ids) > 1000, concat(ids, ids), ids)")).write.parquet(f"{bad.path}/chunks")
    store.read(spark, "manifest").write.parquet(f"{bad.path}/manifest")
    assert 0 < S.verified(spark, bad).where("NOT intact").count() < docs.count()
