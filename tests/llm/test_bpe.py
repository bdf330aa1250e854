import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
CODEC = bpe.Codec(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300) | st.text(alphabet="ab é\n\x1c\x85'sl1²_-", max_size=400) | st.integers(1, 3000).map(lambda n: "a" * n))
def test_as_tiktoken(text):
    packed = CODEC.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == THEIRS.encode_ordinary(text)
    assert CODEC.decode(packed) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400), st.integers(2, 40))
def test_tree_agrees_with_direct_merging(piece, leaf):
    tree = bpe.TreeEncoder(RANKS, leaf)
    assert tree.tree(piece) == tree._queued(piece)
    if len(piece) < 60:
        assert tree._scanned(piece) == tree._queued(piece)


def test_columns(docs, empty):
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert back.columns.count("ids") == 1 and "fp" in back.columns
    for r in back.select("text", "ids", bpe.n_ids(back["ids"]).alias("n"), bpe.unpack(back["ids"]).alias("list"), "decoded").collect():
        want = THEIRS.encode_ordinary(r["text"] or "")
        assert r["list"] == want and r["n"] == len(want)
        assert hashlib.sha256(r["decoded"]).digest() == hashlib.sha256((r["text"] or "").encode()).digest()
    assert bpe.encode(empty, PATH, P.PATTERN).count() == 0


def test_pattern_refuses_what_it_cannot_spell_out():
    with pytest.raises(ValueError):
        bpe.plain_pattern(r"[\S]")
