import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import media


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.sampled_from(["none", "sub", "up", "least"]), st.integers(0, 2**32 - 1))
def test_round_trip(rows, width, depth, way, seed):
    samples = np.random.default_rng(seed).integers(0, 256, (rows, width, depth), dtype=np.uint8)
    assert np.array_equal(media.decode_png(media.encode_png(samples, way)), samples)


def test_average_and_paeth_rows():
    rng = np.random.default_rng(1)
    rows, width, depth = 5, 7, 3
    plain = rng.integers(0, 256, (rows, width * depth), dtype=np.uint8).astype(int)
    lines = np.zeros((rows, 1 + width * depth), np.uint8)
    for r, kind in enumerate((3, 4, 3, 4, 4)):
        lines[r, 0] = kind
        for i in range(width * depth):
            a = plain[r, i - depth] if i >= depth else 0
            b = plain[r - 1, i] if r else 0
            c = plain[r - 1, i - depth] if r and i >= depth else 0
            if kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines[r, 1 + i] = (plain[r, i] - guess) % 256
    assert np.array_equal(media.unfiltered(lines, depth), plain)


def test_damage_is_found():
    png = media.encode_png(np.zeros((2, 64), np.uint8))
    for k in (0, 20, 45, len(png) - 5):
        with pytest.raises(media.PngError):
            media.decode_png(png[:k] + bytes([png[k] ^ 1]) + png[k + 1 :])
    with pytest.raises(media.PngError):
        media.decode_png(png[:-12])


def test_columns(docs, empty):
    back = media.read_png(media.store_png(docs, "text"))
    by: dict = {}
    for r in back.collect():
        data = (r["text"] or "").encode()
        want = data + bytes(-len(data) % 64) if data else bytes(64)
        assert r["payload"] == want and len(r["feature"]) == 8
        assert by.setdefault(data, (r["media"], r["feature"])) == (r["media"], r["feature"])
        assert zlib.crc32(r["payload"][-64:]) == zlib.crc32(want[-64:])
    assert media.read_png(media.store_png(empty, "text")).count() == 0


def test_hash_keeps_under_small_changes():
    x = np.random.default_rng(0).integers(0, 256, (64, 64), dtype=np.uint8)
    x = np.repeat(np.repeat(x[:8, :8], 8, 0), 8, 1)
    y = x.copy()
    y[5, 5] ^= 8
    a, b = (np.unpackbits(np.frombuffer(media.frequency_hash(v), np.uint8)) for v in (x, y))
    assert (a != b).sum() <= 3


def test_query_reads_filtered_lines(spark, sf_dir, monkeypatch):
    """The query's stored scan lines are filtered, and reading them back gives the padded texts."""
    import hashlib

    from labelloom.llm import queries

    held, read = [], media.read_png
    monkeypatch.setattr(media, "read_png", lambda df: held.append(df) or read(df))
    out = {r["doc_id"]: r["payload_sha256"] for r in queries.op10_png_media(spark, sf_dir).collect()}
    kinds = set()
    for r in held[0].limit(20).collect():
        body = zlib.decompress(b"".join(b for k, b in media.chunks_of(r["media"]) if k == b"IDAT"))
        kinds |= set(body[:: media.WIDTH + 1])
    assert kinds - {0}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).collect():
        assert out[r["doc_id"]] == hashlib.sha256(media.padded((r["text"] or "").encode(), media.WIDTH)).hexdigest()
