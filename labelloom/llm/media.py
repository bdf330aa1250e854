"""Media columns: bytes as 8-bit grey PNG images in a binary column, and features of the decoded samples.

The PNG is written and read here: chunks with CRC-32 tests, the scan lines in one zlib stream (whose
Adler-32 zlib tests), and filters undone with numpy. The feature is a hash of the low frequencies of a
two-dimensional cosine transform of the image, scaled to a small square by averaging.

Defined results: a null value counts as empty; an empty value is one row of zeros; values of any length
are stored whole (more rows, never a cut); equal values give equal media and features; an empty table
gives an empty table; an input column named as an output column is replaced, all others pass through.
Bytes that are not a PNG, or whose checksums fail, raise PngError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelloom.llm.common import add_columns

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a row; a payload is padded with zeros to a positive multiple of it.
WIDTH = 64
#: Side of the averaged square and of its low-frequency corner.
SQUARE, CORNER = 32, 8
#: Samples of a pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class PngError(ValueError):
    pass


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    rows = max(1, -(-len(data) // width))
    return data + bytes(rows * width - len(data))


def encode_png(samples: np.ndarray, filtering: str = "none", level: int = 6) -> bytes:
    """An 8-bit image, rows x width (grey) or rows x width x samples, as PNG bytes.

    filtering: `none`, `sub`, `up`, or `least`, which takes for each row the filter (of these three)
    with the least sum of absolute differences.
    """
    rows, width = samples.shape[:2]
    depth = samples.shape[2] if samples.ndim == 3 else 1
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[depth]
    flat = samples.reshape(rows, width * depth)
    ways = {0: flat}
    if filtering in ("sub", "least"):
        left = np.zeros_like(flat)
        left[:, depth:] = flat[:, :-depth]
        ways[1] = flat - left
    if filtering in ("up", "least"):
        above = np.zeros_like(flat)
        above[1:] = flat[:-1]
        ways[2] = flat - above
    if filtering == "least":
        cost = np.stack([np.abs(w.view(np.int8).astype(np.int32)).sum(axis=1) for w in ways.values()])
        kinds = cost.argmin(axis=0).astype(np.uint8)
    else:
        kinds = np.full(rows, {"none": 0, "sub": 1, "up": 2}[filtering], np.uint8)
    lines = np.empty((rows, 1 + width * depth), np.uint8)
    lines[:, 0] = kinds
    for kind, way in ways.items():
        chosen = kinds == kind
        lines[chosen, 1:] = way[chosen]
    head = struct.pack(">IIBBBBB", width, rows, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks_of(png: bytes) -> list[tuple[bytes, bytes]]:
    """The chunks, each tested against its CRC-32."""
    if png[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    found, at = [], 8
    while at + 12 <= len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body, end = png[at + 4 : at + 8], png[at + 8 : at + 8 + n], at + 12 + n
        if end > len(png) or zlib.crc32(kind + body) != struct.unpack_from(">I", png, end - 4)[0]:
            raise PngError(f"chunk {kind!r} is damaged")
        found.append((kind, body))
        at = end
        if kind == b"IEND":
            return found
    raise PngError("no end chunk")


def unfiltered(lines: np.ndarray, depth: int) -> np.ndarray:
    """Samples of filtered scan lines (rows x (1 + width * depth)).

    Runs of rows with one filter are undone together: rows without a filter are copied, `sub` is a
    running sum along the row, `up` a running sum down the rows; `average` and `Paeth` go pixel by pixel.
    """
    kinds, data = lines[:, 0], lines[:, 1:]
    out = np.empty_like(data)
    above = np.zeros(data.shape[1], np.uint8)
    bounds = [0, *(np.flatnonzero(np.diff(kinds.astype(np.int16))) + 1).tolist(), len(kinds)]
    for first, stop in zip(bounds, bounds[1:], strict=False):
        kind, block = int(kinds[first]), data[first:stop]
        if kind == 0:
            out[first:stop] = block
        elif kind == 1:
            pixels = block.reshape(len(block), -1, depth)
            out[first:stop] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(block.shape)
        elif kind == 2:
            out[first:stop] = np.cumsum(block, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for row in range(first, stop):
                out[row] = _by_pixel(data[row], above, depth, kind)
                above = out[row]
        else:
            raise PngError(f"filter {kind}")
        above = out[stop - 1]
    return out


def _by_pixel(line: np.ndarray, above: np.ndarray, depth: int, kind: int) -> np.ndarray:
    raw, up, out = line.tolist(), above.tolist(), [0] * len(line)
    for i, x in enumerate(raw):
        a, b, c = (out[i - depth], up[i], up[i - depth]) if i >= depth else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            near = (abs(p - a), abs(p - b), abs(p - c))
            guess = (a, b, c)[near.index(min(near))]
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without interlacing, rows x width x samples."""
    chunks = chunks_of(png)
    if not chunks or chunks[0][0] != b"IHDR":
        raise PngError("no header chunk")
    width, rows, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[0][1])
    if bits != 8 or interlaced or colour not in SAMPLES:
        raise PngError("only 8-bit images without interlacing")
    depth = SAMPLES[colour]
    try:
        stream = zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(stream) != rows * (1 + width * depth):
        raise PngError("the scan lines are not whole")
    lines = np.frombuffer(stream, np.uint8).reshape(rows, 1 + width * depth)
    return unfiltered(lines, depth).reshape(rows, width, depth)


def _cosines(n: int, kept: int) -> np.ndarray:
    at = (np.arange(n) + 0.5) * np.pi / n
    return np.cos(np.arange(kept)[:, None] * at[None, :])


_LOW = _cosines(SQUARE, CORNER)


def squared(grey: np.ndarray, side: int = SQUARE) -> np.ndarray:
    """Means over a side x side grid; a grid cell finer than a sample takes that sample."""
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    sums[1:, 1:] = grey.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    edges = []
    for n in grey.shape:
        lo = np.arange(side) * n // side
        edges.append((lo, np.maximum(np.arange(1, side + 1) * n // side, lo + 1)))
    (r0, r1), (c0, c1) = edges
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    return (sums[r1][:, c1] - sums[r0][:, c1] - sums[r1][:, c0] + sums[r0][:, c0]) / area


def frequency_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency coefficients are above their median (the constant one left out of it)."""
    grey = samples.astype(np.float64).mean(axis=2) if samples.ndim == 3 and samples.shape[2] > 1 else samples.reshape(samples.shape[:2])
    low = (_LOW @ squared(grey) @ _LOW.T).ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def store_png(df: DataFrame, data: str, out: str = "media", width: int = WIDTH, filtering: str = "none", level: int = 6) -> DataFrame:
    """Adds the PNG form of a string (as UTF-8) or binary column, padded with zeros to whole rows."""

    def start():
        def one(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(data)).cast(pa.binary())
            forms = [encode_png(np.frombuffer(padded(x or b"", width), np.uint8).reshape(-1, width), filtering, level) for x in column.to_pylist()]
            return [pa.array(forms, pa.binary())]

        return one

    return add_columns(df, [T.StructField(out, T.BinaryType())], start)


def read_png(df: DataFrame, media: str = "media", payload: str = "payload", feature: str = "feature") -> DataFrame:
    """Adds the samples of stored PNGs, row by row, and their frequency hash (8 bytes); null media give nulls."""

    def start():
        def one(batch: pa.RecordBatch) -> list[pa.Array]:
            images = [None if x is None else decode_png(x) for x in batch.column(batch.schema.get_field_index(media)).to_pylist()]
            return [
                pa.array([None if x is None else x.tobytes() for x in images], pa.binary()),
                pa.array([None if x is None else frequency_hash(x) for x in images], pa.binary()),
            ]

        return one

    return add_columns(df, [T.StructField(payload, T.BinaryType()), T.StructField(feature, T.BinaryType())], start)
