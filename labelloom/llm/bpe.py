"""Byte-level BPE by monoid tree reduction.

A text falls into the matches of a pattern, which never merge with each other, so its ids are the
matches' ids one after the other. Within a match the bytes are halved recursively; short leaves are
merged by rank; neighbours are joined by re-encoding a window of tokens on both sides of the seam,
which grows until the tokens outside provably keep: a row of tokens is what merging by rank gives if
and only if each two adjacent tokens are what merging their joint bytes gives. So the window may stop
as soon as its outermost tokens stand up to that test with their neighbours outside.

Ids travel packed, as little-endian unsigned 32-bit integers in a binary column (`unpack` turns them
into an array column).

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; texts
of any length are encoded whole; repeated rows are encoded apart and alike; an empty table gives an
empty table; an input column named as an output column is replaced, all others pass through.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import add_columns, texts_of

#: Bytes of a leaf, which is merged directly.
LEAF = 24
#: Bytes of matches and their ids remembered in a task, each with its share of the table; beyond, the memory
#: starts anew. Longer matches than LONGEST bytes are not remembered.
REMEMBERED, ENTRY, LONGEST = 48 << 20, 200, 64
#: Token pairs remembered in a task.
REMEMBERED_PAIRS = 100_000
_NONE = 1 << 40
#: Below this code point a text is matched by the standard library's faster expressions.
PLAIN = 0x250
#: Ids of a leaf of the decoding tree.
DECODE_LEAF = 4096


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


class TreeEncoder:
    """Encodes bytes by rank, as a tree reduction."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, max(2, leaf)
        self.tokens: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([x])] for x in range(256)]
        self._pairs: dict[tuple[int, int], bool] = {}

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one match: its own id if the vocabulary holds it, else what the tree gives."""
        if not piece:
            return []
        own = self.ranks.get(piece)
        return [own] if own is not None else self.tree(piece)

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.merged(piece)
        half = len(piece) // 2
        return self.joined(self.tree(piece[:half]), self.tree(piece[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        n_left = n_right = 1
        while True:
            lo, hi = max(0, len(left) - n_left), min(len(right), n_right)
            seam = self.merged(b"".join(map(self.tokens.__getitem__, left[lo:] + right[:hi])))
            fits_left = lo == 0 or self.keeps(left[lo - 1], seam[0])
            fits_right = hi == len(right) or self.keeps(seam[-1], right[hi])
            if fits_left and fits_right:
                return left[:lo] + seam + right[hi:]
            n_left, n_right = n_left * (1 if fits_left else 2), n_right * (1 if fits_right else 2)

    def keeps(self, a: int, b: int) -> bool:
        """Whether merging the joint bytes of two tokens gives these two again."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > REMEMBERED_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def merged(self, piece: bytes) -> list[int]:
        """Merging by rank, the leftmost of equals first."""
        return self._scanned(piece) if len(piece) <= 2 * self.leaf else self._queued(piece)

    def _scanned(self, piece: bytes) -> list[int]:
        """By looking for the least rank again and again: the faster way for few bytes."""
        rank = self.ranks.get
        ids = [self.single[x] for x in piece]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) != _NONE:
            i = pairs.index(least)
            joint = parts[i] = parts[i] + parts[i + 1]
            ids[i] = least
            del parts[i + 1], ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + joint, _NONE)
            if i < len(pairs):
                pairs[i] = rank(joint + parts[i + 1], _NONE)
        return ids

    def _queued(self, piece: bytes) -> list[int]:
        """With a heap over linked parts."""
        n, ranks = len(piece), self.ranks
        if n < 2:
            return [ranks[piece]] if n else []
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:  # one of the two parts has changed since
                continue
            end[i], end[j] = stop, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks.get(piece[i : end[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0:
                r = ranks.get(piece[h:stop])
                if r is not None:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out


class _Memory(dict):
    """Match -> packed ids."""

    def __init__(self, encoder: TreeEncoder):
        self.encoder, self.held = encoder, 0

    def __missing__(self, match: str) -> bytes:
        raw = match.encode()
        packed = np.asarray(self.encoder.encode(raw), "<u4").tobytes()
        if len(raw) <= LONGEST:
            self[match] = packed
            self.held += ENTRY + len(raw) + len(packed)
        return packed

    def trim(self) -> None:
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0


def plain_pattern(pattern: str) -> str:
    """The pattern with its Unicode classes spelled out for the characters below PLAIN."""

    def ranges(keep) -> str:
        chars = [c for c in map(chr, range(PLAIN)) if keep(c)]
        return "".join("\\" + c if c in "\\]^-[" else c for c in chars)

    blank = ranges(lambda c: c in _BLANKS)
    kinds = {"\\p{L}": ranges(lambda c: unicodedata.category(c)[0] == "L"), "\\p{N}": ranges(lambda c: unicodedata.category(c)[0] == "N"), "\\s": blank}
    out, i, inside = [], 0, False
    while i < len(pattern):
        kind = next((k for k in kinds if pattern.startswith(k, i)), None)
        if kind:
            out.append(kinds[kind] if inside else f"[{kinds[kind]}]")
        elif pattern.startswith("\\S", i):
            if inside:
                raise ValueError("\\\\S within a class")
            kind = "\\S"
            out.append(f"[^{blank}]")
        else:
            kind = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
            inside = kind == "[" or inside and kind != "]"
            out.append(kind)
        i += len(kind)
    return "".join(out)


#: Unicode's White_Space below PLAIN.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0"


class Decoder:
    """Packed ids back to bytes, concatenated up the tree."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: b for b, i in ranks.items()}

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return self._concatenated(ids)

    def _concatenated(self, ids: array) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self._concatenated(ids[:half]) + self._concatenated(ids[half:])


class Codec(Decoder):
    """Whole texts to packed ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")).findall
        self.find_plain = re.compile(plain_pattern(pattern)).findall
        self.plain = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]").search
        self.encoder = TreeEncoder(ranks)
        self.tokens = self.encoder.tokens
        self.memory = _Memory(self.encoder)

    def encode(self, text: str) -> bytes:
        self.memory.trim()
        find = self.find if self.plain(text) else self.find_plain
        return b"".join(map(self.memory.__getitem__, find(text)))


def _shipped(df: DataFrame, path: str):
    """The vocabulary file's content, sent to each executor once; its size does not depend on the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the packed ids of each whole text; and, if `decoded` names a column, the bytes that these ids
    decode to, by the same worker, so that there is one vocabulary in memory."""
    content = _shipped(df, ranks_path)
    added = [T.StructField(c, T.BinaryType()) for c in (out, decoded) if c]

    def start():
        codec = Codec(read_ranks(content.value), pattern)

        def one(batch: pa.RecordBatch) -> list[pa.Array]:
            packed = [codec.encode(x) for x in texts_of(batch, text)]
            return [pa.array(x, pa.binary()) for x in ([packed, map(codec.decode, packed)] if decoded else [packed])]

        return one

    return add_columns(df, added, start)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for; null ids count as none."""
    content = _shipped(df, ranks_path)

    def start():
        decoder = Decoder(read_ranks(content.value))
        return lambda batch: [pa.array([decoder.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.binary())]

    return add_columns(df, [T.StructField(out, T.BinaryType())], start)


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def unpack(packed: Column) -> Column:
    """Packed ids as an array column."""
    one = lambda i: F.conv(
        F.concat(*[F.hex(F.substr(packed, (i * 4 + k).cast("int"), F.lit(1))) for k in (4, 3, 2, 1)]), 16, 10
    ).cast("long")
    return F.when(F.octet_length(packed) > 0, F.transform(F.sequence(F.lit(0), (F.octet_length(packed) / 4 - 1).cast("int")), one)).otherwise(F.array().cast("array<bigint>"))
