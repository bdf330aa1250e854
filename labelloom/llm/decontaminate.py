"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over token positions: positions marked 0 are ignored, so two passages that differ
there hash alike. The windows of benchmark items are hashed under each mask; training texts' windows are
hashed alike and joined with them. Around each hit the two texts are aligned without gaps, and of all
stretches that hold the hit's first token and have the identity, the one with most matching tokens is taken;
it counts as an overlap when these are enough. Items shorter than that must match in nearly all their tokens.

Texts are hashed a slice at a time. Hits that follow each other on one alignment are one run, of which only
the first and the last are verified (the run itself matches in between), so a token repeated over and over, in
text and item, costs one verification an alignment, not one a pair of places.

The benchmark's hashes are cut into shards of bounded size (`MAX_WINDOWS`), each sent to the executors and
joined with all texts; for a benchmark below that bound there is one shard. So what is sent does not grow
beyond the bound, and no text is shuffled.

Tokens are runs of word characters in lower case. Defined results: null or empty texts and items have no
tokens and never match; items of fewer tokens than the shortest mask match as a whole run of tokens;
of overlaps with one item that have equally many matches, the first by mask, then by place in the text, is
given; repeated rows and items each give their own results; empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

import re
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from labelloom.llm.common import map_slices, texts_of

#: The masks: of 4,000 alignments of 20 tokens with 4 substitutions, one of the first three hits each.
MASKS = ("1111011", "111010001001", "11011100001", "1100101011")
#: Matching tokens and identity that an overlap must have; the share of a short item's tokens.
LEAST_TOKENS, LEAST_IDENTITY, ITEM_SHARE = 13, 0.8, 0.8
#: Benchmark windows in a shard: 16 bytes each.
MAX_WINDOWS = 2_000_000
#: Pairs of a text's and an item's windows that are looked at together.
PAIRS = 1_000_000
_WORD = re.compile(r"\w+")
_BITS = 22


def tokens_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """Token -> 64-bit hash."""

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        found = self[token] = xxh64_intdigest(token.encode(), 7)
        return found

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def seeded(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window under a mask."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for k, used in enumerate(mask):
        if used == "1":
            out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def best_stretch(same: np.ndarray, middle: int, identity: float = LEAST_IDENTITY) -> tuple[int, int, int]:
    """The stretch [lo, hi) around a place with most matches among those of at least that identity, and its
    matches; of several the one that ends, then begins first. The place must match."""
    matches = np.r_[0, np.cumsum(same)]
    score = matches - identity * np.arange(len(matches)) + 1e-9 * np.arange(len(matches))  # above zero: enough identity, rounding aside
    lowest = np.minimum.accumulate(score[: middle + 1])  # falls; for each end the first begin that is low enough
    begin = np.searchsorted(-lowest, -score[middle + 1 :], side="left")
    found = np.where(begin <= middle, matches[middle + 1 :] - matches[np.minimum(begin, middle)], -1)
    k = int(found.argmax())
    return int(begin[k]), middle + 1 + k, int(found[k])


class Index:
    """A shard of the benchmark: its items' token hashes and their windows under each mask, sorted."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids, self.tokens = [i for i, _ in items], [h for _, h in items]
        shortest = min(map(len, MASKS))
        self.short: dict[int, list[int]] = {}
        for k, h in enumerate(self.tokens):
            if 0 < len(h) < shortest:
                self.short.setdefault(int(h[0]), []).append(k)
        self.firsts = np.array(list(self.short), np.uint64)
        self.begins = np.cumsum([0, *map(len, self.tokens)])
        line = np.concatenate([np.zeros(0, np.uint64), *self.tokens])
        owner = np.repeat(np.arange(len(self.tokens)), np.diff(self.begins))
        self.windows: list[tuple[np.ndarray, np.ndarray]] = []  # for each mask the sorted keys and their places in the line
        self.seen = np.zeros(1 << _BITS, bool)
        self.line, self.owner = line, owner
        for mask in MASKS:
            keys = seeded(line, mask)
            inside = np.flatnonzero(owner[: len(keys)] == owner[len(line) - len(keys) :])
            order = inside[np.argsort(keys[inside], kind="stable")]
            self.windows.append((keys[order], order))
            self.seen[(keys[order] >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def overlaps(self, text: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        return self.overlaps_of_many([text])[0]

    def overlaps_of_many(self, texts: list[np.ndarray]) -> list[dict[int, tuple[int, int, int, int]]]:
        """For each text, item -> the overlap with most matches: first token in the text, in the item, length, matches."""
        best: list[dict] = [{} for _ in texts]
        begins = np.cumsum([0, *map(len, texts)])
        line = np.concatenate([np.zeros(0, np.uint64), *texts])
        owner = np.repeat(np.arange(len(texts)), np.diff(begins))
        agree = partial(self._agree, line, owner)
        known: dict[tuple[int, int, int], int] = {}
        for mask, (keys, places) in zip(MASKS, self.windows, strict=True):
            found = seeded(line, mask)
            maybe = np.flatnonzero(self.seen[(found >> np.uint64(64 - _BITS)).astype(np.int64)] & (owner[: len(found)] == owner[len(line) - len(found) :]))
            lo, hi = (np.searchsorted(keys, found[maybe], side=s) for s in ("left", "right"))
            at, lo, n = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            upto = np.cumsum(n)
            for a, b in _parts(upto, PAIRS):
                count = n[a:b]
                pair_at = np.repeat(at[a:b], count)
                pair_place = places[np.repeat(lo[a:b], count) + np.arange(len(pair_at)) - np.repeat(upto[a:b] - count - (upto[a - 1] if a else 0), count)]
                ends = ~(agree(pair_at - 1, pair_place - 1, mask) & agree(pair_at + 1, pair_place + 1, mask))
                for w, place in zip(pair_at[ends].tolist(), pair_place[ends].tolist(), strict=True):
                    t, k = int(owner[w]), int(self.owner[place])
                    self._verify(texts[t], w - int(begins[t]), t, k, place - int(self.begins[k]), known, best[t])
        if len(self.firsts):
            for w in np.flatnonzero(np.isin(line, self.firsts)).tolist():
                t = int(owner[w])
                at = w - int(begins[t])
                for k in self.short[int(line[w])]:
                    n = len(self.tokens[k])
                    if n <= len(texts[t]) - at and np.array_equal(texts[t][at : at + n], self.tokens[k]):
                        best[t].setdefault(k, (at, 0, n, n))
        return best

    def _agree(self, line: np.ndarray, owner: np.ndarray, at: np.ndarray, place: np.ndarray, mask: str) -> np.ndarray:
        """Whether windows of a line of texts and of the items, each whole within its own, agree under a mask."""
        last = len(mask) - 1
        good = (at >= 0) & (at + last < len(line)) & (place >= 0) & (place + last < len(self.line))
        a, p = np.where(good, at, 0), np.where(good, place, 0)
        good &= (owner[a] == owner[np.minimum(a + last, len(line) - 1)]) & (self.owner[p] == self.owner[np.minimum(p + last, len(self.line) - 1)])
        some = np.flatnonzero(good)
        for k, used in enumerate(mask):
            if used == "1":
                some = some[line[a[some] + k] == self.line[p[some] + k]]
        good[:] = False
        good[some] = True
        return good

    def _verify(self, text: np.ndarray, at: int, t: int, k: int, place: int, known: dict, best: dict) -> None:
        shift = at - place
        if known.get((t, k, shift), -1) > at:  # this stretch of the alignment is known
            return
        item = self.tokens[k]
        first, stop = max(0, -shift), min(len(item), len(text) - shift)
        lo, hi, matches = best_stretch(item[first:stop] == text[first + shift : stop + shift], place - first)
        known[t, k, shift] = first + shift + hi
        wanted = min(LEAST_TOKENS, int(np.ceil(ITEM_SHARE * len(item))))
        if matches >= wanted and matches > best.get(k, (0, 0, 0, 0))[3]:
            best[k] = (first + shift + lo, first + lo, hi - lo, matches)


def _parts(upto: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of places whose counts, of which `upto` are the sums, add up to about `most` at a time."""
    if not len(upto):
        return []
    cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(most, upto[-1], most), side="left") + 1, len(upto)]).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


def shards(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS):
    """Broadcast indexes, one after the other, that together hold all items; each has max_windows windows or so."""
    spark = benchmark.sparkSession
    sized = benchmark.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
    windows = sized.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    n = max(1, -(-int(windows * len(MASKS)) // max_windows))
    for shard in range(n):
        own = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == shard)
        hashes = _Hashes()
        yield spark.sparkContext.broadcast(Index([(r[0], hashes.of(tokens_of(r[1]))) for r in own.toLocalIterator()]))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row for each text and item that overlap: ids, the best overlap's places, length and matches."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType)]
        + [T.StructField(c, T.IntegerType()) for c in ("doc_token", "item_token", "length", "matches", "item_length")]
    )
    found = [map_slices(docs.select(id_, text), schema, _searching(index, id_, text, schema)) for index in shards(benchmark, item_id, item_text, max_windows)]
    return reduce(DataFrame.union, found)


def _searching(index, id_: str, text: str, schema: T.StructType):
    def start():
        held, hashes, item_type = index.value, _Hashes(), to_arrow_type(schema["item_id"].dataType)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            ids = batch.column(batch.schema.get_field_index(id_))
            for k, found in enumerate(held.overlaps_of_many([hashes.of(tokens_of(x)) for x in texts_of(batch, text)])):
                for item, (at, place, length, matches) in sorted(found.items()):
                    rows.append((k, held.ids[item], at, place, length, matches, len(held.tokens[item])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            numbers = [pa.array(c, pa.int32()) for c in columns[2:]]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], item_type), *numbers], names=schema.names)

        return one

    return start


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without an overlap, all columns; each shard of the benchmark filters what the last one kept."""

    def filtering(index):
        def start():
            held, hashes = index.value, _Hashes()
            return lambda batch: batch.filter(pa.array([not x for x in held.overlaps_of_many([hashes.of(tokens_of(x)) for x in texts_of(batch, text)])], pa.bool_()))

        return start

    for index in shards(benchmark, item_id, item_text, max_windows):
        docs = map_slices(docs, docs.schema, filtering(index))
    return docs
