"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits, each the majority over the hashes of a text's word shingles. Two fingerprints
link at a radius or less of differing bits. They are cut into `radius + 2` bands, of which such a pair
shares two at least (`radius` differing bits spoil `radius` bands at most), so each pair of bands is a
table of buckets, and within a bucket every pair is compared, none left out.

The comparison is bit-sliced: bit planes stand vertically (one word holds one bit of 64 fingerprints);
for each shift d, fingerprint i meets i + d, plane by plane, the first shifts one by one and later ones many at
once; carry-save adders count differing bits for 64 pairs at once; words of which no pair can still be within
the radius are abandoned. Pairs that are already in one component need no comparison, so a dense group costs little, and only links that join two
components leave a bucket: fewer than its members. A bucket of very many fingerprints goes to several
tasks, a pair of its blocks to each.

Near-duplicates by Jaccard similarity (`near_components`) go the same way with wide fingerprints, of 256 bits
over a text's distinct shingles, of which the share that differs follows the similarity: at 0.8 about 0.15.
Their buckets are agreements of several least shingle hashes, which two texts have with a probability that
depends on their similarity alone, not on how many texts there are: BANDS buckets of ROWS hashes find a pair
at 0.8 with a probability of 0.99, one at 0.9 with 0.99999. Within buckets the bit-sliced comparison links at
a radius well beyond the similarity; the groups that it gives are then gone through once more, with the
shingle sets at hand, and only pairs whose sets have the similarity link.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle; repeated rows get the same component; an
empty table gives an empty table; null ids are kept, and never name a component unless it has no other; only
the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import add_columns, map_arrow, map_slices, materialise, texts_of
from labelloom.llm.components import connected

BITS = 64
#: Fingerprints that a task compares at once; and those of one bucket above which it is split up.
AT_ONCE, SPLIT_ABOVE = 200_000, 100_000
#: Words of lanes that are counted at once, and not many more than those of one shift.
WORDS_AT_ONCE = 4096
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a text, repeats included, A-Z in lower case."""
    from xxhash import xxh64_intdigest as h

    parts = text.encode().translate(_FOLD).split()
    if not parts:
        return np.zeros(0, "<u8")
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([h(line, 42)], "<u8")
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    starts = [0, *ends]
    return np.array([h(line[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)], "<u8")


def majority(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """The bits set in over half of the hashes, as `width` 64-bit words; all words but the first take each
    hash mixed once more."""
    if not len(hashes):
        return np.zeros(width, "<u8")
    ones = np.zeros(BITS * width, np.int64)
    for at in range(0, len(hashes), 4096):
        block = np.empty((len(hashes[at : at + 4096]), width), "<u8")
        block[:, 0] = hashes[at : at + 4096]
        for k in range(1, width):
            x = block[:, 0] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            block[:, k] = x ^ (x >> np.uint64(31))
        ones += np.unpackbits(block.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str, words: int) -> int:
    return int(majority(shingle_hashes(text, words))[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", words: int = 4) -> DataFrame:
    """Adds the fingerprint of each whole text as a signed 64-bit integer."""

    def start():
        def one(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(text)).to_pylist()
            return [pa.array(np.array([fingerprint(x or "", words) for x in column], np.uint64).view(np.int64))]

        return one

    return add_columns(df, [T.StructField(out, T.LongType())], start)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def planes_of(fp: np.ndarray) -> np.ndarray:
    """A row of words for each bit: bit b of fingerprint i is bit i % 64 of word i // 64 of row b. One word of padding."""
    n = len(fp)
    bits = np.unpackbits(np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    held = np.zeros((bits.shape[1], (n // 64 + 2) * 64), np.uint8)
    held[:, :n] = bits.T
    return np.packbits(held, axis=1, bitorder="little").view("<u8")


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bitwise counters (least bit first) are above the radius."""
    above = np.zeros_like(counters[0])
    same = ~above
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            above |= same & counters[k]
            same = same & ~counters[k]
    return above


def within(planes: np.ndarray, shift: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the given lanes of these words, those whose fingerprint and the one `shift` further are near; each
    word has its own shift.

    Returns shifts, words and their lanes, without the words that have none.
    """
    there = words + shift // 64
    after, turn = np.minimum(there + 1, planes.shape[1] - 1), (shift % 64).astype(np.uint64)
    rest, one = np.uint64(63) - turn, np.uint64(1)
    depth = max(2, (radius + 1).bit_length())
    counters = [np.zeros(len(words), np.uint64) for _ in range(depth)]
    spilt = np.zeros(len(words), np.uint64)

    def differing(b: int) -> np.ndarray:
        row = planes[b]
        return row[words] ^ (row[there] >> turn | row[after] << rest << one)

    for b in range(0, len(planes), 2):
        x, y = differing(b), differing(b + 1)
        low = counters[0]
        half = low ^ x
        carry = low & x | half & y  # a carry-save adder: three bits of weight one give one of each weight
        counters[0] = half ^ y
        for k in range(1, depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        spilt |= carry
        if b % 8 == 6:
            lanes = lanes & ~(spilt | _over(counters, radius))
            alive = np.flatnonzero(lanes)
            if not len(alive):
                return shift[:0], words[:0], lanes[:0]
            if len(alive) < len(words):
                shift, words, lanes, spilt = shift[alive], words[alive], lanes[alive], spilt[alive]
                there, after, turn, rest = there[alive], after[alive], turn[alive], rest[alive]
                counters = [c[alive] for c in counters]
    return shift, words, lanes


def _lanes(mask: np.ndarray) -> np.ndarray:
    n = len(mask)
    held = np.zeros(-(-n // 64) * 64, np.uint8)
    held[:n] = mask
    return np.packbits(held, bitorder="little").view("<u8")


def joining_links(bucket: np.ndarray, fp: np.ndarray, radius: int, links: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints in buckets (n, or n x words): pairs of places that span the components which links
    within the radius make in each bucket, each member with the first of its own, so that no chain is left to
    follow; if `links` is given, only pairs of places that it confirms are links."""
    none = np.zeros(0, np.int64)
    if len(fp) < 2:
        return none, none
    _, which, sizes = np.unique(bucket, return_inverse=True, return_counts=True)
    order = np.lexsort((fp if fp.ndim == 1 else fp[:, 0], which, -sizes[which]))
    fp, which, size = fp[order], which[order], sizes[which][order]
    first = np.r_[True, which[1:] != which[:-1]]
    at = np.arange(len(fp))
    left = size - (at - np.maximum.accumulate(np.where(first, at, 0)))  # members from here on, this one too
    planes, label = planes_of(fp), at.copy()
    parent = at.tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    begin, many = 1, 1  # the first shifts, which join most, one by one; later ones together, up to WORDS_AT_ONCE
    while begin < int(size[0]):
        taken: list[tuple[np.ndarray, ...]] = []
        held, shift = 0, begin
        while shift < min(begin + many, int(size[0])) and held < WORDS_AT_ONCE:
            n = int(np.searchsorted(-size, -shift, side="left"))  # of buckets with more than `shift` members
            open_ = left[:n] > shift
            open_[: max(0, n - shift)] &= label[: max(0, n - shift)] != label[shift:n]
            lanes = _lanes(open_)
            words = np.flatnonzero(lanes)
            taken.append((np.full(len(words), shift), words, lanes[words]))
            held += len(words)
            shift += 1
        begin, many = shift, 2 * many
        if not held:
            continue
        shifts, words, near = within(planes, *(np.concatenate(x) for x in zip(*taken, strict=True)), radius)
        if not len(words):
            continue
        found = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, lane = np.nonzero(found)
        joined, place = False, words[w] * 64 + lane
        for i, j in zip(place.tolist(), (place + shifts[w]).tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b and (links is None or links(int(order[i]), int(order[j]))):
                parent[max(a, b)] = min(a, b)
                joined = True
        if joined:
            label = np.array(parent)
            while not np.array_equal(up := label[label], label):
                label = up
            parent = label.tolist()
    member = np.flatnonzero(label != at)
    return order[label[member]], order[member]


def _band_keys(fp: Column, bands: int) -> Column:
    """For each two of the bands, the number of that pair and the bits of both."""
    cuts = [BITS * k // bands for k in range(bands + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    widest = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    if 2 * widest > 50:
        return F.array(*[F.xxhash64(F.lit(n), part[i], part[j]) for n, (i, j) in enumerate(combinations(range(bands), 2))])
    return F.array(*[F.lit(n << 2 * widest).bitwiseOR(F.shiftleft(part[i], widest)).bitwiseOR(part[j]) for n, (i, j) in enumerate(combinations(range(bands), 2))])


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("later", "a", "b")])


def _compare_sorted(rows: DataFrame, radius: int, at_once: int, split_above: int | None, similarity: float | None = None) -> DataFrame:
    """Rows (key, node), (key, node, fp) or (key, node, fp, shingles), each key within one partition and in
    order; without fp, node is the fingerprint. Gives links between nodes (later null), and the members of
    buckets above split_above (later = key, a = node). With shingles, links must have the similarity too."""
    wide, sets = len(rows.columns) > 2, len(rows.columns) > 3

    def batch_of(later, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([later, pa.array(a), b], names=_FOUND.names)

    def run(batches):
        held: list[tuple] = []
        waiting, size, deferred = 0, 0, None  # deferred: the key of a bucket too large, of which rows still come

        def flush(last: bool):
            nonlocal held, waiting, size, deferred
            if not waiting:
                return
            key, node, fp = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
            shingles = [x for h in held for x in h[3]]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[first, len(key)])
            large = (sizes > split_above) | (key[first] == deferred) if split_above is not None else np.zeros(len(first), bool)
            stop = len(key) if last or large[-1] else int(first[-1])
            deferred = key[-1] if large[-1] else None
            off = np.repeat(large, sizes)
            if off.any():
                yield batch_of(pa.array(key[off]), node[off], pa.nulls(int(off.sum()), pa.int64()))
            use = np.flatnonzero(~off[:stop])
            own = [np.frombuffer(shingles[k], "<u8") for k in use] if sets else []
            i, j = joining_links(key[use], fp[use], radius, Similar(key[use], own, similarity) if sets else None)
            if len(i):
                yield batch_of(pa.nulls(len(i), pa.int64()), node[use[i]], pa.array(node[use[j]]))
            held, waiting = [(key[stop:], node[stop:], fp[stop:], shingles[stop:])], len(key) - stop
            size = sum(map(len, shingles[stop:]))

        grow, most = at_once, SET_BYTES
        for batch in batches:
            key, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if wide:
                fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            else:
                fp = node.view(np.uint64)
            shingles = batch.column(3).to_pylist() if sets else []
            held.append((key, node, fp, shingles))
            waiting += batch.num_rows
            size += sum(map(len, shingles))
            if waiting >= grow or size >= most:
                yield from flush(False)
                grow, most = max(at_once, 2 * waiting), max(SET_BYTES, 2 * size)
        yield from flush(True)

    return map_arrow(rows, run, _FOUND)


def _links(keyed: DataFrame, prints: DataFrame | None, radius: int, at_once: int, split_above: int, similarity: float | None = None) -> DataFrame:
    """keyed: (key, node) and what _compare_sorted takes further; prints: the further columns by node, where
    there are any."""
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = materialise(_compare_sorted(dealt, radius, at_once, split_above, similarity), "near")
    links, later = found.where("later is null").select("a", "b"), found.where("later is not null").select(F.col("later").alias("key"), F.col("a").alias("node"))
    if later.limit(1).count() == 0:
        return links
    blocks = later.groupBy("key").agg((F.floor(F.count("*") * 2 / split_above) + 1).cast("int").alias("blocks"))
    member = later.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(radius)), F.col("blocks")))
    spread = member.select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    task = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    again = spread.select(task.alias("key"), "node")
    again = again if prints is None else again.join(prints, "node").select(*keyed.columns)
    again = again.repartition("key").sortWithinPartitions("key")
    return links.union(materialise(_compare_sorted(again, radius, at_once, None, similarity), "near-split").select("a", "b"))


def links_within(fps: DataFrame, fp: str, radius: int = 4, at_once: int = AT_ONCE, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Distinct fingerprints -> links (a, b) that span all components at the radius."""
    value = F.col(fp)
    keyed = fps.select(F.explode(_band_keys(value, radius + 2)).alias("key"), value.alias("node"))
    return _links(keyed, None, radius, at_once, split_above)


def components(df: DataFrame, id_: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """All rows as (id, fp, component_id): the least id that links reach, the row's own included."""
    prints = materialise(with_fingerprint(df.select(F.col(id_).alias("_id"), F.col(text).alias("_text")), "_text", "fp", words).select("_id", "fp"), "prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("_id").alias("least")), "distinct-prints")
    found = connected(links_within(distinct, "fp", radius), "a", "b")
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return _named(prints, rooted).select(F.col("_id").alias(id_), "fp", "component_id")


def _named(prints: DataFrame, rooted: DataFrame) -> DataFrame:
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return prints.join(of_print, "fp")


#: Words of a wide fingerprint; the share of differing bits up to which two are compared by their shingles (at
#: a similarity of 0.8 it is 0.15 with a deviation of 0.022); buckets of a text, and least hashes of each.
WIDE, WIDE_SHARE, BANDS, ROWS = 4, 0.25, 12, 5
SIMILARITY = 0.8
#: Wide fingerprints that a task compares at once, and those of one bucket above which it is split up; bytes of
#: shingle sets that a task holds at once, and sets of one group above which it is split up.
WIDE_AT_ONCE, WIDE_SPLIT_ABOVE, SET_BYTES, SETS_SPLIT_ABOVE = 100_000, 30_000, 48 << 20, 4_000
#: Times that a set is compared with one other before it is compared with its whole bucket; entries of shingles'
#: lists that are counted at once.
ASKED, GATHERED = 32, 1 << 20
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets; that of two empty ones is 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return both / (len(a) + len(b) - both)


class Similar:
    """Whether the sets at two places of one bucket have the similarity.

    Sets asked for often are compared with their whole bucket at once, by counting along the lists of the sets
    that have each shingle; buckets stand in a row, and the lists of one are made when it needs them first.
    """

    def __init__(self, bucket: np.ndarray, sets: list[np.ndarray], similarity: float):
        self.sets, self.similarity = sets, similarity
        self.first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        self.asked = [0] * len(sets)
        self.rows: dict[int, tuple[int, np.ndarray]] = {}
        self.lists: dict[int, tuple[np.ndarray, ...]] = {}

    def __call__(self, a: int, b: int) -> bool:
        if a not in self.rows:
            self.asked[a] += 1
            if self.asked[a] <= ASKED:
                return jaccard(self.sets[a], self.sets[b]) >= self.similarity
            self.rows[a] = self._row(a)
        start, row = self.rows[a]
        return bool(row[b - start >> 3] >> (b - start & 7) & 1)

    def _row(self, a: int) -> tuple[int, np.ndarray]:
        """The bucket's first place, and a bit for each of its sets."""
        k = int(np.searchsorted(self.first, a, side="right")) - 1
        start = int(self.first[k])
        if k not in self.lists:
            own = self.sets[start : self.first[k + 1] if k + 1 < len(self.first) else len(self.sets)]
            sizes = np.array([len(x) for x in own])
            which = np.unique(np.concatenate(own), return_inverse=True)[1].astype(np.int32)
            owners = np.repeat(np.arange(len(own), dtype=np.int32), sizes)[np.argsort(which, kind="stable")]
            self.lists[k] = sizes, np.r_[0, np.cumsum(sizes)], which, owners, np.r_[0, np.cumsum(np.bincount(which))]
        sizes, bounds, which, owners, ends = self.lists[k]
        mine, both = which[bounds[a - start] : bounds[a - start + 1]], np.zeros(len(sizes), np.int64)
        step = max(1, GATHERED // len(sizes))
        for at in range(0, len(mine), step):
            both += np.bincount(np.concatenate([owners[ends[x] : ends[x + 1]] for x in mine[at : at + step].tolist()]), minlength=len(sizes))
        either = sizes[a - start] + sizes - both
        return start, np.packbits(np.where(either > 0, both / np.maximum(either, 1) >= self.similarity, True), bitorder="little")


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """The buckets of a set of shingle hashes: each is the number of a band and its least hashes, mixed."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * _FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


_PRINTS = T.StructType([T.StructField(c, T.BinaryType()) for c in ("digest", "fp", "bands")])
_KEYED = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("fp", T.BinaryType())])


def _with_prints(df: DataFrame, words: int) -> DataFrame:
    """Replaces _text by a digest of its shingle set, the wide fingerprint and the buckets."""

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, prints, bands = [], [], []
            for x in texts_of(batch, "_text"):
                own = shingle_set(x, words)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest()), prints.append(majority(own, WIDE).tobytes()), bands.append(bands_of(own).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (digests, prints, bands))], names=schema.names)

        return one

    schema = T.StructType([df.schema["_id"], df.schema["_sha"], *_PRINTS])
    return map_slices(df.select("_id", "_sha", "_text"), schema, start)


def _keys(classes: DataFrame) -> DataFrame:
    """(node, fp, bands) -> (key, node, fp) for each bucket."""

    def start():
        def one(batch: pa.RecordBatch):
            node, fp = batch.column(0), batch.column(1)
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8").reshape(batch.num_rows, -1)
            for k in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, k])), node, fp], names=_KEYED.names)

        return one

    return map_slices(classes.select("node", "fp", "bands"), _KEYED, start, rows=4096)


def _with_shingles(members: DataFrame, words: int) -> DataFrame:
    """(key, node, fp, _text) -> (key, node, fp, shingles)."""

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = pa.array([shingle_set(x, words).tobytes() for x in texts_of(batch, "_text")], pa.binary())
            return pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=schema.names)

        return one

    schema = T.StructType([*_KEYED, T.StructField("shingles", T.BinaryType())])
    return map_slices(members.select("key", "node", "fp", "_text"), schema, start)


def identified(df: DataFrame, id_: str, text: str) -> DataFrame:
    """df with `_id` and `_sha`, which tell different texts of one id apart."""
    return df.withColumns({"_id": F.col(id_), "_sha": F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))})


def near_components(df: DataFrame, id_: str = "doc_id", text: str = "text", words: int = 5, similarity: float = SIMILARITY, split_above: int = WIDE_SPLIT_ABOVE, sets_split_above: int = SETS_SPLIT_ABOVE) -> DataFrame:
    """For each text of an id (`_id`, `_sha`) the least such pair, by id, that links reach (`least`); texts link
    if their sets of word shingles have the similarity. Nulls as ids come last."""
    docs = identified(df, id_, text).select("_id", "_sha", F.col(text).alias("_text"))
    prints = materialise(_with_prints(docs, words), "wide-prints")
    who = F.struct(F.col("_id").isNull().alias("none"), "_id", "_sha")
    classes = prints.groupBy("digest").agg(F.min(who).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "wide-classes")  # numbers are fixed by writing
    nodes = classes.select("node", "fp")
    radius = int(WIDE_SHARE * BITS * WIDE)
    groups = connected(_links(_keys(classes), nodes, radius, WIDE_AT_ONCE, split_above), "a", "b")
    members = classes.select("node", "fp", "least.*").join(groups.select("node", F.col("root").alias("key")), "node")
    same = members["_id"].eqNullSafe(docs["_id"]) & (members["_sha"] == docs["_sha"])
    sets = _with_shingles(docs.join(members, same).select("key", "node", "fp", "_text"), words)
    sets = materialise(sets.dropDuplicates(["node"]), "wide-shingles")
    links = _links(sets, sets.select("node", "fp", "shingles"), radius, WIDE_AT_ONCE, sets_split_above, similarity)
    rooted = classes.select("digest", "least", "node").join(connected(links, "a", "b"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least").alias("first"))
    of_digest = rooted.join(names, "root").select("digest", F.struct("first._id", "first._sha").alias("least"))
    return prints.select("_id", "_sha", "digest").join(of_digest, "digest").select("_id", "_sha", "least")


def representatives(df: DataFrame, id_: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row of each group of near-duplicates: that of the least id (and text hash), of rows that repeat it
    one. Rows without an id all stay."""
    found = near_components(df, id_, text, **more)
    first = found.where((F.col("_id") == F.col("least._id")) & (F.col("_sha") == F.col("least._sha"))).select("_id", "_sha").distinct()
    marked = identified(df, id_, text)
    kept = marked.where("_id is not null").join(first, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"])
    return kept.unionByName(marked.where("_id is null")).select(*df.columns)
