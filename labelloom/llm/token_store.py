"""A content-addressed store for token-id streams.

A document's ids are cut into chunks where a rolling hash over the last ids hits a pattern, so equal
passages give equal chunks wherever they stand. Each distinct chunk is stored once, under the hash of its
content; a document is a recipe, the list of its chunks' hashes; and a Merkle root over them stands in the
manifest, in ascending id order with the place of each document in the whole stream. Reading takes the
chunks back from their files, tests each against its own hash, and each document against its root.

Files (Parquet, so that any executor may write and any reader prune):
  chunks    hash binary, ids binary: packed, two bytes an id where the vocabulary allows, else four; each
            once, so in no document's order
  manifest  doc_id, row long, n_tokens long, root binary, hashes array of binary (the recipe), sizes array of
            int (ids of each of its chunks), start long; in ascending order of doc_id, nulls first, over its files and within each

Defined results: a null text counts as empty; each document ends with the end id, so an empty one has one
id; texts of any length are stored whole; repeated rows and repeated ids each have a recipe of their own;
an empty table gives an empty store; further columns are not stored, but for the id.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.bpe import PLAIN, plain_pattern  # PLAIN: below this code point the standard library's expressions do
from labelloom.llm.common import forget, map_slices, materialise, running_offsets, shared_dir, texts_of

#: Ids under the rolling window (a power of two); the mean, least and most of a chunk's ids.
WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 2048
#: Bytes of words and their ids that a task remembers, each with its share of the table; then it starts anew.
REMEMBERED, ENTRY = 256 << 20, 200
#: What the last id of a piece ends in.
SUFFIX = "</w>"
#: Marks that often stand behind a word, each a piece of its own there.
MARKS = (",", ".")
_GEAR = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_GEAR = (_GEAR ^ (_GEAR >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
_GEAR ^= _GEAR >> np.uint64(32)


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of an id stream's chunks."""
    return cuts_of_many(ids, [0, len(ids)])[0]


def cuts_of_many(ids: np.ndarray, bounds: list[int]) -> list[list[int]]:
    """The ends of the chunks of several streams that lie one after the other, each from its own start.

    The hash at a place is the sum of the window's gears, each shifted once more for each step back; it
    is built by doubling. A chunk ends at the first hit after LEAST ids, or after MOST; as LEAST is more than
    the window, no hash that counts reaches into the stream before.
    """
    h = _GEAR[ids & 0xFFFF] + (ids >> 16).astype(np.uint64)
    step = 1
    while step < WINDOW:
        h[step:] = (h[:-step] << np.uint64(step)) + h[step:]
        step *= 2
    places = np.flatnonzero((h >> np.uint64(8)) % np.uint64(MEAN) == 0) + 1
    parted = np.searchsorted(places, bounds, side="right").tolist()
    places, out = places.tolist(), []
    for a, b, k, last in zip(bounds, bounds[1:], parted, parted[1:], strict=False):
        ends, begin = [], a
        while b - begin > MOST or k < last:
            while k < last and places[k] < begin + LEAST:
                k += 1
            end = min(places[k] if k < last else b, begin + MOST)
            if end >= b:
                break
            ends.append(end - a)
            begin = end
        if b > a:
            ends.append(b - a)
        out.append(ends)
    return out


def address(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Hashes of pairs, level by level; an odd one goes up as it is; no leaves: the hash of nothing."""
    level = list(leaves) or [b""]
    if len(level) == 1:
        return address(b"\x00" + level[0])
    while len(level) > 1:
        level = [address(b"\x01" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the others for the letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    """Whole texts to ids with the tokenizers library, word by word.

    Spaces and line ends always part what this tokenizer's expressions match, and it drops them, so a
    text's ids are those of its blank-separated words one after the other; each new word is encoded by
    the library once and remembered. Words of characters below PLAIN, which its normaliser only puts
    in lower case, are taken apart by its own expression, and many of their pieces go through its model at a
    time; all others go through the library as they are. Vocabularies for which that does not hold are
    encoded text by text.
    """

    def __init__(self, content: str, end_id: int, expression: str | None):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.end_id = Tokenizer.from_str(content), end_id
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.wide = max(vocabulary.values()) >= 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.end = np.array([end_id], self.kind).tobytes()
        self.find = re.compile(plain_pattern(expression)).findall if expression else None
        self.pieces = Tokenizer(self.tokenizer.model)  # takes pieces as they are, a blank between each two
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = byte_letters() | {32: " "}
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(SUFFIX)]] = True
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, with the end id."""
        if not self.find:
            return [self._packed(x) + self.end for x in texts]
        if self.held > REMEMBERED:
            self.memory.clear()
            self.held = 0
        memory = self.memory
        split = [(x.lower() if _lowered_alike(x) else x).replace("\n", " ").split(" ") for x in texts]
        found = [list(map(memory.get, words)) for words in split]
        new: set[str] = set()
        for words, own in zip(split, found, strict=True):
            if None in own:
                new.update([w for w, x in zip(words, own, strict=True) if x is None])
        self._learn(new)
        return [b"".join([memory[w] if x is None else x for w, x in zip(words, own, strict=True)] if None in own else own) + self.end for words, own in zip(split, found, strict=True)]

    def _learn(self, new: set[str]) -> None:
        """Words of letters only are one piece each; one with a mark behind is that word's ids and the mark's."""
        memory = self.memory
        plain, marked, mixed, other = [], [], [], []
        for w in new:
            if not _lowered_alone(w):
                other.append(w)
            elif w.isalpha():
                plain.append(w)
            elif w[-1:] in MARKS and w[:-1].isalpha():
                marked.append(w)
                if w[:-1] not in memory and w[:-1] not in new:
                    plain.append(w[:-1])
            else:
                mixed.append(w)
        self._remember(plain := list(dict.fromkeys(plain)), self._by_pieces(plain, None))
        taken = [self.find(w.lower()) for w in mixed]
        self._remember(mixed, self._by_pieces([x for own in taken for x in own], [len(own) for own in taken]))
        self._remember(other, [self._packed(w) for w in other])
        for m in MARKS:
            memory[m] = self._packed(m)
        self._remember(marked, [memory[w[:-1]] + memory[w[-1]] for w in marked])

    def _remember(self, words: list[str], packed: list[bytes]) -> None:
        self.memory.update(zip(words, packed, strict=True))
        self.held += ENTRY * len(words) + sum(map(len, words)) + sum(map(len, packed))

    def _by_pieces(self, pieces: list[str], counts: list[int] | None) -> list[bytes]:
        """Packed ids of words, from their pieces in a row and how many each has (None: one); a piece's last
        id, and no other, ends in the suffix."""
        ids = [np.zeros(0, self.kind)]
        for at in range(0, len(pieces), 5000):
            line = " ".join(pieces[at : at + 5000]).lower()
            if not (line.isascii() and counts is None):
                line = line.encode().decode("latin-1").translate(self.letters)
            ids.append(np.array(self.pieces.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.kind))
        all_ids = np.concatenate(ids)
        ends = np.r_[0, np.flatnonzero(self.last[all_ids]) + 1]
        if len(ends) != len(pieces) + 1:
            raise ValueError("pieces and their ids don't agree")
        bounds = ((ends if counts is None else ends[np.cumsum([0, *counts])]) * all_ids.itemsize).tolist()
        packed = all_ids.tobytes()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _packed(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


#: Whether a text has a character from PLAIN on.
_BEYOND = re.compile(f"[^\x00-{chr(PLAIN - 1)}]").search


def _lowered_alone(word: str) -> bool:
    """Whether all that the normaliser does to a word is lower case, and that below PLAIN."""
    return "<" not in word and (word.isascii() or not _BEYOND(word) and not _BEYOND(word.lower()))


def _lowered_alike(text: str) -> bool:
    """Whether the standard library's lower case of a text is the tokenizer's, special tokens included."""
    return "<" not in text and (text.isascii() or not _BEYOND(text))


def words_expression(content: str) -> str | None:
    """The expression by which a tokenizer.json takes texts apart, if it drops blanks, puts all in lower case and
    never matches across a blank, by its own parts; else None."""
    import json

    spec = json.loads(content)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split, bytes_ = (steps + [{}, {}])[:2]
    if len(steps) != 2 or split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert"):
        return None
    if bytes_.get("type") != "ByteLevel" or bytes_.get("use_regex") or bytes_.get("add_prefix_space"):
        return None
    added = [t for t in spec.get("added_tokens", []) if not t["content"].startswith("<") or " " in t["content"] or t["lstrip"] or t["rstrip"]]
    kinds = {n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])}
    expression = split.get("pattern", {}).get("Regex", "")
    model = spec.get("model") or {}
    fits = model.get("type") == "BPE" and model.get("end_of_word_suffix") == SUFFIX and not model.get("dropout") and not added and kinds == {"NFC", "Replace", "Lowercase"} and "[\\p{L}]+" in expression and " " not in expression and "\\s+" not in expression
    return expression if fits else None


@lru_cache(maxsize=1)
def _encoder(content: str, end_id: int) -> WordEncoder:
    return WordEncoder(content, end_id, words_expression(content))


_CUT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("root", T.BinaryType()),
    T.StructField("hashes", T.ArrayType(T.BinaryType())),
    T.StructField("sizes", T.ArrayType(T.IntegerType())),
    T.StructField("chunks", T.ArrayType(T.BinaryType())),
])


@dataclass
class Store:
    """Where a store lies, and the bytes of an id in its chunks."""

    path: str
    width: int

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def write_store(df: DataFrame, tokenizer_path: str, end_id: int, id_: str = "doc_id", text: str = "text", path: str | None = None) -> Store:
    """Encodes all texts and writes chunks and the manifest with its recipes."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    sent = spark.sparkContext.broadcast(content)  # the vocabulary: its size does not depend on the data
    wide = _encoder(content, end_id).wide
    schema = T.StructType([T.StructField("doc_id", df.schema[id_].dataType), *_CUT.fields[1:]])

    def start():
        encoder = _encoder(sent.value, end_id)
        gc.disable()  # millions of new strings, no cycles; map_arrow sweeps at the end of the task
        width = 4 if encoder.wide else 2

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = encoder.encode(texts_of(batch, text))
            bounds = [0, *np.cumsum([len(p) // width for p in coded]).tolist()]
            ends = cuts_of_many(np.frombuffer(b"".join(coded), encoder.kind).astype(np.int64), bounds)
            chunks = [[p[a * width : b * width] for a, b in zip([0, *own], own, strict=False)] for p, own in zip(coded, ends, strict=True)]
            hashes = [[address(c) for c in own] for own in chunks]
            many = pa.list_(pa.binary())
            ids_of = batch.column(batch.schema.get_field_index(id_))
            columns = [ids_of, pa.array([len(p) // width for p in coded], pa.int64()), pa.array(map(merkle_root, hashes), pa.binary()), pa.array(hashes, many), pa.array([[len(c) // width for c in own] for own in chunks], pa.list_(pa.int32())), pa.array(chunks, many)]
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        return one

    cut = map_slices(df.select(id_, text), schema, start).withColumn("row", F.monotonically_increasing_id())
    cut = materialise(cut, "cut-ids", "zstd")  # the row numbers and chunks are fixed from here on
    pieces = cut.select(F.explode(F.arrays_zip("hashes", "chunks")).alias("c")).select(F.col("c.hashes").alias("hash"), F.col("c.chunks").alias("ids"))
    pieces.groupBy("hash").agg(F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    listed = running_offsets(cut.select("doc_id", "row", "n_tokens", "root", "hashes", "sizes"), "doc_id", "n_tokens", "start", "manifest-rows")
    listed.write.parquet(f"{path}/manifest")
    forget(cut)
    return Store(path, 4 if wide else 2)


def crc32_joined(first: int, second: int, n_second: int) -> int:
    """The CRC-32 of two joined byte strings, from those of each and the length of the second.

    Appending n zero bytes is a linear map of the register; it is put together from those for powers of
    two, and remembered for each length.
    """
    return _times(_zeros(n_second), first) ^ second


@lru_cache(maxsize=2 * MOST)
def _zeros(n: int) -> tuple[int, ...]:
    m, k = tuple(1 << b for b in range(32)), 0
    while n:
        if n & 1:
            m = tuple(_times(_zero_bytes(k), c) for c in m)
        n >>= 1
        k += 1
    return m


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out = 0
    while vector:
        low = vector & -vector
        out ^= matrix[low.bit_length() - 1]
        vector ^= low
    return out


@lru_cache(maxsize=64)
def _zero_bytes(k: int) -> tuple[int, ...]:
    """The map that 2^k zero bytes are."""
    if k == 0:
        m = tuple([0xEDB88320, *(1 << b for b in range(31))])  # one zero bit
        for _ in range(3):
            m = tuple(_times(m, c) for c in m)
        return m
    half = _zero_bytes(k - 1)
    return tuple(_times(half, c) for c in half)


@lru_cache(maxsize=64)
def _zero_table(k: int) -> np.ndarray:
    """The map that 2^k zero bytes are, as a table for each byte of the register."""
    columns = np.array(_zero_bytes(k), np.uint32).reshape(4, 8)
    bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
    return np.bitwise_xor.reduce(np.where(bits[None], columns[:, None, :], np.uint32(0)), axis=2)


def crc32_before(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What byte strings with these CRC-32s add to the CRC of a whole in which so many bytes follow them: each
    goes through the map of that many zero bytes, all at once."""
    out, k = crcs.astype(np.uint32), 0
    while len(after) and (1 << k) <= int(after.max()):
        some = np.flatnonzero(after >> k & 1)
        v, t = out[some], _zero_table(k)
        out[some] = t[0, v & 255] ^ t[1, v >> 8 & 255] ^ t[2, v >> 16 & 255] ^ t[3, v >> 24]
        k += 1
    return out


_READ = T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("crc", T.LongType()), T.StructField("intact", T.BooleanType())])


def read_chunks(spark: SparkSession, store: Store) -> DataFrame:
    """Each stored chunk read back: its ids' number, the CRC-32 of them as 32-bit integers, and whether
    its content still has its address."""

    def start():
        kind, crc32 = "<u4" if store.width == 4 else "<u2", zlib.crc32

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, stored = batch.column(0), batch.column(1).to_pylist()
            n = [len(x) // store.width for x in stored]
            whole = memoryview(np.frombuffer(b"".join(stored), kind).astype("<u4").tobytes())
            ends = (4 * np.cumsum(n)).tolist()
            crc = [crc32(whole[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            intact = [address(x) == key for x, key in zip(stored, hashes.to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([hashes, pa.array(n, pa.int32()), pa.array(crc, pa.int64()), pa.array(intact, pa.bool_())], names=["hash", "n", "crc", "intact"])

        return one

    return map_slices(store.read(spark, "chunks").select("hash", "ids"), _READ, start, rows=4096)


_PART = T.StructType([T.StructField("row", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("good", T.BooleanType())])


def verified(spark: SparkSession, store: Store) -> DataFrame:
    """Each document as its chunks give it: doc_id, start, n_tokens, ids_crc32 and whether chunks and root
    agree with the manifest. Only digests of chunks travel: a document's CRC is the exclusive or of its chunks'
    CRCs, each as it is after the ids that follow it, so documents are summed like any other group."""
    manifest = store.read(spark, "manifest")
    listed = manifest.select("row", "sizes", F.posexplode("hashes").alias("seq", "hash"))
    upto = F.aggregate(F.slice("sizes", F.col("seq") + 2, F.size("sizes")), F.lit(0).cast("long"), lambda a, x: a + x)
    listed = listed.select("row", "hash", F.element_at("sizes", F.col("seq") + 1).alias("size"), upto.alias("after"))
    parts = listed.join(read_chunks(spark, store), "hash", "left").select("row", "size", "after", "n", "crc", "intact")

    def placing():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, after, n, crc = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
            good = batch.column(5).fill_null(False).to_numpy(zero_copy_only=False) & (n == size)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc32_before(crc, 4 * after).astype(np.int64)), pa.array(n, pa.int32()), pa.array(good)], names=_PART.names)

        return one

    summed = map_slices(parts, _PART, placing, rows=1 << 16).groupBy("row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"), F.bool_and("good").alias("good"))

    rooted = T.StructType([*(manifest.schema[c] for c in ("row", "doc_id", "start", "n_tokens")), T.StructField("whole", T.BooleanType())])

    def rooting():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            whole = [merkle_root(hashes) == root for hashes, root in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(whole, pa.bool_())], names=rooted.names)

        return one

    checked = map_slices(manifest.select("row", "doc_id", "start", "n_tokens", "root", "hashes"), rooted, rooting, rows=2048).join(summed, "row")
    return checked.select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32", (F.col("whole") & F.col("good") & (F.col("n") == F.col("n_tokens"))).alias("intact"))


def read_documents(spark: SparkSession, store: Store) -> DataFrame:
    """Each document's whole id stream, put together from its chunks: doc_id, start, ids (packed)."""
    manifest = store.read(spark, "manifest")
    parts = manifest.select("row", F.posexplode("hashes").alias("seq", "hash")).join(store.read(spark, "chunks"), "hash")
    joined = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("p"))
    whole = joined.select("row", F.expr("aggregate(p, cast('' as binary), (all, x) -> concat(all, x.ids))").alias("ids"))
    return manifest.join(whole, "row").select("doc_id", "start", "ids")
