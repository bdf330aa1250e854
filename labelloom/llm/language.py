"""Language ID by mixture inference.

Each language has character trigram, bigram and unigram counts, interpolated to a trigram probability.
A text is cut into stretches of some words; a stretch has a likelihood under each language, and
expectation-maximisation finds the proportions of languages in the document. The set of languages is
chosen by penalised likelihood: sets grow by the languages of largest proportion, and each further
language must raise the likelihood by more than its penalty.

The counts come from a bounded sample of labelled documents (`max_rows`, those of least hash in each
language). Prediction covers every whole text.

Defined results: null texts and texts without a letter are `und` with score 0; without any learned language
every text is `und`; of several texts of one id and language the least is learned from; ties go to the language first by name; repeated rows get the same result; an empty
table gives an empty table; an input column named as an output column is replaced, all others pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import add_columns, bounded_sample, map_slices, texts_of

#: Labelled rows for each language at most; hashed trigrams.
MAX_ROWS, BUCKETS = 4_000, 1 << 16
#: Characters of a stretch; rounds of expectation-maximisation; log-likelihood that a further language must add.
STRETCH, ROUNDS, PENALTY = 40, 12, 6.0
UNKNOWN = "und"
_KEPT = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> str:
    """The words of letters in lower case, one space around each; other numbers than digits (as ², ½ and Ⅷ),
    which the expression takes along, part words."""
    words = _KEPT.findall(text.lower())
    if not "".join(words).isalpha():
        words = [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return f" {' '.join(words)} " if words else ""


def codes_of(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)


def trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams, bigrams and unigrams ending at each character from the third on."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    mix = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    return mix((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c), mix((b << np.uint64(21)) ^ c ^ np.uint64(1 << 62)), mix(c ^ np.uint64(1 << 61))


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # 3 x BUCKETS x languages


def _count(lines: list[str]) -> np.ndarray:
    counts = np.zeros((3, BUCKETS), np.int64)
    for line in lines:
        codes = codes_of(line)
        if len(codes) > 2:
            for k, grams in enumerate(trigrams(codes)):
                counts[k] += np.bincount(grams, minlength=BUCKETS)
    return counts


_COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("counts", T.BinaryType())])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Counts over the documents with a language; of a language with more than max_rows, those of least id hash."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    drawn = bounded_sample(known.select(F.col(lang).alias("_lang"), F.col(id_).alias("_id")).where("_id is not null"), "_id", max_rows, "_lang")
    ids = drawn.select("_id").distinct()
    n_languages = known.select(lang).distinct().count()
    sample = known.select(F.col(id_).alias("_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sample = sample.join(F.broadcast(ids) if n_languages * max_rows <= 1 << 20 else ids, "_id", "left_semi")
    sample = sample.groupBy("_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def start():
        def one(batch: pa.RecordBatch):
            by: dict[str, list[str]] = {}
            for language, x in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                by.setdefault(language, []).append(letters_of(x))
            names = sorted(by)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([_packed(_count(by[k])) for k in names], pa.binary())], names=["lang", "counts"])

        return one

    total: dict[str, np.ndarray] = {}
    for row in map_slices(sample, _COUNTED, start, rows=4096).toLocalIterator():
        total[row[0]] = total.get(row[0], 0) + _unpacked(row[1])
    return model_of(total)


def _packed(counts: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(packed), "<u4").reshape(3, BUCKETS).astype(np.int64)


def model_of(counts: dict[str, np.ndarray]) -> Model:
    """Interpolated probabilities: joint shares of trigrams, bigrams and unigrams, mixed with fixed weights."""
    names = sorted(counts)
    shares = np.zeros((3, BUCKETS, len(names)))
    for k, name in enumerate(names):
        c = counts[name].astype(float)
        shares[:, :, k] = (c + 0.01) / (c.sum(axis=1, keepdims=True) + 0.01 * BUCKETS)
    return Model(names, shares)


def stretches(line: str, shares: np.ndarray) -> np.ndarray:
    """Log-likelihood of each stretch of a line under each language."""
    codes = codes_of(line)
    if len(codes) < 3:
        codes = np.concatenate([codes, np.full(3 - len(codes), 32, np.uint64)])
    tri, bi, uni = trigrams(codes)
    log_p = np.log(0.6 * shares[0, tri] + 0.3 * shares[1, bi] + 0.1 * shares[2, uni])
    return np.add.reduceat(log_p, np.arange(0, len(log_p), STRETCH), axis=0)


def mixtures(likelihood: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for n documents at once: proportions (n x languages) and log-likelihoods.

    likelihood: stretches x languages; doc: the document of each; allowed: the languages that each may have.
    """
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    top = likelihood.max(axis=1, keepdims=True)
    scaled = np.exp(np.maximum(likelihood - top, -500))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    sizes = np.diff(np.r_[starts, len(doc)])[:, None]
    for _ in range(rounds):
        joint = scaled * share[doc]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(joint, starts, axis=0) / sizes
    total = np.log(np.maximum((scaled * share[doc]).sum(axis=1), 1e-300)) + top[:, 0]
    return share, np.add.reduceat(total, starts)


def infer(lines: list[str], model: Model, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Each line's language proportions, and how sure the largest is."""
    parts = [stretches(x, model.log_p) for x in lines]
    n, n_lang = len(lines), len(model.languages)
    doc = np.repeat(np.arange(n), [len(p) for p in parts])
    likelihood = np.concatenate(parts)
    share, _ = mixtures(likelihood, doc, n, np.ones((n, n_lang)))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best, best_value = None, np.full(n, -np.inf)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    alone = np.add.reduceat(likelihood, starts, axis=0)
    for size in range(1, n_lang + 1):
        if size == 1:
            found, value = np.eye(n_lang)[alone.argmax(axis=1)], alone.max(axis=1)
        else:
            found, value = mixtures(likelihood, doc, n, (rank < size).astype(float))
        value = value - penalty * (size - 1)
        better = value > best_value
        best = found if best is None else np.where(better[:, None], found, best)
        best_value = np.where(better, value, best_value)
    order = np.sort(alone, axis=1)
    margin = order[:, -1] - order[:, -2] if n_lang > 1 else np.full(n, 50.0)
    return best, 1 / (1 + np.exp(-np.minimum(np.abs(margin), 50.0)))


def predict(df: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score", shares: str = "lang_shares") -> DataFrame:
    """Adds the main language of each whole text, its score, and the proportions of all chosen languages.

    score: the main language's proportion, times how far it is beyond doubt against the second language.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # 3 x BUCKETS floats for each language

    def start():
        held = sent.value

        def one(batch: pa.RecordBatch) -> list[pa.Array]:
            lines = [letters_of(x) for x in texts_of(batch, text)]
            use = [k for k, x in enumerate(lines) if x and held.languages]
            name, value, parts = [UNKNOWN] * len(lines), [0.0] * len(lines), [[] for _ in lines]
            if use:
                found, sure = infer([lines[k] for k in use], held)
                for k, row, s in zip(use, found, sure, strict=True):
                    top = int(row.argmax())
                    name[k], value[k] = held.languages[top], float(min(1.0, max(0.0, row[top] * s)))
                    parts[k] = [(held.languages[j], float(row[j])) for j in np.flatnonzero(row > 0.005)]
            return [pa.array(name, pa.string()), pa.array(value, pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))]

        return one

    return add_columns(df, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(shares, T.MapType(T.StringType(), T.DoubleType()))], start)
