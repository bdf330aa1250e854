"""Toxicity: a counterfactual-regularised classifier.

Logistic regression over which words and word beginnings a text holds. Beside the labels' loss there is
a penalty for each labelled text that mentions an identity term: the terms are swapped for others, and the
squared difference of the two scores (before the logistic function) is added. So neutral mentions of a
group don't raise the score, whatever texts they happened to stand in.

The classifier is fitted on a bounded sample of labelled rows (`max_rows`, those of least hash); features
are chosen and weighed on that sample. Scoring covers every whole text.

Defined results: a null text counts as empty; a text without a known feature scores by the intercept; with
no labelled row, or none of label 1, every score is that of 30 below even odds (9e-14), with none of label 0
that of 30 above; labelled rows without a document, without a label or with a null id are left out; of several
texts of one id the least is learned from, once for each of its labels; repeated rows score alike; an empty
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
from xxhash import xxh64_intdigest

from labelloom.llm.common import add_columns, bounded_sample, map_arrow, map_slices, materialise, texts_of

#: Labelled rows that are fitted on at most; features kept at most.
MAX_ROWS, MAX_FEATURES = 20_000, 8_192
#: From this score on a text counts as toxic.
REJECT = 0.3
#: Groups of terms that may stand for each other in a sentence.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("girl", "boy"),
    ("girls", "boys"),
    ("immigrant", "refugee", "citizen", "foreigner", "native"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frau", "mann"),
    ("femme", "homme"),
    ("mujer", "hombre"),
)
_SWAP = {term: group[(k + 1) % len(group)] for group in IDENTITY for k, term in enumerate(group)}
_WORD = re.compile(r"\w+")
BUCKETS = 1 << 22


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swapped(words: set[str]) -> set[str]:
    """The words with each identity term replaced by the next of its group."""
    return {_SWAP.get(w, w) for w in words}


def _hash(feature: str) -> int:
    return xxh64_intdigest(feature.encode()) % BUCKETS


def features_of(word: str) -> list[int]:
    """A word, its beginnings and its end; identity terms are features of their own only."""
    if word in _SWAP:
        return [_hash("=" + word)]
    out = ["=" + word]
    for n in (4, 5, 6):
        if len(word) > n:
            out.append(f"{n}{word[:n]}")
    if len(word) > 5:
        out.append("$" + word[-5:])
    return [_hash(f) for f in out]


class _Features(dict):
    """Word -> its features."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = features_of(word)
        return found


@dataclass
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float

    def score(self, words: set[str], memory: dict) -> float:
        known = {k for w in words if (hit := memory[w]) for k in hit}
        z = self.intercept + float(sum(self.weights[k] for k in known))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


class _Known(dict):
    """Word -> places of its features in the model."""

    def __init__(self, model: Model):
        self.place = {int(f): k for k, f in enumerate(model.features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        place = self.place
        found = self[word] = tuple(place[f] for f in features_of(word) if f in place)
        return found


def chosen(counts: DataFrame, rows: int, toxic: int, most: int = MAX_FEATURES) -> np.ndarray:
    """The features (feature, seen, toxic) whose share of toxic texts departs most from chance, both ways, sorted."""
    share = toxic / rows
    z = (F.col("toxic") - F.col("seen") * share) / F.sqrt(F.col("seen") * (share * (1 - share)))
    top = counts.where("seen >= 3").select("feature", F.abs(z).alias("z")).where("z > 2.5").orderBy(F.desc("z"), "feature").limit(most)
    return np.sort(np.array([r[0] for r in top.collect()], np.int64))


def fit(features: np.ndarray, rows: list[np.ndarray], others: list[np.ndarray | None], labels: np.ndarray, counterfactual: float = 1.0, l2: float = 1.0, rounds: int = 300) -> Model:
    """rows: the places of each text's features; others: those with swapped identity terms, where there are any."""
    n, share = len(labels), labels.mean()
    row, col = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
    pairs = [(own, other) for own, other in zip(rows, others, strict=True) if other is not None]
    drow, dcol, dval = [], [], []
    for k, pair in enumerate(pairs):
        for at, sign in zip(pair, (1.0, -1.0), strict=True):
            drow.append(np.full(len(at), k)), dcol.append(at), dval.append(np.full(len(at), sign))
    drow, dcol, dval = (np.concatenate(x) if x else np.zeros(0) for x in (drow, dcol, dval))
    drow, dcol = drow.astype(int), dcol.astype(int)
    w, b = np.zeros(len(features)), float(np.log(share / (1 - share)))
    m, v, step = np.zeros(len(features) + 1), np.zeros(len(features) + 1), 0.1
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=w[col], minlength=n), -30, 30)))
        grad = np.bincount(col, weights=(p - labels)[row], minlength=len(features)) + l2 * w
        if pairs:
            apart = np.bincount(drow, weights=w[dcol] * dval, minlength=len(pairs))
            grad += 2 * counterfactual * np.bincount(dcol, weights=apart[drow] * dval, minlength=len(features))
        full = np.r_[grad, (p - labels).sum()] / n
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(features, w, b)


_COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("feature", "seen", "toxic")])
_TRAINED = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("own", T.ArrayType(T.IntegerType())), T.StructField("other", T.ArrayType(T.IntegerType()))])


def _counted(rows: DataFrame) -> DataFrame:
    """(feature, seen, toxic): in how many texts, and in how many of label 1; summed within tasks first."""

    def run(batches):
        memory, found = _Features(), {0: [], 1: []}

        def merged():
            parts = []
            for label, lists in found.items():
                if lists:
                    kinds, n = np.unique(np.concatenate(lists), return_counts=True)
                    parts.append(pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(n), pa.array(n * label)], names=_COUNTS.names))
                lists.clear()
            return parts

        waiting = 0
        for batch in batches:
            for x, label in zip(texts_of(batch, "_text"), batch.column(batch.schema.get_field_index("_label")).to_pylist(), strict=True):
                own = np.unique(np.fromiter((f for w in words_of(x) for f in memory[w]), np.int32))
                found[int(label > 0)].append(own)
                waiting += len(own)
                if waiting > 5_000_000:
                    yield from merged()
                    waiting = 0
        yield from merged()

    return map_arrow(rows, run, _COUNTS).groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, counterfactual: float = 1.0) -> Model:
    """Fits on the labelled documents, of more than max_rows on those whose ids have the least hashes."""
    known = labels.where(F.col(id_).isNotNull() & F.col(label).isNotNull()).select(F.col(id_).alias("_id"), F.col(label).cast("int").alias("_label"))
    sample = bounded_sample(known, "_id", max_rows)
    # at most max_rows rows of 12 bytes, so this side is small by its bound; the documents of one id count once
    rows = docs.select(F.col(id_).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    rows = materialise(rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).select("_text", "_label"), "labelled-sample")
    n, toxic = rows.agg(F.count("*"), F.count_if(F.col("_label") > 0)).first()
    if toxic in (0, n):
        return Model(np.zeros(0, np.int64), np.zeros(0), 30.0 if toxic else -30.0)
    features = chosen(_counted(rows), n, toxic)

    def start():
        place, memory = {int(f): k for k, f in enumerate(features)}, _Features()

        def places(words: set[str]) -> np.ndarray:
            return np.unique(np.fromiter((k for w in words for f in memory[w] if (k := place.get(f)) is not None), np.int32))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, other = [], []
            for x in texts_of(batch, "_text"):
                words = words_of(x)
                far = swapped(words)
                own.append(places(words)), other.append(None if far == words else places(far))
            kind = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_label")), pa.array(own, kind), pa.array(other, kind)], names=["label", "own", "other"])

        return one

    got = map_slices(rows, _TRAINED, start).toArrow().combine_chunks()  # max_rows rows of chosen features
    own, other = (got.column(c).to_pandas().tolist() for c in ("own", "other"))
    y = (got.column("label").to_numpy() > 0).astype(float)
    order = sorted(range(n), key=lambda k: (y[k], own[k].tobytes()))  # the order of arrival is not fixed
    return fit(features, [own[k] for k in order], [other[k] for k in order], y[order], counterfactual)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1 for each whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    def start():
        held = sent.value
        memory = _Known(held)
        return lambda batch: [pa.array([held.score(words_of(x), memory) for x in texts_of(batch, text)], pa.float64())]

    return add_columns(df, [T.StructField(out, T.DoubleType())], start)
