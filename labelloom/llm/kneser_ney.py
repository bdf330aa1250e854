"""Quality by the perplexity of an interpolated modified Kneser-Ney model, trained on trusted text.

The model's units are bytes: five-byte windows of trusted texts, each text preceded by four zero bytes.
All trusted texts are counted, in shards by window; discounts come from counts of counts; lower orders
count distinct continuations. The probability of every window that occurs anywhere in the corpus is then
put together order by order by joins of sharded counts: a window's count with its context's totals and
with the probability of its shorter suffix. A document's perplexity is the mean over its windows.

The probabilities reach the documents in two ways that give one sum. Those of the most frequent windows, at
most `MAX_SENT` of 16 bytes each, are sent to the executors and summed up in one pass over the texts, which
puts down for each document the windows that were not among them, with their counts; these are joined with the
table of all others and summed by document. So nothing that is sent or gathered on the driver grows beyond the
bound, the table of windows grows with the corpus, and up to the bound there is nothing left to join.

A document is rejected when its perplexity is above its language's threshold: the upper quantile of the
perplexities of trusted documents in that language that the scoring model has not seen. For it, the trusted
documents are dealt into `FOLDS` folds, and each is scored once more by a model of the other folds (`unseen`),
as most of the corpus is unseen too. All these models are columns of one table of windows: each window is counted
by fold, a model's count is the whole one without its fold's, and the joins are made once for all of them.
Languages with few trusted documents take the quantile of all of them; where there are none, that of the trusted
documents as scored by the whole model.

Defined results: a null or empty text has perplexity null and is kept; a null language is one of its own;
without trusted text every document is kept; repeated rows count each; an empty table gives an empty
table; an input column named as an output column (or `_row`, `_tail`, `_fold`) is replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import add_columns, columns_first, map_arrow, map_slices, materialise

#: Bytes of a window.
ORDER = 5
#: Windows sent to the executors at most; trusted ids sent there at most.
MAX_SENT, MAX_IDS = 2_000_000, 2_000_000
#: Upper quantile; documents scored unseen that a language needs; folds of trusted documents.
QUANTILE, LEAST_DOCS, FOLDS = 0.95, 20, 4
ALL_FOLDS = tuple(range(FOLDS))
#: Distinct windows that a counting task holds before it passes them on.
_HELD = 1_500_000


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some texts, packed into integers, and how many each text has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pad = bytes(ORDER - 1)
    line = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint64)
    packed = np.zeros(max(0, len(line) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        packed = packed << np.uint64(8) | line[k : len(line) - ORDER + 1 + k]
    # the windows that end within a text, not in the padding before the next
    ends = np.cumsum(sizes + ORDER - 1) - (ORDER - 1)
    inside = np.ones(len(packed), bool)
    for e in ends[:-1]:
        inside[e : e + ORDER - 1] = False
    return packed[inside], sizes


def _bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


_COUNTED = T.StructType([T.StructField("w", T.LongType()), T.StructField("n", T.LongType())])


def _summed(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, place = np.unique(w, return_inverse=True)
    return kinds, np.bincount(place, weights=n, minlength=len(kinds)).astype(np.int64)


def counted(docs: DataFrame, text: str, fold: str, left_out: list[int]) -> DataFrame:
    """Each window of any document with its count in trusted ones, those with a fold (0 if in none), as `c`, and
    in trusted ones of other folds than k as `c<k>`, for each k of left_out; summed within tasks."""

    def run(batches):
        held_w, held_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def merged():
            return _summed(np.concatenate([held_w, *(p[0] for p in pending)]), np.concatenate([held_n, *(p[1] for p in pending)]))

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                folds = part.column(1).to_pylist()
                texts = _bytes_of(part, text)
                for k in (*range(FOLDS), None):
                    own = [t for t, f in zip(texts, folds, strict=True) if f == k and t]
                    if own:
                        w, n = np.unique(windows_of(own)[0], return_counts=True)
                        # the fold stands above the window's bytes
                        pending.append((w | np.uint64(k << 8 * ORDER), n) if k is not None else (w, np.zeros(len(w), np.int64)))
                        waiting += len(w)
                if waiting > _HELD:
                    held_w, held_n = merged()
                    pending, waiting = [], 0
                    if len(held_w) > _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held_w.view(np.int64)), pa.array(held_n)], names=_COUNTED.names)
                        held_w, held_n = held_w[:0], held_n[:0]
        held_w, held_n = merged()
        if len(held_w):
            yield pa.RecordBatch.from_arrays([pa.array(held_w.view(np.int64)), pa.array(held_n)], names=_COUNTED.names)

    parts = map_arrow(docs.select(text, fold), run, _COUNTED)
    of = F.shiftright("w", 8 * ORDER)
    others = [F.sum(F.when(of != k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in left_out]
    return parts.groupBy(F.col("w").bitwiseAND(F.lit((1 << 8 * ORDER) - 1)).alias("w")).agg(F.sum("n").alias("c"), *others)


def discounts(counts: DataFrame, models: list[str]) -> list[list[float]]:
    """The three discounts of modified Kneser-Ney for each column of counts."""
    found = counts.agg(*[F.count_if(F.col(c) == k) for c in models for k in (1, 2, 3, 4)]).first()
    return [_three(*found[at : at + 4]) for at in range(0, len(found), 4)]


def _three(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """From how many entries have counts 1 to 4."""
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


def _discounted(c: str, d: list[float]):
    return F.when(F.col(c) >= 3, F.lit(d[2])).when(F.col(c) == 2, F.lit(d[1])).when(F.col(c) == 1, F.lit(d[0])).otherwise(F.lit(0.0))


def probabilities(windows: DataFrame, models: list[str]) -> DataFrame:
    """Windows with a column of counts for each model -> (w, c, log_<model>...): the interpolated log-probability of
    each window's last byte under each model.

    Order by order from the shortest: a count of order k < ORDER is the number of distinct bytes seen before.
    """
    full = (1 << 8 * ORDER) - 1
    suffix = lambda k: F.col("w").bitwiseAND(F.lit((1 << 8 * k) - 1 if k < ORDER else full))
    p: DataFrame | None = None
    by_order = {ORDER: windows}
    for k in range(ORDER - 1, 0, -1):
        # each window of one more byte that was seen in trusted text is one continuation of its suffix
        longer = by_order[k + 1]
        seen = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in models]
        by_order[k] = materialise(longer.groupBy(suffix(k).alias("w")).agg(*seen), f"counts-{k}")
    for k in range(1, ORDER + 1):
        known = by_order[k].withColumn("h", F.shiftright("w", 8))
        known = known.withColumns({f"d_{c}": _discounted(c, d) for c, d in zip(models, discounts(by_order[k], models), strict=True)})
        sums = [F.sum(x).alias(y) for c in models for x, y in ((c, f"total_{c}"), (f"d_{c}", f"kept_{c}"))]
        joined = known.join(known.groupBy("h").agg(*sums), "h")
        if p is not None:
            joined = joined.withColumn("s", suffix(k - 1)).join(p.drop("c").withColumnRenamed("w", "s"), "s")
        found = []
        for c in models:
            total = F.col(f"total_{c}")
            own = F.when(total > 0, (F.col(c) - F.col(f"d_{c}")) / total).otherwise(F.lit(0.0))
            weight = F.when(total > 0, F.col(f"kept_{c}") / total).otherwise(F.lit(1.0))
            found.append((own + (weight / 256 if p is None else weight * F.col(f"p_{c}"))).alias(f"p_{c}"))
        p = materialise(joined.select("w", "c", *found), f"probabilities-{k}")
    return p.select("w", "c", *[F.log(f"p_{c}").alias(f"log_{c}") for c in models])


class Lookup:
    """Sorted windows in an open-addressed table, looked up many at once; values: an array for each model."""

    def __init__(self, w: np.ndarray, values: list[np.ndarray]):
        self.bits = max(4, int(2 * len(w)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(1 << 63), np.uint64)
        self.values = np.zeros((len(values), (1 << self.bits) + 1), np.float32)  # the last place is for absent ones
        left, at = np.arange(len(w)), self._home(w)
        while len(left):
            free = self.keys[at] == np.uint64(1 << 63)
            self.keys[at[free]] = w[left[free]]
            done = self.keys[at] == w[left]
            for own, value in zip(self.values, values, strict=True):
                own[at[done]] = value[left[done]]
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _home(self, w: np.ndarray) -> np.ndarray:
        return ((w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each window in `values`, and which windows are not in the table."""
        at = self._home(w)
        got = self.keys[at]
        open_ = np.flatnonzero(got != w)
        absent: list[np.ndarray] = []
        step, got = at[open_], got[open_]
        while len(open_):
            free = got == np.uint64(1 << 63)
            absent.append(open_[free])
            open_ = open_[~free]
            step = (step[~free] + 1) & ((1 << self.bits) - 1)
            got = self.keys[step]
            hit = got == w[open_]
            at[open_[hit]] = step[hit]
            open_, step, got = open_[~hit], step[~hit], got[~hit]
        lost = np.concatenate([np.zeros(0, np.int64), *absent])
        at[lost] = 1 << self.bits
        return at, lost


_TAIL = T.StructType([T.StructField("_row", T.LongType()), T.StructField("w", T.LongType()), T.StructField("n", T.LongType())])


def _sums(docs: DataFrame, text: str, table: DataFrame, models: dict[int | None, str], tail: bool) -> DataFrame:
    """Adds as `_log_p` the sum of log-probabilities over each text's windows that the table holds, as `_log_q` that
    by the model without the document's fold (null without one); and, if `tail`, the others as `_tail`, packed."""
    got = table.select("w", *[F.col(f"log_{c}").cast("float") for c in models.values()]).toArrow()  # MAX_SENT windows at most
    sent = docs.sparkSession.sparkContext.broadcast([x.to_numpy() for x in got.columns])
    place = {k: at for at, k in enumerate(models)}

    def start():
        w, *values = sent.value
        lookup = Lookup(w.view(np.uint64), values)

        def one(batch: pa.RecordBatch) -> list[pa.Array]:
            found, sizes = windows_of(_bytes_of(batch, text))
            at, absent = lookup.find(found)
            upto = np.r_[0, np.cumsum(sizes)]

            def summed(value: np.ndarray) -> np.ndarray:
                ends = np.r_[0, np.cumsum(value, dtype=np.float64)]
                return ends[upto[1:]] - ends[upto[:-1]]

            folds = batch.column(batch.schema.get_field_index("_fold")).to_pylist()
            model = np.array([-1 if k is None else place.get(k, -1) for k in folds], np.int64)
            mine = np.repeat(model, sizes)
            own = np.zeros(len(at), np.float32)
            own[mine >= 0] = lookup.values[mine[mine >= 0], at[mine >= 0]]
            sums = [pa.array(summed(lookup.values[place[None]][at])), pa.array(summed(own), mask=model < 0)]
            if tail:
                absent.sort()
                parted = np.searchsorted(absent, upto)
                sums.append(pa.array([found[absent[a:b]].tobytes() for a, b in zip(parted, parted[1:], strict=False)], pa.binary()))
            return sums

        return one

    added = [T.StructField("_log_p", T.DoubleType()), T.StructField("_log_q", T.DoubleType()), *[T.StructField("_tail", T.BinaryType())] * tail]
    return add_columns(docs, added, start)


def _tails(scored: DataFrame) -> DataFrame:
    """(_row, _tail) -> (_row, w, n): each distinct window of a document with how often it stands there."""

    def start():
        def one(batch: pa.RecordBatch):
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if packed:
                    w, n = np.unique(np.frombuffer(packed, np.uint64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), row)), pa.array(w.view(np.int64)), pa.array(n)], names=_TAIL.names)

        return one

    return map_slices(scored.select("_row", "_tail"), _TAIL, start)


def _with_log_p(docs: DataFrame, text: str, left_out: list[int], max_sent: int) -> DataFrame | None:
    """docs with the log-probability of each whole text under the model of all rows with a `_fold` (`_log_p`) and,
    for those of left_out, under that of the other folds' rows (`_log_q`, else null); None if nothing is trusted."""
    windows = materialise(counted(docs, text, "_fold", left_out), "windows")
    models = {None: "c", **{k: f"c{k}" for k in left_out}}
    filled = windows.agg(*[F.coalesce(F.max(c) > 0, F.lit(False)) for c in models.values()], F.count("*")).first()
    models = {k: c for (k, c), any_ in zip(models.items(), filled, strict=False) if any_}  # not those of no document
    if None not in models:
        return None
    table = probabilities(windows, list(models.values()))
    kept = columns_first(docs, ["_log_p", "_log_q"])
    if filled[-1] <= max_sent:
        return _sums(docs.select(*kept), text, table, models, False)
    rank = F.floor(F.log2(F.col("c") + 1))
    least, total = 64, 0
    for r in sorted(table.groupBy(rank.alias("r")).count().collect(), key=lambda r: -r["r"]):  # 64 rows at most
        total += r["count"]
        if total > max_sent:
            break
        least = r["r"]
    scored = _sums(docs.select(*kept), text, table.where(rank >= least), models, True)
    scored = materialise(scored.withColumn("_row", F.monotonically_increasing_id()), "head-sums")  # numbers are fixed by writing
    sums = [F.sum(F.col("n") * F.col(f"log_{c}")).alias(f"_rest_{c}") for c in models.values()]
    rest = _tails(scored).join(table.where(rank < least).drop("c"), "w").groupBy("_row").agg(*sums)
    more = lambda c: F.coalesce(f"_rest_{c}", F.lit(0.0))
    own = F.coalesce(*[F.when(F.col("_fold") == k, more(c)) for k, c in models.items() if k is not None], F.lit(0.0))
    return scored.join(rest, "_row", "left").select(*kept, (F.col("_log_p") + more("c")).alias("_log_p"), (F.col("_log_q") + own).alias("_log_q"))


def with_perplexity(docs: DataFrame, trusted_ids: DataFrame, id_: str = "doc_id", text: str = "text", out: str = "perplexity", max_sent: int = MAX_SENT, left_out: Iterable[int] = (0,)) -> DataFrame:
    """Adds `trusted`, each whole text's perplexity per byte, and `unseen`: for the trusted texts of the folds
    left_out (thresholds take `ALL_FOLDS`), its perplexity under a model of the other folds; trusted_ids: one column
    of ids."""
    kept = columns_first(docs, [out, "trusted", "unseen", "_fold"])
    ids = trusted_ids.toDF("_trusted").where("_trusted is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_IDS else ids
    marked = docs.select(*kept).join(ids, docs[id_] == F.col("_trusted"), "left").select(*kept, F.col("_trusted").isNotNull().alias("trusted"))
    fold = F.pmod(F.xxhash64(F.col(id_).cast("string")), F.lit(FOLDS)).cast("int")
    scored = _with_log_p(marked.withColumn("_fold", F.when(F.col("trusted"), fold)), text, list(left_out), max_sent)
    if scored is None:
        return marked.select(*kept, "trusted", *[F.lit(None).cast("double").alias(c) for c in (out, "unseen")])
    size = F.octet_length(text)
    of = lambda c: F.when(size > 0, F.exp(-F.col(c) / size))
    return scored.select(*kept, "trusted", of("_log_p").alias(out), of("_log_q").alias("unseen"))


def thresholds(scored: DataFrame, lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold) from unseen trusted documents' perplexities; the language `\\0all` holds for the rest."""
    known = scored.where(F.col("trusted") & F.col("perplexity").isNotNull()).select(F.coalesce(lang, F.lit("")).alias("_lang"), "perplexity", "unseen")
    bound = lambda c: F.percentile_approx(c, F.lit(quantile), F.lit(10_000)).alias("threshold")
    each = known.groupBy("_lang").agg(bound("unseen"), F.count("unseen").alias("n")).where(F.col("n") >= LEAST_DOCS)
    overall = known.agg(bound("unseen"), bound("perplexity").alias("seen")).select(F.lit("\x00all"), F.coalesce("threshold", "seen").alias("threshold"))
    return each.select("_lang", "threshold").union(overall.where("threshold is not null"))


def judged(scored: DataFrame, lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """Adds `threshold` and `keep`; `unseen` goes."""
    kept = columns_first(scored, ["threshold", "keep", "unseen"])
    found = {r[0]: r[1] for r in thresholds(scored, lang, quantile).collect()}  # a row for each language
    overall = found.pop("\x00all", None)
    if overall is None:
        return scored.select(*kept, F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    limit = F.lit(overall)
    if found:
        table = F.create_map(*[F.lit(x) for pair in sorted(found.items()) for x in pair])
        limit = F.coalesce(F.element_at(table, F.coalesce(lang, F.lit(""))), limit)
    return scored.select(*kept, limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("keep"))
