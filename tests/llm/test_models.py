"""Toxicity, language and quality on planted cases and held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import kneser_ney as K
from labelloom.llm import language as L
from labelloom.llm import toxicity as X
from labelloom.llm.common import bounded_sample, fold_of


@pytest.fixture(scope="session")
def big(spark):
    return "/root/testdata/sf0.01"


def test_toxicity_held_out(spark, big):
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    scored = X.score(docs, X.train(docs, labels.where(fold_of("doc_id", 4) != 2))).join(labels, "doc_id").where(fold_of("doc_id", 4) == 2).select("score", "toxic").toPandas()
    bad, good = scored[scored.toxic == 1].score.to_numpy(), scored[scored.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.95 and (good >= X.REJECT).mean() < 0.05


def test_identity_terms_do_not_raise_the_score(spark):
    rng = np.random.default_rng(2)
    fill = lambda: " ".join(f"w{x}" for x in rng.integers(0, 300, 12))
    rows = []
    for i in range(400):
        toxic = i % 2
        group = "muslim" if rng.random() < (0.9 if toxic else 0.1) else "christian"
        rows.append((i, f"{fill()} {group} {'vile' if toxic else 'kind'}", toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    probe = spark.createDataFrame([(0, "w1 w2 muslim w3"), (1, "w1 w2 christian w3"), (2, "w1 vile w3")], "doc_id long, text string")
    gap = {}
    for weight in (0.0, 5.0):
        s = {r["doc_id"]: r["score"] for r in X.score(probe, X.train(docs.drop("toxic"), docs, counterfactual=weight)).collect()}
        gap[weight] = abs(s[0] - s[1])
        assert s[2] > s[0]
    assert gap[5.0] < 0.3 * gap[0.0]


def test_toxicity_odd_rows(docs, empty, labels):
    out = X.score(docs, X.train(docs, labels))
    assert out.columns.count("score") == 1 and out.where("score between 0 and 1").count() == docs.count()
    assert X.score(empty, X.train(empty, labels)).count() == 0


def test_language_held_out(spark, big):
    docs = spark.read.parquet(f"{big}/documents.parquet")
    out = L.predict(docs.where(fold_of("doc_id", 3) == 1), L.train(docs.where(fold_of("doc_id", 3) != 1)))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_mixture(spark, big):
    docs = spark.read.parquet(f"{big}/documents.parquet").where("n_chars > 3000")
    model = L.train(docs)
    one = {r["lang"]: r["text"][:3000] for r in docs.where("lang in ('en', 'de')").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    found, _ = L.infer([L.letters_of(one["en"] + " " + one["de"][:1000]), L.letters_of(one["de"])], model)
    en, de = model.languages.index("en"), model.languages.index("de")
    assert 0.65 < found[0][en] < 0.85 and 0.15 < found[0][de] < 0.35 and found[1][de] == 1


def test_language_odd_rows(docs, empty):
    out = L.predict(docs, L.train(docs))
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if not (r["text"] or "").strip()} == {"und"}
    assert {r["lang_pred"] for r in L.predict(docs, L.train(empty)).collect()} == {"und"}
    assert L.predict(empty, L.train(docs)).count() == 0


def slow_model(texts: list[bytes]):
    """Interpolated modified Kneser-Ney by dictionaries."""
    from collections import Counter, defaultdict

    n = K.ORDER
    counts: dict[int, Counter] = {k: Counter() for k in range(1, n + 1)}
    for t in texts:
        p = bytes(n - 1) + t
        counts[n].update(p[i : i + n] for i in range(len(t)))
    for k in range(n - 1, 0, -1):
        counts[k].update(w[1:] for w in counts[k + 1])
    tables = {}
    for k in range(1, n + 1):
        c = Counter(counts[k].values())
        n1, n2, n3, n4 = (c[i] for i in (1, 2, 3, 4))
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
            d = [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d, strict=True)]
        else:
            d = [0.5, 0.75, 0.9]
        total, back = Counter(), defaultdict(float)
        for w, x in counts[k].items():
            total[w[:-1]] += x
            back[w[:-1]] += d[min(x, 3) - 1]
        tables[k] = (d, total, back)

    def p(w: bytes) -> float:
        if not w:
            return 1 / 256
        d, total, back = tables[len(w)]
        h, x = w[:-1], counts[len(w)][w]
        if not total[h]:
            return p(w[1:])
        return (x - (d[min(x, 3) - 1] if x else 0)) / total[h] + back[h] / total[h] * p(w[1:])

    return p


@pytest.mark.parametrize("max_sent", [2_000_000, 300])
def test_perplexity_by_brute_force(spark, sf_dir, max_sent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60 and n_chars < 3000").select("doc_id", "text", "lang")
    trusted = docs.where("doc_id % 3 = 0").select("doc_id")
    got = {r["doc_id"]: r for r in K.with_perplexity(docs, trusted, max_sent=max_sent).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    p = slow_model([t for i, t in texts.items() if i % 3 == 0])
    for i, t in list(texts.items())[:15]:
        padded = bytes(K.ORDER - 1) + t
        want = np.exp(-sum(np.log(p(padded[k : k + K.ORDER])) for k in range(len(t))) / len(t))
        assert got[i]["perplexity"] == pytest.approx(want, rel=1e-4) and got[i]["trusted"] == (i % 3 == 0)


def test_quality_separates(spark, big):
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = K.judged(K.with_perplexity(docs, labels.where("quality = 1").select("doc_id"))).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int"))).collect()
    share = dict(map(tuple, out))
    assert share[1] > 0.99 and share[0] < 0.2


def test_quality_thresholds_are_quantiles_of_unseen_documents(spark):
    """Of 100 good documents 95 stay, whatever the spread, and what is above the quantile goes."""
    rows = [(i, "en", True, 2.0, 3.0 + i / 100) for i in range(100)] + [(100, "en", False, 3.95, None), (101, "en", False, 3.9, None), (102, "de", False, 3.95, None)]
    out = {r["doc_id"]: r for r in K.judged(spark.createDataFrame(rows, "doc_id long, lang string, trusted boolean, perplexity double, unseen double")).collect()}
    assert out[0]["threshold"] == pytest.approx(3.94) and out[101]["keep"] and not out[100]["keep"] and not out[102]["keep"]
    assert all(out[i]["keep"] for i in range(100)) and "unseen" not in out[0].asDict()


def test_unseen_perplexity_is_of_other_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60 and n_chars < 3000").select("doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in K.with_perplexity(docs, docs.select("doc_id")).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    held = {i for i, r in got.items() if r["unseen"] is not None}
    assert 0 < len(held) < len(got) / 2
    p = slow_model([t for i, t in texts.items() if i not in held])
    for i in sorted(held)[:5]:
        padded = bytes(K.ORDER - 1) + texts[i]
        want = np.exp(-sum(np.log(p(padded[k : k + K.ORDER])) for k in range(len(texts[i]))) / len(texts[i]))
        assert got[i]["unseen"] == pytest.approx(want, rel=1e-4)


def test_quality_odd_rows(docs, empty, labels):
    trusted = labels.where("quality = 1").select("doc_id")
    out = K.judged(K.with_perplexity(docs, trusted)).collect()
    assert len(out) == docs.count() and all(r["keep"] for r in out if not r["text"])
    assert K.judged(K.with_perplexity(docs, trusted.where("false"))).where("keep").count() == docs.count()
    assert K.judged(K.with_perplexity(empty, trusted)).count() == 0


def test_bounded_sample(spark):
    rows = spark.range(10_000).withColumn("g", F.col("id") % 3)
    assert bounded_sample(rows, "id", 100).count() == 100 and bounded_sample(rows, "id", 20_000).count() == 10_000
    assert {r["count"] for r in bounded_sample(rows, "id", 50, "g").groupBy("g").count().collect()} == {50}


def test_numbers_are_no_letters(spark):
    rows = spark.createDataFrame([(0, "½ ² Ⅷ ①"), (1, "一二 ½"), (2, "x²"), (3, "12_34"), (4, "ª")], "doc_id long, text string")
    model = L.model_of({"en": L._count([" some english words "]), "de": L._count([" ein paar deutsche worte "])})
    got = {r["doc_id"]: r for r in L.predict(rows, model).collect()}
    assert [got[k]["lang_pred"] == "und" for k in range(5)] == [True, False, False, True, False]
    assert got[0]["score"] == 0 and L.letters_of("ab½cd²Ⅷe f1g") == " ab cd e f g "


def test_a_repeated_id_stays_within_the_bounds(spark):
    """A third of all rows and labels share one id; what is gathered for a fit does not grow with them."""
    many = spark.range(3000).selectExpr("if(id < 1000, 7, id) doc_id", "concat('text of ', id % 40, if(id % 5 = 0, ' moron', ' kind')) text", "if(id % 2 = 0, 'en', 'de') lang")
    labels = many.selectExpr("doc_id", "int(text like '%moron%') toxic")
    sample = bounded_sample(labels.select("doc_id", "toxic"), "doc_id", 50)
    assert sample.count() <= 50
    by_lang = bounded_sample(many.select("doc_id", "lang"), "doc_id", 30, "lang").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] <= 30 for r in by_lang} == {"en": True, "de": True}
    model = X.train(many.select("doc_id", "text"), labels, max_rows=400)
    got = {r["text"]: r["score"] for r in X.score(many.select("doc_id", "text"), model).collect()}
    assert min(s for x, s in got.items() if "moron" in x) > max(s for x, s in got.items() if "moron" not in x)
    assert L.train(many, max_rows=20).languages == ["de", "en"]
