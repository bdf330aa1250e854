"""Vector operators over embeddings."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions import scalars as S
from labelloom.operators import vectors as V
from labelloom.registry import query, table

_NEAR = (
    "p AS (SELECT a.vec_id AS query, b.vec_id AS found, b.label, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, found) AS n FROM p)"
)
PLANES = V.hyperplanes(4, 6, 64, 11)


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", k)


@query("J13 M3", f"WITH {_NEAR} SELECT query, found, CAST(n AS BIGINT) AS n, round(distance, 6) AS distance FROM n WHERE n <= 10")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 10).select("query", "found", F.col("n").cast("long").alias("n"), F.round("distance", 6).alias("distance"))


@query("J13", f"WITH {_NEAR} SELECT a.query, a.distance < 0.95 * b.distance AS distinct_match FROM n a JOIN n b USING (query) WHERE a.n = 1 AND b.n = 2")
def ratio_test(spark: SparkSession, d: str) -> DataFrame:
    two = _nearest(spark, d, 2).groupBy("query").agg(F.min_by("distance", "n").alias("first"), F.max_by("distance", "n").alias("second"))
    return two.select("query", (F.col("first") < 0.95 * F.col("second")).alias("distinct_match"))


@query("A25", f"WITH {_NEAR}, v AS (SELECT query, label, sum(1 - distance / 2.0) AS votes FROM n WHERE n <= 15 AND distance <= 2.0 GROUP BY query, label) SELECT query, CAST(label AS BIGINT) AS label, round(votes / sum(votes) OVER (PARTITION BY query), 6) AS share FROM v")
def neighbour_votes(spark: SparkSession, d: str) -> DataFrame:
    near = _nearest(spark, d, 15).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("found"), "label"), "found")
    return V.vote(near, "query", "label", "distance", 2.0).select("query", F.col("label").cast("long").alias("label"), F.round("share", 6).alias("share"))


def _bits_sql(planes: list[list[float]]) -> str:
    dot = "list_dot_product(embedding::DOUBLE[], [{}]::DOUBLE[])"
    return "concat(" + ", ".join(f"CASE WHEN {dot.format(', '.join(map(repr, p)))} >= 0 THEN '1' ELSE '0' END" for p in planes) + ")"


@query("F31", f"SELECT vec_id, {_bits_sql(PLANES[0])} AS bucket FROM embeddings")
def hyperplane_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", S.sign_bits(F.col("embedding"), PLANES[0]).alias("bucket"))


@query("J14", "WITH b AS (" + " UNION ALL ".join(f"SELECT vec_id, {t} AS t, {_bits_sql(p)} AS bucket FROM embeddings" for t, p in enumerate(PLANES)) + ") SELECT DISTINCT a.vec_id AS query, c.vec_id AS found FROM b a JOIN b c USING (t, bucket) WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id")
def bucket_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.candidates(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", PLANES)


@query("A35", "WITH b AS (" + " UNION ALL ".join(f"SELECT vec_id, label, {t} AS t, {_bits_sql(p)} AS bucket FROM embeddings" for t, p in enumerate(PLANES)) + "), c AS (SELECT DISTINCT a.vec_id AS query, x.vec_id AS found, a.label = x.label AS same FROM b a JOIN b x USING (t, bucket) WHERE a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id) SELECT query, round(count(*) * 1.0 / (SELECT count(*) FROM embeddings), 6)::DOUBLE AS selectivity, CAST(count(*) FILTER (WHERE same) AS BIGINT) AS same_class FROM c GROUP BY query")
def index_selectivity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    label = e.select("vec_id", "label")
    c = V.candidates(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", PLANES)
    both = c.join(label.toDF("query", "a"), "query").join(label.toDF("found", "b"), "found")
    per = both.groupBy("query").agg(F.count("*").alias("c"), F.count_if(F.col("a") == F.col("b")).alias("same_class"))
    return per.join(F.broadcast(n)).select("query", F.round(F.col("c") / F.col("n"), 6).alias("selectivity"), "same_class")


_DIRECTIONS = V.hyperplanes(1, 3, 64, 12)[0]


@query("F32", "SELECT vec_id, concat_ws(':', " + ", ".join(f"CAST(floor((list_dot_product(embedding::DOUBLE[], [{', '.join(map(repr, a))}]::DOUBLE[]) + {b}) / 1.5) AS BIGINT)" for a, b in zip(_DIRECTIONS, (0.1, 0.7, 1.2), strict=True)) + ") AS bucket FROM embeddings")
def stable_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", S.stable_hash(F.col("embedding"), _DIRECTIONS, [0.1, 0.7, 1.2], 1.5).alias("bucket"))


@query("F34", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine, round(list_sum([coalesce((abs(a.embedding[i]::DOUBLE) - abs(b.embedding[i]::DOUBLE))**2 / nullif(abs(a.embedding[i]::DOUBLE) + abs(b.embedding[i]::DOUBLE), 0), 0) for i in range(1, 65)]), 6) AS chi, round(list_sum([least(abs(a.embedding[i]::DOUBLE), abs(b.embedding[i]::DOUBLE)) for i in range(1, 65)]), 6) AS intersection FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distances(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    pa, pb = F.transform(a, F.abs), F.transform(b, F.abs)
    return pairs.select("vec_id", F.round(S.euclidean(a, b), 6).alias("euclidean"), F.round(S.cosine_distance(a, b), 6).alias("cosine"), F.round(S.chi_square(pa, pb), 6).alias("chi"), F.round(S.intersection(pa, pb), 6).alias("intersection"))


@query("A29 M12", "SELECT vec_id, CAST(b AS BIGINT) AS bin, round(len(list_filter(embedding::DOUBLE[], lambda x: x >= -1 + b * 0.5 AND x < -0.5 + b * 0.5)) / 64.0, 6)::DOUBLE AS share FROM embeddings, range(0, 4) r(b)")
def histograms(spark: SparkSession, d: str) -> DataFrame:
    h = V.histogram(F.transform("embedding", lambda x: x.cast("double")), [-1.0, -0.5, 0.0, 0.5, 1.0])
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(h).alias("bin", "share")).select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("share", 6).alias("share"))


@query("A30", "SELECT CAST(i AS BIGINT) AS topic, CAST(count(*) FILTER (WHERE abs(embedding[i]::DOUBLE) > 0.1) AS BIGINT) AS n FROM embeddings, range(1, 65) r(i) GROUP BY i")
def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    return cells.groupBy((F.col("i") + 1).cast("long").alias("topic")).agg(F.count_if(F.abs(F.col("v").cast("double")) > 0.1).alias("n"))


@query("A32", "WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS tok FROM documents), f AS (SELECT tok FROM t GROUP BY tok ORDER BY count(*) DESC, tok LIMIT 10) SELECT doc_id, tok FROM t WHERE tok IN (SELECT tok FROM f)")
def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    from labelloom.functions.text import ascii_tokens

    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(ascii_tokens("text"))).alias("tok"))
    top = words.groupBy("tok").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tok").limit(10)
    return words.join(F.broadcast(top.select("tok")), "tok", "left_semi").select("doc_id", "tok")


@query("A33 A34", "SELECT CAST(label AS BIGINT) AS label, CAST(i AS BIGINT) AS i, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(var_pop(embedding[i]::DOUBLE), 6) AS variance FROM embeddings, range(1, 65) r(i) GROUP BY label, i")
def cluster_moments(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return cells.groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.var_pop("v"), 6).alias("variance"))


@query("A36", f"WITH b AS (SELECT {_bits_sql(PLANES[0])} AS bucket FROM embeddings), c AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket) SELECT CAST(count(*) AS BIGINT) AS buckets, round((sum(n * n) + 0.0) * 64 / sum(n) - sum(n), 6)::DOUBLE AS chi_square FROM c")
def bucket_uniformity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embeddings").groupBy(S.sign_bits(F.col("embedding"), PLANES[0]).alias("bucket")).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("buckets"), F.round(F.sum(F.col("n") * F.col("n")).cast("double") * 64 / F.sum("n") - F.sum("n"), 6).alias("chi_square"))


@query("A27", "WITH r AS (SELECT vec_id, label, CAST(vec_id % 5 AS BIGINT) AS fold, embedding[1]::DOUBLE >= 0 AS said FROM embeddings) SELECT fold, round(avg((said = (label < 5))::INT), 6) AS accuracy, avg((said = (label < 5))::INT) >= 0.5 AS passed FROM r GROUP BY fold")
def fold_accuracy(spark: SparkSession, d: str) -> DataFrame:
    right = ((F.element_at("embedding", 1).cast("double") >= 0) == (F.col("label") < 5)).cast("int")
    a = table(spark, d, "embeddings").groupBy((F.col("vec_id") % 5).alias("fold")).agg(F.avg(right).alias("a"))
    return a.select("fold", F.round("a", 6).alias("accuracy"), (F.col("a") >= 0.5).alias("passed"))


@query("M34", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings UNION ALL SELECT -vec_id, CAST(embedding[64] AS DOUBLE) FROM embeddings WHERE vec_id > 0")
def mirrored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = e.unionByName(e.where("vec_id > 0").select((-F.col("vec_id")).alias("vec_id"), F.reverse("embedding").alias("embedding")))
    return both.select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"))
