"""Flows, registries, training sets and array models over the test tables."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import ml
from labelloom.operators.sampling import sample
from labelloom.plans import flow as P
from labelloom.plans.config import validated
from labelloom.registry import query, table
from labelloom.sources import merges


@query("D1 D2 D3 D4 D5 D6 D7 D8 G64", "SELECT c.o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders c WHERE o_orderstatus = 'F' GROUP BY c.o_custkey")
def flow_of_frames(spark: SparkSession, d: str) -> DataFrame:
    """A diamond of lazy frames: one filter, two aggregates side by side, and their join."""
    f = P.Flow("orders")
    load = f.add("load", lambda path: spark.read.parquet(path).where("o_orderstatus = 'F'"))
    count = f.add("count", lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n")))
    total = f.add("total", lambda rows: rows.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")))
    join = f.add("join", lambda a, b: a.join(b, "o_custkey"))
    f.start_with(load, P.Input("path"))
    f.connect(load, count, load.value())
    f.connect(load, total, load.value())
    f.connect([count, total], join, count.value(), total.value())
    f.output = join.value()
    return f.run(path=f"{d}/orders.parquet")


@query("D9 D10", "SELECT CAST(r AS BIGINT) AS r, CAST((SELECT count(*) FROM nation WHERE n_regionkey = r) AS BIGINT) AS n FROM range(0, 5) t(r)")
def parallel_flows(spark: SparkSession, d: str) -> DataFrame:
    """One small flow for each region, several at once, results in order."""
    nation = table(spark, d, "nation")

    def make() -> P.Flow:
        f = P.Flow("region")
        s = f.add("count", lambda r: (r, nation.where(F.col("n_regionkey") == r).count()))
        f.start_with(s, P.Input("ip_data"))
        f.output = s.value()
        return f

    return spark.createDataFrame(list(P.operate_in_parallel(make, range(5), 3)), "r long, n long")


@query("P18", "SELECT vec_id FROM (SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings) WHERE list_max(v) - list_min(v) >= 0.5 AND list_var_pop(v) >= 0.0156")
def patch_quality(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").where(ml.patch_quality(pixels, 0.5, 0.0156)).select("vec_id")


@query("S27 S20", "SELECT vec_id, CAST(256 AS BIGINT) AS bytes, round(list_sum([x::DOUBLE for x in embedding]), 4) AS total FROM embeddings")
def packed_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors packed as little-endian floats in a binary column, and read back."""

    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x, "<f4").astype(float))

    packed = table(spark, d, "embeddings").select("vec_id", F.pandas_udf(pack, "binary")("embedding").alias("b"))
    back = F.aggregate(F.pandas_udf(unpack, "array<double>")("b"), F.lit(0.0), lambda a, x: a + x)
    return packed.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), F.round(back, 4).alias("total"))


@query("S28")
def saved_model(spark: SparkSession, d: str) -> DataFrame:
    """A model saved under its version, loaded again and applied."""
    import uuid

    from pyspark.ml import Pipeline, PipelineModel

    from labelloom.checkpoints import scratch

    rows = ml.vectors(table(spark, d, "embeddings"), "embedding").withColumn("label", F.col("label").cast("double"))
    path = ml.save(Pipeline(stages=[ml.forest(5)]).fit(rows), f"{scratch(spark)}/models-{uuid.uuid4().hex}", "v1")
    return PipelineModel.load(path).transform(rows).select("vec_id", F.col("prediction").cast("int").alias("predicted"))


@query("", "SELECT s_name AS name, CAST(s_suppkey + 1000 AS BIGINT) AS version, 'replaced' AS state FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_name, s_suppkey, 'kept' FROM supplier WHERE s_suppkey % 3 <> 0")
def registry_injection(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("version"), F.lit("kept").alias("state"))
    new = old.where("version % 3 = 0").select("name", (F.col("version") + 1000).alias("version"), F.lit("replaced").alias("state"))
    return merges.upsert(old, new, ["name"], "version")


@query("T26", "WITH p AS (SELECT doc_id, source FROM (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY n_chars ORDER BY d.doc_id) AS r FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1) WHERE r = 1), n AS (SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality <> 1 OR quality IS NULL) SELECT doc_id, source, 1::BIGINT AS y FROM p UNION ALL SELECT doc_id, source, 0 FROM n WHERE source IN (SELECT source FROM p)")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Positives, one for each video (length); negatives are not true or unanswered, of the same sources."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    positive = rows.where("quality = 1").groupBy("n_chars").agg(F.min(F.struct("doc_id", "source")).alias("r")).select("r.doc_id", "r.source")
    negative = rows.where("quality <> 1 OR quality IS NULL").join(positive.select("source"), "source", "left_semi").select("doc_id", "source")
    return positive.withColumn("y", F.lit(1).cast("long")).unionByName(negative.withColumn("y", F.lit(0).cast("long")))


@query("G29", "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE text <> '' GROUP BY conv_id")
def regrouped_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"), F.size("r").cast("long").alias("n"))


@query("G32 G56", "WITH p AS (SELECT doc_id FROM labels WHERE quality = 1 ORDER BY md5(concat('1500|', doc_id)), doc_id LIMIT 150), f AS (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT o_orderkey FROM orders)), t AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5(concat('5000|', doc_id)), doc_id LIMIT 100) SELECT doc_id, 'positive' AS kind FROM p UNION ALL SELECT doc_id, 'false positive' FROM f UNION ALL SELECT doc_id, 'top-up' FROM t")
def training_frames(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    positive = sample(labels.where("quality = 1").select("doc_id"), "doc_id", 150, 1500)
    wrong = labels.where("quality = 0").select("doc_id").join(asked, "doc_id", "left_anti")
    more = sample(table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left_anti"), "doc_id", 100, 5000)
    kinds = [rows.select("doc_id", F.lit(kind).alias("kind")) for rows, kind in ((positive, "positive"), (wrong, "false positive"), (more, "top-up"))]
    return kinds[0].union(kinds[1]).union(kinds[2])


@query("", "SELECT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE lang = 'de') ORDER BY md5(concat('20|', doc_id)), doc_id LIMIT 80")
def discovery_videos(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").where("quality = 1").select("doc_id").union(table(spark, d, "documents").where("lang = 'de'").select("doc_id")).distinct()
    return sample(known, "doc_id", 80, 20)


@query("", "SELECT doc_id, 'processed' AS result FROM documents UNION ALL SELECT doc_id, 'text' FROM documents WHERE n_chars > 2000")
def beta_results(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array_compact(F.array(F.lit("processed"), F.when(F.col("n_chars") > 2000, "text")))
    return table(spark, d, "documents").select("doc_id", F.explode(kinds).alias("result"))


@query("", "SELECT doc_id, CASE WHEN contains(lower(text), 'heat') THEN 'save' ELSE 'delete' END AS action FROM documents WHERE lang IN ('en', 'de')")
def entity_actions(spark: SparkSession, d: str) -> DataFrame:
    """Only detectors with features are run; matched pages are saved and the others' old rows go."""
    return table(spark, d, "documents").where("lang IN ('en', 'de')").select("doc_id", F.when(F.lower("text").contains("heat"), "save").otherwise("delete").alias("action"))


@query("G53 G31", "SELECT * FROM (VALUES ('frames', '50'), ('name', 'scene'), ('ratio', '0.6'), ('shuffle', 'True')) t(key, value)")
def checked_config(spark: SparkSession, d: str) -> DataFrame:
    spec = {"name": ("string",), "frames": ("integer", 50), "ratio": ("float",), "shuffle": ("boolean", False)}
    found = validated({"name": "scene", "ratio": "0.60", "shuffle": "true"}, spec)
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "key string, value string")


@query("G14")
def affine_fits(spark: SparkSession, d: str) -> DataFrame:
    """The best affine map between the first points of two vectors, for each of some vectors."""

    def one(v: pd.Series) -> pd.Series:
        return v.map(lambda x: ml.affine_fit(np.asarray(x[:10], float).reshape(5, 2), np.asarray(x[10:20], float).reshape(5, 2))[1])

    return table(spark, d, "embeddings").select("vec_id", F.pandas_udf(one, "double")("embedding").alias("error"))


def _projected(spark: SparkSession, d: str, directions) -> DataFrame:
    """Directions from a bounded sample of 400 labelled vectors, applied to all of them in the JVM."""
    rows = table(spark, d, "embeddings")
    some = sample(rows, "vec_id", 400, 3).select("embedding", "label").toPandas()
    w = directions(np.stack(some["embedding"].to_numpy()).astype(float), some["label"].to_numpy())
    from labelloom.functions.scalars import dot

    return rows.select("vec_id", F.array(*[F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in w[:, k]])), 6) for k in range(w.shape[1])]).alias("projected"))


@query("M7")
def discriminant_projection(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, lambda x, y: ml.discriminant(x, y, 2))


@query("M8")
def alignment_projection(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, lambda x, y: ml.local_alignment(x, y, 2))


@query("")
def gist_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of 8 x 8 images, which the vectors stand for."""

    def one(v: pd.Series) -> pd.Series:
        return v.map(lambda x: ml.gist(np.asarray(x, float).reshape(8, 8), 2, 4, 2).round(6))

    return table(spark, d, "embeddings").select("vec_id", F.pandas_udf(one, "array<double>")("embedding").alias("gist"))


@query("")
def neighbour_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of each held-out query vector by its five nearest training vectors."""
    from labelloom.operators.vectors import nearest, vote

    e = table(spark, d, "embeddings")
    near = nearest(e.where("vec_id % 100 = 0"), e.where("vec_id % 100 <> 0"), "vec_id", "embedding", 5)
    votes = vote(near.join(e.select(F.col("vec_id").alias("found"), "label"), "found"), "query", "label", "distance", 10.0)
    return votes.groupBy("query").agg(F.max_by("label", F.struct("votes", "label")).alias("predicted"))
