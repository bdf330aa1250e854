"""Sorts, limits, quotas and samples."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.operators import sampling as P
from labelloom.registry import query, table


@query("O1 O2", "SELECT c_custkey, n FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) ORDER BY n DESC, c_custkey LIMIT 25")
def ordered_limit(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, d, "customer").select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy(F.desc("n"), "c_custkey").limit(25)


@query("O3", "SELECT doc_id FROM documents ORDER BY md5(concat('7|', doc_id)), doc_id LIMIT 50")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 7)


@query("O4 T23", "WITH l AS (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 20), u AS (SELECT c_custkey, count(o_orderkey) AS uses FROM l LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), r AS (SELECT c_custkey, row_number() OVER (ORDER BY uses, c_custkey) - 1 AS place FROM u ORDER BY uses, c_custkey LIMIT 6) SELECT CAST(s AS BIGINT) AS slot, c_custkey FROM range(0, 16) t(s) JOIN r ON r.place = s % 6")
def golden_cycle(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "customer").select("c_custkey").orderBy(F.desc("c_custkey")).limit(20)
    uses = newest.join(table(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("uses"))
    least = uses.orderBy("uses", "c_custkey").limit(6)
    ranked = least.withColumn("place", (F.row_number().over(Window.orderBy("uses", "c_custkey")) - 1).cast("long"))
    return P.cycled(ranked, "place", 16).select("slot", "c_custkey")


@query("O5 O6", "SELECT o_custkey, CAST(least(greatest(12 - count(*), 0), 5) AS BIGINT) AS quota FROM orders GROUP BY o_custkey")
def quotas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(P.quota(F.lit(12), F.count("*"), F.lit(5)).cast("long").alias("quota"))


@query("O6 T22", "SELECT * FROM (SELECT doc_id, 'preroll' AS kind FROM documents WHERE lang = 'en' ORDER BY md5(concat('1|', doc_id)), doc_id LIMIT 7) UNION ALL SELECT * FROM (SELECT doc_id, 'other' FROM documents WHERE lang <> 'en' ORDER BY md5(concat('1|', doc_id)), doc_id LIMIT 3)")
def split_quota(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    a = P.sample(docs.where("lang = 'en'").select("doc_id"), "doc_id", 7, 1).withColumn("kind", F.lit("preroll"))
    return a.unionByName(P.sample(docs.where("lang <> 'en'").select("doc_id"), "doc_id", 3, 1).withColumn("kind", F.lit("other")))


@query("O8 O9", "SELECT event_id FROM events WHERE value > 100 ORDER BY event_id LIMIT 40")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value > 100").select("event_id").orderBy("event_id").limit(40)


@query("O10 O11 W10", "WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM t WHERE i % greatest(n // 10, 1) = 0")
def strided_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("f"))
    factor = F.greatest(F.floor(F.size("f") / 10), F.lit(1))
    return frames.select("user_id", F.explode(P.strided(F.col("f"), factor)).alias("event_id"))


@query("O11", "WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id AS middle FROM t WHERE i = n // 2 + 1")
def middle_element(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("v"))
    return ids.select("user_id", F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("middle"))


@query("O12 O13", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('5|', doc_id)), doc_id) AS n FROM documents) SELECT doc_id, lang, n <= 10 AS held_out FROM r WHERE n <= CASE WHEN lang = 'en' THEN 60 ELSE 20 END")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(P.sample_order(5, F.col("doc_id")), "doc_id")
    rows = table(spark, d, "documents").select("doc_id", "lang").withColumn("n", F.row_number().over(w))
    rows = rows.where("n <= 60")  # a constant bound first: each task then sorts and passes on no more of a language
    return rows.where(F.col("n") <= F.when(F.col("lang") == "en", 60).otherwise(20)).select("doc_id", "lang", (F.col("n") <= 10).alias("held_out"))


@query("O14 O15", "WITH t AS (SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)) SELECT vec_id, CAST(CASE WHEN max(v) >= 0.25 THEN arg_max(i, v) ELSE -1 END AS BIGINT) AS topic FROM t GROUP BY vec_id")
def argmax_with_rejection(spark: SparkSession, d: str) -> DataFrame:
    top = F.array_max("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.when(top >= 0.25, F.array_position("embedding", top)).otherwise(-1).cast("long").alias("topic"))


@query("G61", "SELECT o_custkey, string_agg(m::VARCHAR, ',' ORDER BY r) AS frames FROM (SELECT o_custkey, m, row_number() OVER (PARTITION BY o_custkey ORDER BY NOT face, m) AS r FROM (SELECT o_custkey, o_orderkey AS m, o_orderstatus = 'F' AS face FROM orders)) WHERE r <= 4 GROUP BY o_custkey")
def padded_choice(spark: SparkSession, d: str) -> DataFrame:
    faces = F.array_sort(F.collect_set(F.expr("if(o_orderstatus = 'F', o_orderkey, null)")))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(faces.alias("faces"), F.array_sort(F.collect_set("o_orderkey")).alias("every"))
    chosen = F.slice(F.concat("faces", F.array_except("every", "faces")), 1, 4)
    return rows.select("o_custkey", F.array_join(F.transform(chosen, lambda x: x.cast("string")), ",").alias("frames"))
