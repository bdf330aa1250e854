"""The label engine over documents as pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import scalars as S
from labelloom.functions import text as X
from labelloom.operators import labels as L
from labelloom.registry import query, table

#: label, phrase, title weight, body weight
KEYWORDS = [(1, "the", 0, 40), (1, "of the", 60, 50), (2, "in", 30, 0), (2, "and the", 0, 70), (3, "de la", 80, 60), (3, "und", 20, 20), (4, "to", 10, 10), (4, "the of", 100, 90)]
TARGETS = [(1, 0, 15), (2, 1, 25), (3, 2, 35), (4, 3, 45)]

_KEYWORD_SQL = "k(label_id, phrase, tw, bw) AS (VALUES " + ", ".join(f"({a}::BIGINT, '{b}', {c}, {w})" for a, b, c, w in KEYWORDS) + ")"
_LINE = "concat(' ', array_to_string(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), ' '), ' ')"
_PAGE_SQL = f"p AS (SELECT doc_id AS page_id, {_LINE.format('substr(text, 1, 60)')} AS title, {_LINE.format('text')} AS body FROM documents)"
_SCORE_SQL = (
    f"{_KEYWORD_SQL}, {_PAGE_SQL}, w(label_id, target_id, weight) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT, {c})" for a, b, c in TARGETS) + "), "
    "ks AS (SELECT page_id, label_id, CASE WHEN contains(title, concat(' ', phrase, ' ')) AND tw <> 0 THEN tw WHEN contains(body, concat(' ', phrase, ' ')) THEN bw ELSE 0 END AS score FROM p, k), "
    "a AS (SELECT DISTINCT l_orderkey AS page_id, l_partkey AS video_id FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R'), "
    "ts AS (SELECT page_id, label_id, weight AS score FROM (SELECT doc_id AS page_id, 0 + quality AS target_id FROM labels UNION ALL SELECT a.page_id, p_size % 4 FROM a JOIN part ON p_partkey = video_id) r JOIN w USING (target_id)), "
    "s AS (SELECT page_id, label_id, CAST(sum(score) AS BIGINT) AS score FROM (SELECT * FROM ks WHERE score <> 0 UNION ALL SELECT * FROM ts) GROUP BY page_id, label_id)"
)


def _active(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_linestatus = 'O' AND l_returnflag <> 'R'")
    return lines.select(F.col("l_orderkey").cast("long").alias("page_id"), F.col("l_partkey").cast("long").alias("video_id")).distinct()


def _scores(spark: SparkSession, d: str) -> DataFrame:
    keywords = spark.createDataFrame(KEYWORDS, "label_id long, phrase string, title_weight int, body_weight int")
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), X.ascii_tokens(F.substring("text", 1, 60)).alias("title_tokens"), X.ascii_tokens("text").alias("body_tokens"))
    weights = spark.createDataFrame(TARGETS, "label_id long, target_id long, weight int")
    texts = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").cast("long").alias("target_id"))
    videos = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("video_id"), (F.col("p_size") % 4).cast("long").alias("target_id"))
    targets = L.target_scores(texts, videos, _active(spark, d), weights)
    return L.page_scores(L.keyword_scores(pages, keywords, 3).where("score <> 0"), targets)


@query("T1 T2 A20", f"WITH {_SCORE_SQL} SELECT * FROM s")
def page_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query("T1", f"WITH {_SCORE_SQL}, n AS (SELECT page_id, label_id FROM s WHERE score >= 100), o AS (SELECT doc_id AS page_id, 1::BIGINT AS label_id FROM labels WHERE quality = 1) SELECT 'add' AS change, page_id, label_id FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'delete', page_id, label_id FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: scores of all pages, their labels at the threshold, and the delta against the stored labels."""
    stored = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"), F.lit(1).cast("long").alias("label_id"))
    return L.delta(_scores(spark, d).where("score >= 100").select("page_id", "label_id"), stored)


@query(
    "T5",
    "SELECT o_orderkey AS page_id, CASE WHEN max(l_returnflag = 'R') THEN 'preroll' ELSE 'non-preroll' END AS kind, CASE WHEN max(p_size) * 60 < 240 THEN 'Short' WHEN max(p_size) * 60 < 1200 THEN 'Medium' ELSE 'Long' END AS length FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey",
)
def info_labels(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    done = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("page_id"))
    rows = lines.join(done, F.col("l_orderkey") == F.col("page_id")).join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.bool_or(F.col("l_returnflag") == "R"), "preroll").otherwise("non-preroll")
    return rows.groupBy("page_id").agg(kind.alias("kind"), S.length_label(F.max("p_size") * 60).alias("length"))


@query("T8 T9", "WITH a AS (SELECT DISTINCT l_orderkey AS page_id, l_partkey AS video_id FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R'), v AS (SELECT p_partkey AS video_id, CASE WHEN p_size > 5 THEN TIMESTAMP '2020-01-01' + to_days(p_size::INTEGER) END AS t FROM part) SELECT page_id::BIGINT AS page_id, CASE WHEN count(*) = count(t) THEN min(t) END AS last FROM a LEFT JOIN v USING (video_id) GROUP BY page_id")
def last_detections(spark: SparkSession, d: str) -> DataFrame:
    at = F.expr("if(p_size > 5, timestamp'2020-01-01' + make_dt_interval(p_size), null)")
    videos = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("video_id"), at.alias("last_detection"))
    return L.last_detection(_active(spark, d), videos)


@query("T16", "WITH o AS (SELECT o_custkey AS page_id, o_orderkey % 20 AS video_id, bool_or(o_orderstatus = 'O') AS active, count(*) AS seen_count FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2), s AS (SELECT DISTINCT o_custkey AS page_id, o_orderkey % 20 AS video_id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey % 3 = 0), c AS (SELECT DISTINCT page_id FROM s), r AS (SELECT coalesce(o.page_id, s.page_id)::BIGINT AS page_id, coalesce(o.video_id, s.video_id)::BIGINT AS video_id, coalesce(o.active, false) AS was, CASE WHEN coalesce(o.page_id, s.page_id) IN (SELECT page_id FROM c) THEN s.page_id IS NOT NULL ELSE coalesce(o.active, false) END AS active, coalesce(o.seen_count, 0) + (s.page_id IS NOT NULL)::INT AS seen_count FROM o FULL JOIN s ON o.page_id = s.page_id AND o.video_id = s.video_id) SELECT page_id, video_id, active, CAST(seen_count AS BIGINT) AS seen_count, bool_or(active <> was) OVER (PARTITION BY page_id) AS changed FROM r")
def crawl_merge(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("page_id"), (F.col("o_orderkey") % 20).cast("long").alias("video_id"), "o_orderstatus", "o_orderdate")
    old = orders.where("o_orderdate < timestamp'1996-01-01'").groupBy("page_id", "video_id").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("active"), F.count("*").alias("seen_count"))
    seen = orders.where("o_orderdate >= timestamp'1996-01-01' AND page_id % 3 = 0").select("page_id", "video_id")
    return L.crawl_merge(old, seen)


@query("T17", "SELECT DISTINCT p.page_id FROM pages p JOIN lineitem ON l_orderkey = p.page_id WHERE l_linestatus = 'O' AND NOT suffix(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '.example.org')")
def base_population(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where(~X.host("url").endswith(".example.org")).select("page_id")
    active = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("page_id"))
    return pages.join(active, "page_id", "left_semi").distinct()


@query("T20", "SELECT CAST(doc_id AS BIGINT) AS page_id, CAST(CASE quality WHEN 1 THEN 10 ELSE 20 END AS BIGINT) AS clf_target_id FROM labels")
def detector_results(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([(1, 10), (0, 20)], "quality int, clf_target_id long")
    return table(spark, d, "labels").join(F.broadcast(targets), "quality").select(F.col("doc_id").alias("page_id"), "clf_target_id")


@query("T27", "SELECT doc_id, contains(lower(text), 'heat') AS body, contains(lower(substr(text, 1, 60)), 'heat') AS title FROM documents")
def user_keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower("text").contains("heat").alias("body"), F.lower(F.substring("text", 1, 60)).contains("heat").alias("title"))


@query("", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS score, CAST(embedding[1] AS DOUBLE) >= CASE WHEN label < 5 THEN 0.1 ELSE 0.0 END AS result FROM embeddings")
def detector_thresholds(spark: SparkSession, d: str) -> DataFrame:
    score = F.element_at("embedding", 1).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(score, 6).alias("score"), (score >= F.when(F.col("label") < 5, 0.1).otherwise(0.0)).alias("result"))
