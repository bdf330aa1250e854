"""Set operations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.registry import query, table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, d, "labels")
    return labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id")


_A, _B = "SELECT doc_id FROM labels WHERE quality = 1", "SELECT doc_id FROM labels WHERE toxic = 1"


@query("X1", f"{_A} UNION {_B}")
def union_of_ids(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.union(b).distinct()


@query("X2 G23", f"SELECT doc_id, CAST(1 AS BIGINT) AS y FROM ({_A}) UNION ALL SELECT doc_id, CAST(-1 AS BIGINT) FROM ({_B})")
def concatenation(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.withColumn("y", F.lit(1).cast("long")).unionByName(b.withColumn("y", F.lit(-1).cast("long")))


@query("X4", f"{_A} INTERSECT {_B}")
def intersection(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.intersect(b)


@query("X5 T6", f"SELECT 'add' AS change, doc_id FROM ({_A} EXCEPT {_B}) UNION ALL SELECT 'delete', doc_id FROM ((SELECT doc_id FROM documents WHERE doc_id % 5 = 0 EXCEPT {_A}) INTERSECT SELECT doc_id FROM labels)")
def restricted_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    expected = table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id").distinct()
    gone = expected.join(a, "doc_id", "left_anti").join(table(spark, d, "labels"), "doc_id", "left_semi")
    return a.subtract(b).select(F.lit("add").alias("change"), "doc_id").union(gone.select(F.lit("delete"), "doc_id"))


@query("X6", "SELECT l_orderkey, coalesce(string_agg(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_partkey END::VARCHAR, ',' ORDER BY CASE WHEN l_linestatus = 'O' THEN l_partkey END::VARCHAR), '') <> coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_partkey END::VARCHAR, ',' ORDER BY CASE WHEN l_returnflag = 'N' THEN l_partkey END::VARCHAR), '') AS changed FROM lineitem GROUP BY l_orderkey")
def changed_sets(spark: SparkSession, d: str) -> DataFrame:
    before = F.array_sort(F.collect_set(F.expr("if(l_linestatus = 'O', l_partkey, null)")))
    after = F.array_sort(F.collect_set(F.expr("if(l_returnflag = 'N', l_partkey, null)")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((before != after).alias("changed"))


@query("X7", "SELECT l_orderkey, count(DISTINCT l_returnflag) IN (0, 3) AS all_or_none FROM lineitem GROUP BY l_orderkey")
def all_or_none(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").isin(0, 3).alias("all_or_none"))


_BIG = "WITH s AS (SELECT user_id, list(DISTINCT event_id // 100) AS v FROM events GROUP BY user_id) "


@query("X8", _BIG + "SELECT DISTINCT a.user_id FROM s a, s b WHERE a.user_id <> b.user_id AND (len(a.v) < len(b.v) OR (len(a.v) = len(b.v) AND a.user_id > b.user_id)) AND len(list_intersect(a.v, b.v)) > 0.3 * len(a.v) AND len(a.v) >= 0.8 * len(b.v)")
def overlapping_clusters(spark: SparkSession, d: str) -> DataFrame:
    member = table(spark, d, "events").select("user_id", F.expr("event_id div 100").alias("m")).distinct()
    size = member.groupBy("user_id").agg(F.count("*").alias("n"))
    a, b = member.toDF("a", "m"), member.toDF("b", "m")
    shared = a.join(b, "m").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("both"))
    sized = shared.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    small = sized.where("(na < nb OR (na = nb AND a > b)) AND both > 0.3 * na AND na >= 0.8 * nb")
    return small.select(F.col("a").alias("user_id")).distinct()
