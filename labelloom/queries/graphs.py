"""Label graphs: closures, ranks, roll-up."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.checkpoints import ready
from labelloom.operators import joins
from labelloom.operators import labels as L
from labelloom.registry import query, table

#: A small label graph with a diamond and two depths for one node.
EDGES = [(1, 2, 100), (1, 3, 60), (2, 4, 50), (3, 4, 100), (4, 5, 100), (1, 5, 40), (6, 7, 100), (7, 8, 30), (6, 8, 70)]
THRESHOLDS = [(1, 100), (2, 100), (3, 60), (4, 90), (5, 100), (6, 100), (7, 100), (8, 50), (9, 10)]
EDGE_SQL = "e(parent_id, child_id, weight) AS (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT, {c}::BIGINT)" for a, b, c in EDGES) + ")"


def edges(spark: SparkSession) -> DataFrame:
    ready(spark)
    return spark.createDataFrame(EDGES, "parent_id long, child_id long, weight long")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS, "label_id long, threshold long")


_CLOSURE = f"WITH RECURSIVE {EDGE_SQL}, c(ancestor, node) AS (SELECT parent_id, parent_id FROM e UNION SELECT child_id, child_id FROM e UNION SELECT c.ancestor, e.child_id FROM c JOIN e ON e.parent_id = c.node) "


@query("J8 J9", _CLOSURE + "SELECT ancestor, node FROM c")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return joins.closure(edges(spark), "parent_id", "child_id")


@query("W8 O7", f"WITH RECURSIVE {EDGE_SQL}, r(node, rank) AS (SELECT parent_id, 0::BIGINT FROM e UNION ALL SELECT e.child_id, r.rank + 1 FROM r JOIN e ON e.parent_id = r.node) SELECT node, max(rank) AS rank FROM r GROUP BY node")
def depth_ranks(spark: SparkSession, d: str) -> DataFrame:
    return joins.longest_path_rank(edges(spark), "parent_id", "child_id")


@query("T7", _CLOSURE + "SELECT DISTINCT ancestor AS label_id FROM c WHERE node IN (4, 8) UNION SELECT 9::BIGINT")
def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    related = spark.createDataFrame([(4,), (8,), (9,)], "label_id long")
    return L.candidates(labels(spark), related, edges(spark))


@query("T12", f"WITH {EDGE_SQL} SELECT l.label_id FROM (VALUES (2::BIGINT), (5::BIGINT), (8::BIGINT), (9::BIGINT)) l(label_id) WHERE l.label_id NOT IN (SELECT parent_id FROM e) AND l.label_id NOT IN (5)")
def vision_only_labels(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([(2,), (5,), (8,), (9,)], "label_id long")
    keywords = spark.createDataFrame([(5,)], "label_id long")
    parents = edges(spark).select(F.col("parent_id").alias("label_id"))
    return targets.join(parents, "label_id", "left_anti").join(keywords, "label_id", "left_anti")


@query("", f"WITH {EDGE_SQL} SELECT parent_id AS label_id, sha1(string_agg(concat(child_id, ':', weight), '|' ORDER BY child_id)) AS tag FROM e GROUP BY parent_id")
def label_hash(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("child_id", "weight"))), lambda x: F.concat_ws(":", x["child_id"].cast("string"), x["weight"].cast("string")))
    return edges(spark).groupBy(F.col("parent_id").alias("label_id")).agg(F.sha1(F.array_join(parts, "|")).alias("tag"))


_VERDICTS = "v0 AS (SELECT doc_id AS page_id, 4::BIGINT AS label_id, 1 AS level, toxic = 0 AS result FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, 2, quality = 1 FROM labels UNION ALL SELECT doc_id, 4, 3, quality = 1 FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 5, 1, true FROM labels), h AS (SELECT page_id, label_id, arg_max(result, level) AS result FROM v0 GROUP BY page_id, label_id)"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"), "quality", "toxic")
    kinds = [
        rows.where("page_id % 3 = 0").select("page_id", F.lit(4).cast("long").alias("label_id"), F.lit(1).alias("level"), (F.col("toxic") == 0).alias("result")),
        rows.select("page_id", F.lit(2).cast("long"), F.lit(2), F.col("quality") == 1),
        rows.where("page_id % 2 = 0").select("page_id", F.lit(4).cast("long"), F.lit(3), F.col("quality") == 1),
        rows.select("page_id", F.lit(5).cast("long"), F.lit(1), F.lit(True)),
    ]
    return kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3])


@query(
    "T3",
    _CLOSURE.rstrip() + f", {_VERDICTS}, s AS (SELECT * FROM h UNION ALL SELECT h.page_id, c.node, false FROM h JOIN c ON c.ancestor = h.label_id WHERE NOT h.result) SELECT page_id, label_id, bool_and(result) AS result FROM s GROUP BY page_id, label_id",
)
def human_overrides(spark: SparkSession, d: str) -> DataFrame:
    return L.overrides(_verdicts(spark, d), edges(spark))


@query(
    "T4",
    f"WITH {EDGE_SQL}, s AS (SELECT doc_id AS page_id, 5::BIGINT AS label_id, n_chars % 150 AS score FROM documents UNION ALL SELECT doc_id, 8, n_chars % 77 FROM documents), p AS (SELECT DISTINCT page_id FROM s), "
    "t5 AS (SELECT page_id FROM s WHERE label_id = 5 AND score >= 100), t8 AS (SELECT page_id FROM s WHERE label_id = 8 AND score >= 50), "
    "t4 AS (SELECT page_id FROM t5), t7 AS (SELECT page_id FROM t8 WHERE false), t2 AS (SELECT page_id FROM t4 WHERE false), t3 AS (SELECT page_id FROM t4), t6 AS (SELECT page_id FROM t8 WHERE false), "
    "t1 AS (SELECT page_id FROM t3 WHERE 60 + 40 >= 100) "
    "SELECT page_id, 5::BIGINT AS label_id FROM t5 UNION ALL SELECT page_id, 8 FROM t8 UNION ALL SELECT page_id, 4 FROM t4 UNION ALL SELECT page_id, 3 FROM t3 UNION ALL SELECT page_id, 1 FROM t1",
)
def label_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Roll-up of two leaf scores: 5 makes 4 true, that 3, and 3 and 5 together 1; 8 alone makes neither 7 nor 6."""
    docs = table(spark, d, "documents")
    scores = docs.select(F.col("doc_id").alias("page_id"), F.lit(5).cast("long").alias("label_id"), (F.col("n_chars") % 150).alias("score")).union(docs.select("doc_id", F.lit(8).cast("long"), F.col("n_chars") % 77))
    none = spark.createDataFrame([], "page_id long, label_id long, result boolean")
    return L.roll_up(scores, edges(spark), labels(spark), none)
