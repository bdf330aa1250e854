"""Whole cycles: the label calculator as one run, loads and swaps of tables, file round trips, polled hits."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.checkpoints import scratch
from labelloom.functions import scalars as S
from labelloom.operators import labels as L
from labelloom.queries import graphs, labels
from labelloom.registry import query, table
from labelloom.sources import files, merges
from labelloom.streaming import flows

#: Label ids of the info labels.
PREROLL, NON_PREROLL = 100, 101
_INFO_SQL = "i AS (SELECT o_orderkey AS page_id, CASE WHEN max(l_returnflag = 'R') THEN 100 ELSE 101 END AS label_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT doc_id FROM documents) GROUP BY o_orderkey)"


def _rolled_up_sql() -> str:
    """A step for each label of the graph, deepest first: own score and weights of true children against its
    threshold, unless there is a verdict."""
    deep: dict[int, int] = {}

    def depth(label: int) -> int:
        if label not in deep:
            deep[label] = max([1 + depth(p) for p, c, _ in graphs.EDGES if c == label], default=0)
        return deep[label]

    steps = []
    for label, threshold in sorted(graphs.THRESHOLDS, key=lambda x: -depth(x[0])):
        gains = "".join(f" UNION ALL SELECT page_id, {w} FROM t{c}" for p, c, w in graphs.EDGES if p == label)
        own = f"SELECT page_id FROM (SELECT page_id, score FROM s WHERE label_id = {label}{gains}) GROUP BY page_id HAVING sum(score) >= {threshold}"
        steps.append(f"t{label} AS (SELECT page_id FROM ({own}) WHERE page_id NOT IN (SELECT page_id FROM vv WHERE label_id = {label}) UNION SELECT page_id FROM vv WHERE label_id = {label} AND result)")
    every = " UNION ".join(f"SELECT page_id, {label}::BIGINT AS label_id FROM t{label}" for label, _ in graphs.THRESHOLDS)
    return ", ".join(steps) + f", r AS ({every})"


@query(
    "T1 T2 T3 T4 T5 S9 S21 G65 A20",
    f"WITH RECURSIVE {graphs._CLOSURE.removeprefix('WITH RECURSIVE ').rstrip()}, {graphs._VERDICTS}, vs AS (SELECT * FROM h UNION ALL SELECT h.page_id, c.node, false FROM h JOIN c ON c.ancestor = h.label_id WHERE NOT h.result), vv AS (SELECT page_id, label_id, bool_and(result) AS result FROM vs GROUP BY page_id, label_id), "
    f"{labels._SCORE_SQL}, {_rolled_up_sql()}, {_INFO_SQL}, n AS (SELECT page_id, label_id FROM r UNION SELECT page_id, label_id FROM i), o AS (SELECT doc_id AS page_id, 1::BIGINT AS label_id FROM labels WHERE quality = 1 UNION SELECT doc_id, 100 FROM labels) "
    "SELECT 'add' AS change, page_id, label_id FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'delete', page_id, label_id FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'complete', doc_id, 0 FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 0)",
)
def label_calculator(spark: SparkSession, d: str) -> DataFrame:
    """Scores of keywords and targets, human overrides, roll-up over the label graph, info labels, the delta against
    the stored labels, written as delimited text and loaded again, and which pages become Complete."""
    edges = graphs.edges(spark)
    verdicts = L.overrides(graphs._verdicts(spark, d), edges)
    true = L.roll_up(labels._scores(spark, d), edges, graphs.labels(spark), verdicts)
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"))
    kinds = labels.info_labels(spark, d).join(pages, "page_id", "left_semi")
    kinds = kinds.select("page_id", F.when(F.col("kind") == "preroll", PREROLL).otherwise(NON_PREROLL).cast("long").alias("label_id"))
    old = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"), "quality", "toxic")
    stored = old.where("quality = 1").select("page_id", F.lit(1).cast("long").alias("label_id")).union(old.select("page_id", F.lit(PREROLL).cast("long"))).distinct()
    changes = L.delta(true.union(kinds).distinct(), stored)
    path = f"{scratch(spark)}/label-delta-{uuid.uuid4().hex}"
    changes.write.csv(path, sep="\t")
    done = pages.distinct().join(old.where("toxic = 0"), "page_id", "left_anti")
    return files.read_tsv(spark, path, changes.schema).union(done.select(F.lit("complete"), "page_id", F.lit(0).cast("long")))


@query("S7 S18", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE upper(c_name) END AS ignored, upper(c_name) AS replaced FROM customer")
def bulk_loads(spark: SparkSession, d: str) -> DataFrame:
    """A delimited file loaded over a table that has every other of its keys: once old rows stay, once they go."""
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    path = f"{scratch(spark)}/customers-{uuid.uuid4().hex}"
    customer.select("c_custkey", F.upper("c_name")).orderBy("c_custkey").write.csv(path, sep="\t")
    old = customer.where("c_custkey % 2 = 0").select("c_custkey", F.lit("kept").alias("c_name"))
    ignored, replaced = (files.bulk_load(old, path, ["c_custkey"], way) for way in ("ignore", "replace"))
    return ignored.withColumnRenamed("c_name", "ignored").join(replaced.withColumnRenamed("c_name", "replaced"), "c_custkey", "full")


@query("S10 S11 S12 S38", "SELECT c_custkey, c_name, 'now' AS at FROM customer UNION ALL SELECT c_custkey, 'old', 'before' FROM customer")
def full_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A table is exported in key order, emptied, loaded anew beside the old one and swapped in; the old one is kept."""
    at = f"{scratch(spark)}/refresh-{uuid.uuid4().hex}"
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    customer.withColumn("c_name", F.lit("old")).write.parquet(f"{at}/table")
    customer.orderBy("c_custkey").write.csv(f"{at}/export", sep="\t")
    emptied = spark.read.parquet(f"{at}/table").where("false")
    emptied.union(files.read_tsv(spark, f"{at}/export", customer.schema)).write.parquet(f"{at}/fresh")
    merges.swap(spark, f"{at}/table", f"{at}/fresh")
    now, before = spark.read.parquet(f"{at}/table"), spark.read.parquet(f"{at}/table.old")
    return now.withColumn("at", F.lit("now")).union(before.withColumn("at", F.lit("before")))


@query("S25 S26", "SELECT vec_id % 5 = 0 AS held_out, CAST(label AS DOUBLE) AS label, CAST(count(*) AS BIGINT) AS n, round(sum(list_sum([CAST(x AS DOUBLE) FOR x IN embedding])), 2) AS total FROM embeddings GROUP BY ALL")
def libsvm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Training and held-out rows written as libsvm text, each in a folder of its own, and read again."""
    at = f"{scratch(spark)}/libsvm-{uuid.uuid4().hex}"
    pairs = F.transform("embedding", lambda x, i: F.struct((i + 1).alias("index"), x.cast("double").alias("value")))
    rows = table(spark, d, "embeddings").select("label", pairs.alias("pairs"), (F.col("vec_id") % 5 == 0).alias("held_out"))
    out = []
    for held_out in (False, True):
        files.to_libsvm(rows.where(F.col("held_out") == held_out), "label", "pairs").write.text(f"{at}/{held_out}")
        back = spark.read.format("libsvm").option("numFeatures", "64").load(f"{at}/{held_out}").select("label", vector_to_array("features").alias("x"))
        out.append(back.select(F.lit(held_out).alias("held_out"), "label", F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("s")))
    return out[0].union(out[1]).groupBy("held_out", "label").agg(F.count("*").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("A24", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value >= 10 GROUP BY ALL), t AS (SELECT user_id, arg_max(event_type, n * 1000 - ascii(event_type)) AS vote, max(n) AS n, sum(n) AS total FROM c GROUP BY user_id) SELECT user_id, vote, round(n / total, 6) AS agreement FROM t")
def majority_votes(spark: SparkSession, d: str) -> DataFrame:
    """The mode of each user's confident votes (of equals the first by name) and the share that agrees."""
    counts = table(spark, d, "events").where("value >= 10").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    found = counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("top"), F.sum("n").alias("total"))
    return found.select("user_id", F.col("top.event_type").alias("vote"), F.round(-F.col("top.n") / F.col("total"), 6).alias("agreement"))


@query("M17", "SELECT vec_id, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) >= 0.3)) > 0 AS result FROM embeddings")
def any_topic(spark: SparkSession, d: str) -> DataFrame:
    """True where any topic is at the threshold."""
    return table(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: x.cast("double") >= 0.3).alias("result"))


@query("F6", "SELECT conv_id, turn, regexp_replace(concat(chr(7), text, chr(173), 'x', chr(8203)), '\\p{C}', '', 'g') AS text FROM conversations")
def stripped_controls(spark: SparkSession, d: str) -> DataFrame:
    from labelloom.functions import text as X

    marked = F.concat(F.lit("\x07"), "text", F.lit("­x​"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.without_control(marked).alias("text"))


@query("M32", "WITH r AS (SELECT source, n_chars >= 600 AS said, quality = 1 AS held FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, count_if(said AND held) AS tp, count_if(said) AS said, count_if(held) AS held FROM r GROUP BY source), p AS (SELECT source, CASE WHEN said = 0 THEN 0.0 ELSE round(100.0 * tp / said, 2) END AS p, CASE WHEN held = 0 THEN 0.0 ELSE round(100.0 * tp / held, 2) END AS r FROM c) SELECT source, p, r FROM p WHERE p >= 80 AND r >= 80")
def gated_models(spark: SparkSession, d: str) -> DataFrame:
    """The models (here one a source) whose precision and recall let them be registered."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", (F.col("n_chars") >= 600).alias("said"), (F.col("quality") == 1).alias("held"))
    counts = rows.groupBy("source").agg(F.count_if(F.col("said") & F.col("held")).alias("tp"), F.count_if("said").alias("said"), F.count_if("held").alias("held"))
    found = counts.select("source", S.percent(F.col("tp"), F.col("said") - F.col("tp")).alias("p"), S.percent(F.col("tp"), F.col("held") - F.col("tp")).alias("r"))
    return found.where("p >= 80 AND r >= 80")


@query("ST1 ST4 ST6", "SELECT event_id, user_id FROM events")
def polled_once(spark: SparkSession, d: str) -> DataFrame:
    """Events polled as a stream, twice: the stored position makes the second poll bring nothing, and each goes in once."""
    at = f"{scratch(spark)}/polled-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema

    def ingest(batch: DataFrame) -> None:
        batch.select("event_id", "user_id").write.mode("append").parquet(f"{at}/rows")

    for _ in range(2):
        events = flows.read(spark, f"{d}/events.parq*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
        flows.drained(flows.once_each(events, "event_id", "ts", "60 days", ingest, f"{at}/position"))
    return spark.read.parquet(f"{at}/rows")
