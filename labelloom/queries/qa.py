"""Quality-assurance aggregates over documents with tri-state verdicts; `source` stands for the label."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import scalars as S
from labelloom.operators import qa as Q
from labelloom.registry import query, table

_HITS = "h AS (SELECT d.doc_id, d.source, d.lang, l.quality = 1 AS result FROM documents d LEFT JOIN labels l USING (doc_id))"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").withColumn("result", F.col("quality") == 1)


_NUM = 'CAST(count(*) FILTER (WHERE result) AS BIGINT) AS "right", CAST(count(result) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE result IS NULL) AS BIGINT) AS conflicts'


@query("A1 A2 P6", f"WITH {_HITS} SELECT source, {_NUM} FROM h GROUP BY source")
def qa_numbers(spark: SparkSession, d: str) -> DataFrame:
    return Q.numbers(_hits(spark, d), ["source"], "result")


@query("A1b A3 A4 A5", f"WITH {_HITS} SELECT source, lang, {_NUM} FROM h WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = h.doc_id) GROUP BY source, lang")
def qa_numbers_without_training(spark: SparkSession, d: str) -> DataFrame:
    training = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"))
    return Q.numbers(_hits(spark, d).join(training, "doc_id", "left_anti"), ["source", "lang"], "result")


@query("A6 O1", "SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS impressions FROM lineitem GROUP BY l_partkey ORDER BY impressions DESC, l_partkey LIMIT 100")
def impressions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("double").alias("impressions")).orderBy(F.desc_nulls_last("impressions"), "l_partkey").limit(100)


@query("A7", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND count(*) FILTER (WHERE o_orderstatus = 'P') = 0")
def golden_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("open")).where("n >= 12 AND open = 0").drop("open")


@query("A8", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def most_frequent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("A9 S23", "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS pages, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def distinct_and_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("pages"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("A10 W1", "SELECT l_orderkey, max(l_partkey) AS video_id FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R' GROUP BY l_orderkey")
def newest_active(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_linestatus = 'O' AND l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.max("l_partkey").alias("video_id"))


@query("A12 W2", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")
    return table(spark, d, "orders").groupBy("o_custkey").agg(last).select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("A13", "SELECT round(count(DISTINCT l.doc_id) * 1.0 / count(DISTINCT d.doc_id), 6)::DOUBLE AS coverage FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("done"))
    return table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left").agg(F.round(F.count_distinct("done") / F.count_distinct("doc_id"), 6).alias("coverage"))


@query("A14", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE o_orderstatus <> 'O') AS BIGINT) AS done, CAST(100 * count(*) FILTER (WHERE o_orderstatus <> 'O') // count(*) AS BIGINT) AS percent, count(*) FILTER (WHERE o_orderstatus = 'O') = 0 AS finished FROM orders GROUP BY o_custkey")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") != "O")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), done.alias("done")).select("o_custkey", "n", "done", F.expr("100 * done div n").alias("percent"), (F.col("done") == F.col("n")).alias("finished"))


@query("A15 F28", f"WITH {_HITS} SELECT source, CAST(count(*) FILTER (WHERE result) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE NOT result) AS BIGINT) AS fp, round(coalesce(100.0 * count(*) FILTER (WHERE result) / nullif(count(result), 0), 0), 2) AS precision FROM h GROUP BY source")
def label_precision(spark: SparkSession, d: str) -> DataFrame:
    counts = _hits(spark, d).groupBy("source").agg(F.count_if("result").alias("tp"), F.count_if(~F.col("result")).alias("fp"))
    return counts.withColumn("precision", S.percent(F.col("tp"), F.col("fp")))


@query("A16", f"WITH {_HITS}, p AS (SELECT lang, source, coalesce(100.0 * count(*) FILTER (WHERE result) / nullif(count(result), 0), 0) AS precision, count(*) AS pages FROM h GROUP BY lang, source) SELECT lang, round(sum(precision * pages) / sum(pages), 6) AS precision FROM p GROUP BY lang")
def weighted_precision(spark: SparkSession, d: str) -> DataFrame:
    per = _hits(spark, d).groupBy("lang", "source").agg(F.count_if("result").alias("tp"), F.count("result").alias("n"), F.count("*").alias("pages"))
    per = per.withColumn("precision", S.ratio_or_zero(100 * F.col("tp"), F.col("n")))
    return per.groupBy("lang").agg(F.round(Q.weighted_mean("precision", "pages"), 6).alias("precision"))


@query("A17", f"WITH {_HITS} SELECT source, CASE WHEN result IS NULL THEN 'conflict' WHEN result THEN 'yes' ELSE 'no' END AS verdict, CAST(count(DISTINCT doc_id) AS BIGINT) AS pages, min(doc_id) AS first_page FROM h GROUP BY 1, 2")
def verdict_pivot(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("result").isNull(), "conflict").when(F.col("result"), "yes").otherwise("no")
    return _hits(spark, d).groupBy("source", verdict.alias("verdict")).agg(F.count_distinct("doc_id").alias("pages"), F.min("doc_id").alias("first_page"))


@query("A18", "WITH m AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01') AS was, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-01-01') AS now FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN now > was * 3 THEN 'increase' WHEN now * 3 < was THEN 'decrease' END AS kind, CAST(CASE WHEN was > 0 THEN abs(now - was) * 100 // was END AS BIGINT) AS percent FROM m")
def inventory_alerts(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")
    m = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(early).alias("was"), F.count_if(~early).alias("now"))
    kind, percent = Q.inventory_change(F.col("now"), F.col("was"), 3)
    return m.select("o_custkey", kind.alias("kind"), percent.alias("percent"))


@query("A19 ST8", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def daily_series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))


_VOTES = "a AS (SELECT event_id // 5 AS hit, user_id AS worker, value >= 60 AS answer FROM events)"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.expr("event_id div 5").alias("hit"), F.col("user_id").alias("worker"), (F.col("value") >= 60).alias("answer"), F.minute("ts").alias("seconds"))


@query("A21", f"WITH {_VOTES} SELECT hit, CAST(count(*) FILTER (WHERE answer) AS BIGINT) AS yes, CAST(count(answer) AS BIGINT) AS answers, CASE WHEN count(*) FILTER (WHERE answer) >= 4 THEN true WHEN count(*) FILTER (WHERE NOT answer) >= 4 THEN false END AS result FROM a GROUP BY hit")
def vote_consensus(spark: SparkSession, d: str) -> DataFrame:
    return Q.votes(_answers(spark, d), ["hit"], "answer", 4)


@query("A22 W6", f"WITH {_VOTES}, t AS (SELECT hit, count(*) FILTER (WHERE answer) AS y, count(answer) AS n FROM a GROUP BY hit) SELECT worker, CAST(count(*) AS BIGINT) AS minority FROM a JOIN t USING (hit) WHERE y > 0 AND y < n AND y * 2 <> n AND answer = (y * 2 < n) GROUP BY worker")
def worker_minority(spark: SparkSession, d: str) -> DataFrame:
    return Q.minority(_answers(spark, d), ["hit"], "worker", "answer").groupBy("worker").agg(F.count("*").alias("minority"))


@query("A22 T21", f"WITH {_VOTES} SELECT worker, CAST(count(*) FILTER (WHERE answer) AS BIGINT) AS yes, CAST(count(*) FILTER (WHERE NOT answer) AS BIGINT) AS no, count(*) FILTER (WHERE answer) > 0.6 * count(*) AS blocked FROM a GROUP BY worker")
def worker_totals(spark: SparkSession, d: str) -> DataFrame:
    yes, no = F.count_if("answer"), F.count_if(~F.col("answer"))
    return _answers(spark, d).groupBy("worker").agg(yes.alias("yes"), no.alias("no")).withColumn("blocked", F.col("yes") > 0.6 * (F.col("yes") + F.col("no")))


@query("A23", "SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS hits, count(*) FILTER (WHERE event_type = 'click') >= 2 AND count(*) FILTER (WHERE event_type = 'click') >= 0.2 * count(*) AS accepted FROM events GROUP BY user_id")
def occurrence_votes(spark: SparkSession, d: str) -> DataFrame:
    hits = F.count_if(F.col("event_type") == "click")
    return table(spark, d, "events").groupBy("user_id").agg(hits.alias("hits"), F.count("*").alias("n")).select("user_id", "hits", ((F.col("hits") >= 2) & (F.col("hits") >= 0.2 * F.col("n"))).alias("accepted"))


@query("A26 A28 G35", "SELECT quality, CAST(count(*) FILTER (WHERE n_chars >= 1000 AND toxic = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE n_chars >= 1000 AND toxic = 0) AS BIGINT) AS fp, round(coalesce(count(*) FILTER (WHERE n_chars >= 1000 AND toxic = 1) * 1.0 / nullif(count(*) FILTER (WHERE toxic = 1), 0), 0), 6)::DOUBLE AS tpr, round(coalesce(count(*) FILTER (WHERE n_chars >= 1000 AND toxic = 0) * 1.0 / nullif(count(*) FILTER (WHERE toxic = 0), 0), 0), 6)::DOUBLE AS fpr FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    said, is_ = F.col("n_chars") >= 1000, F.col("toxic") == 1
    c = rows.groupBy("quality").agg(F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(is_).alias("p"), F.count_if(~is_).alias("n"))
    return c.select("quality", "tp", "fp", F.round(S.ratio_or_zero(F.col("tp"), F.col("p")), 6).alias("tpr"), F.round(S.ratio_or_zero(F.col("fp"), F.col("n")), 6).alias("fpr"))


@query("A37", "SELECT source, round(coalesce(count(*) FILTER (WHERE quality = 1 AND n_chars > 500) * 1.0 / nullif(count(*) FILTER (WHERE n_chars > 500), 0), 0), 6)::DOUBLE AS recall FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def estimated_recall(spark: SparkSession, d: str) -> DataFrame:
    long = F.col("n_chars") > 500
    c = _hits(spark, d).groupBy("source").agg(F.count_if(long & F.col("result")).alias("both"), F.count_if(long).alias("n"))
    return c.select("source", F.round(S.ratio_or_zero(F.col("both"), F.col("n")), 6).alias("recall"))


@query("T24", "WITH h AS (SELECT o_orderkey AS hit, CAST(floor(o_totalprice) AS BIGINT) % 100 + 1 AS seconds FROM orders), i AS (SELECT l_orderkey AS hit, l_partkey AS item, max(l_returnflag = 'R') AS answer FROM lineitem GROUP BY 1, 2) SELECT hit, item, answer, CAST(ceil(seconds / (count(*) OVER (PARTITION BY hit))) AS BIGINT) AS seconds FROM i JOIN h USING (hit)")
def exploded_votes(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "orders").select(F.col("o_orderkey").alias("hit"), (F.floor("o_totalprice") % 100 + 1).alias("seconds"))
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hit")).agg(F.collect_set("l_partkey").alias("items"), F.collect_set(F.expr("if(l_returnflag = 'R', l_partkey, null)")).alias("clicked"))
    return Q.explode_items(hits.join(items, "hit"), "items", "clicked", "seconds").select("hit", "item", "answer", "seconds")


@query("J3", f"WITH {_HITS} SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('3|', doc_id)), doc_id) AS n FROM h WHERE result IS NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = h.doc_id AND o_orderstatus = 'F')) WHERE n <= 5")
def qa_candidates(spark: SparkSession, d: str) -> DataFrame:
    from labelloom.operators import sampling

    asked = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    fresh = _hits(spark, d).where("result IS NULL").join(asked, "doc_id", "left_anti").select("doc_id", "source")
    return sampling.top_per_group(fresh, ["source"], [sampling.sample_order(3, F.col("doc_id")), F.col("doc_id")], 5)


@query("G55", "SELECT text, CAST(count(*) AS BIGINT) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS tag FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_versions(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",")
    return table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n"), F.md5(ids).alias("tag")).where("n > 1")


@query("G57", "SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN 1 WHEN p_size = 25 THEN 0 ELSE -1 END AS BIGINT) AS y FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def signed_labels(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    y = F.signum(F.col("p_size") - 25).cast("long")
    return table(spark, d, "part").join(sold, "p_partkey", "left_semi").select("p_partkey", y.alias("y"))


@query("", f"WITH {_HITS} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'golden' WHEN result IS NULL THEN 'on-demand' ELSE 'regular' END AS route FROM h")
def result_routing(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_id", F.when(F.col("doc_id") % 10 == 0, "golden").when(F.col("result").isNull(), "on-demand").otherwise("regular").alias("route"))


@query("", "SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS n, round(100.0 * (count(*) - count(*) FILTER (WHERE event_type = 'error')) / count(*), 2) AS accuracy FROM events GROUP BY user_id")
def golden_errors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    return c.withColumn("accuracy", S.percent(F.col("n") - F.col("errors"), F.col("errors")))
