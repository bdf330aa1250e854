"""Filters, projections, predicates and joins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text as X
from labelloom.operators import joins
from labelloom.registry import query, table


@query("P2", "SELECT DISTINCT source, lang FROM documents")
def distinct_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("P3 G34", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13) OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    wanted = customer.where("c_nationkey = 3 OR c_custkey IN (1, 2, 3, 5, 8, 13)").select("c_custkey")
    return orders.join(wanted, orders["o_custkey"] == wanted["c_custkey"], "left_semi").select("o_orderkey")


@query("P4 X3", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def not_in_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti")


@query("P5", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def tuple_not_in(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    back = lines.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return lines.join(back, ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("P6 J2", "SELECT d.doc_id, l.quality IS NULL AS unanswered FROM documents d LEFT JOIN labels l USING (doc_id)")
def null_tests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").isNull().alias("unanswered"))


@query("P7 P8 P9", "SELECT o_orderkey, o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30' AS closed, o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-06-30' AS half_open, o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-06-30' AS open FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30'")
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    at, a, b = F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp"), F.lit("1995-06-30").cast("timestamp")
    return table(spark, d, "orders").where(at.between(a, b)).select("o_orderkey", at.between(a, b).alias("closed"), ((at >= a) & (at < b)).alias("half_open"), ((at > a) & (at < b)).alias("open"))


@query("P10", "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_retailprice > 1500) AND NOT (p_size % 2 = 0)")
def boolean_combinations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(((F.col("p_size") < 10) | (F.col("p_retailprice") > 1500)) & ~(F.col("p_size") % 2 == 0)).select("p_partkey")


@query("P11 P28", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def not_exists(spark: SparkSession, d: str) -> DataFrame:
    customer, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_anti")


@query("P12 P25 P26", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag = 'R' AND l_linestatus IS NOT NULL AS preroll_ok, (l_linestatus, l_returnflag) IN (('O', 'N'), ('F', 'R'), ('F', 'A')) AS allowed FROM lineitem")
def hybrid_predicates(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.struct("l_linestatus", "l_returnflag").isin(*[F.struct(F.lit(a).alias("l_linestatus"), F.lit(b).alias("l_returnflag")) for a, b in (("O", "N"), ("F", "R"), ("F", "A"))])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", ((F.col("l_returnflag") == "R") & F.col("l_linestatus").isNotNull()).alias("preroll_ok"), allowed.alias("allowed"))


@query(
    "P13 J10 T18",
    "WITH r(domain, weight) AS (VALUES ('.example.net', 30), ('thther.example.org', 50), ('.net', 5), ('ample.org', 100)), h AS (SELECT page_id, concat('.', lower(regexp_extract(url, '^https?://([^/?#]*)', 1))) AS host FROM pages) "
    "SELECT page_id, CAST(sum(weight) AS BIGINT) AS score FROM h JOIN r ON suffix(host, concat('.', ltrim(domain, '.'))) GROUP BY page_id",
)
def domain_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(".example.net", 30), ("thther.example.org", 50), (".net", 5), ("ample.org", 100)], "domain string, weight int")
    pages = table(spark, d, "pages").select("page_id", X.host("url").alias("host"))
    return joins.suffix_join(pages, "host", F.broadcast(rules), "domain").groupBy("page_id").agg(F.sum("weight").alias("score"))


@query("P14", "SELECT page_id, NOT regexp_matches(url, '^http') OR regexp_matches(url, '^https?://(www\\.)?casino') OR regexp_matches(url, '^https?://[^/]*/[a-z]{2}/?$') AS skip FROM pages")
def url_blacklist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.skip_url("url", [r"https?://(www\.)?casino", r"https?://[^/]*/[a-z]{2}/?$"]).alias("skip"))


@query("P15 P16", "SELECT d.doc_id, c.clf FROM documents d LEFT JOIN labels l USING (doc_id), (VALUES ('lang', 0), ('topic', 1)) c(clf, since) WHERE l.quality IS NULL OR l.quality < c.since")
def stale_work(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    due = F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("clf"), F.lit(s).alias("since")) for c, s in (("lang", 0), ("topic", 1))]), lambda c: F.col("quality").isNull() | (F.col("quality") < c["since"])))
    return seen.select("doc_id", due.alias("c")).select("doc_id", "c.clf")


@query("P17", "SELECT event_id FROM events WHERE event_id % 7 = 0")
def modulo_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_id % 7 = 0").select("event_id")


@query(
    "P19",
    "WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, quantile_cont(l_extendedprice, 0.25) AS e1, quantile_cont(l_extendedprice, 0.75) AS e3 FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem, q WHERE l_quantity > q1 - 1.5 * (q3 - q1) AND l_quantity < q3 + 1.5 * (q3 - q1) AND l_extendedprice > e1 - 1.5 * (e3 - e1) AND l_extendedprice < e3 + 1.5 * (e3 - e1)",
)
def iqr_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    columns = ("l_quantity", "l_extendedprice")
    bounds = lines.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_{c}") for c in columns])
    inside = [(F.col(c) > q[0] - 1.5 * (q[1] - q[0])) & (F.col(c) < q[1] + 1.5 * (q[1] - q[0])) for c in columns for q in [F.col(f"_{c}")]]
    return lines.join(F.broadcast(bounds)).where(inside[0] & inside[1]).select(lines.columns)


@query("P20 P21", "SELECT vec_id, CAST(CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS BIGINT) AS result FROM embeddings")
def nan_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 11 == 0, F.array(F.lit(float("nan")))).otherwise(F.slice("embedding", 1, 4).cast("array<double>")).alias("v"))
    whole = rows.where(~F.exists("v", F.isnan)).select("vec_id", F.col("label").cast("long").alias("answer"))
    return rows.select("vec_id").join(whole, "vec_id", "left").select("vec_id", F.coalesce("answer", F.lit(-1)).alias("result"))


@query("P22 P23", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O') AND (p_type IS NULL OR p_type <> 'flip') AND p_name NOT IN ('x', 'y')")
def ignore_lists(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    beta = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_partkey").alias("p_partkey"))
    return part.where(~F.col("p_name").isin("x", "y") & ~F.col("p_type").eqNullSafe("flip")).join(beta, "p_partkey", "left_anti").select("p_partkey")


@query("P24 A38", "SELECT lang, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY lang")
def collected_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''")
    return rows.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",").alias("ids"))


@query("P27", "SELECT source, CAST(count(*) AS BIGINT) AS pages, CAST(count(l.doc_id) AS BIGINT) AS done, count(l.doc_id) * 10 >= count(*) * 6 AS ready FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def enable_guard(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").select("doc_id", F.lit(1).alias("x"))
    counts = table(spark, d, "documents").join(done, "doc_id", "left").groupBy("source").agg(F.count("*").alias("pages"), F.count("x").alias("done"))
    return counts.withColumn("ready", F.col("done") * 10 >= F.col("pages") * 6)


@query("J1 J5 J17", "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY r_name, n_name")
def association_chain(spark: SparkSession, d: str) -> DataFrame:
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    per = o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    by = per.groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("t"))
    named = by.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "n_name", "orders", F.round("t", 2).alias("total"))


@query("J4", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R')")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_linestatus = 'O' AND l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


@query("J6", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 50000")
def join_with_conditions(spark: SparkSession, d: str) -> DataFrame:
    dear = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 50000").select("o_custkey", "o_orderkey")
    return table(spark, d, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("J7 T14 T13 T15", "SELECT o_orderkey, 'region' AS kind, r_regionkey::BIGINT AS owner FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name < 'B' UNION ALL SELECT o_orderkey, 'nation', n_nationkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey = 7")
def polymorphic_owner(spark: SparkSession, d: str) -> DataFrame:
    owned = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kinds = F.array(F.when(F.col("r_name") < "B", F.struct(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("owner"))), F.when(F.col("n_nationkey") == 7, F.struct(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("owner"))))
    rights = nations.select("n_nationkey", F.explode(F.array_compact(kinds)).alias("k")).select("n_nationkey", "k.kind", "k.owner")
    return owned.join(rights, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "kind", "owner")


@query(
    "J11 T11 T2",
    "WITH k(phrase, weight) AS (VALUES ('the', 1), ('of the', 5), ('in the', 4), ('the of the', 9), ('und', 3), ('de la', 6)), t AS (SELECT doc_id, concat(' ', array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' '), ' ') AS line FROM documents) "
    "SELECT doc_id, phrase, CAST(weight AS BIGINT) AS weight FROM t JOIN k ON contains(line, concat(' ', phrase, ' '))",
)
def phrase_containment(spark: SparkSession, d: str) -> DataFrame:
    keywords = spark.createDataFrame([("the", 1), ("of the", 5), ("in the", 4), ("the of the", 9), ("und", 3), ("de la", 6)], "phrase string, weight long")
    docs = table(spark, d, "documents").select("doc_id", X.ascii_tokens("text").alias("tokens"))
    return joins.phrase_join(docs, "tokens", F.broadcast(keywords), "phrase", 3).select("doc_id", "phrase", "weight")


@query("J12", "WITH t(kind, lo, hi) AS (VALUES ('click', 10.0, 50.0), ('view', 0.0, 20.0), ('error', 100.0, 1000.0)) SELECT event_id, kind FROM events JOIN t ON event_type = kind AND value >= lo AND value < hi")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    bounds = spark.createDataFrame([("click", 10.0, 50.0), ("view", 0.0, 20.0), ("error", 100.0, 1000.0)], "kind string, lo double, hi double")
    return table(spark, d, "events").join(F.broadcast(bounds), (F.col("event_type") == F.col("kind")) & (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))).select("event_id", "kind")


@query("J16 X9", "SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(embedding[i] AS DOUBLE) * CAST(embedding[i + 4] AS DOUBLE), 6) AS product FROM embeddings, range(1, 5) r(i)")
def zip_join(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.arrays_zip(F.slice("embedding", 1, 4).alias("a"), F.slice("embedding", 5, 4).alias("b"))
    out = table(spark, d, "embeddings").select("vec_id", F.posexplode(pairs).alias("pos", "p"))
    return out.select("vec_id", (F.col("pos") + 1).cast("long").alias("i"), F.round(F.col("p.a").cast("double") * F.col("p.b").cast("double"), 6).alias("product"))


@query("J18", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, p_name, s_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")
    part, supplier = table(spark, d, "part").select("p_partkey", "p_name"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    return lines.join(part, F.col("p_partkey") == F.col("l_partkey"), "left").join(supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "p_name", "s_name")


@query("G41", "SELECT k.id, coalesce(a.n, b.n, c.n) AS found FROM (SELECT CAST(range AS BIGINT) AS id FROM range(0, 60)) k LEFT JOIN (SELECT r_regionkey::BIGINT AS id, r_name AS n FROM region) a USING (id) LEFT JOIN (SELECT n_nationkey::BIGINT AS id, n_name AS n FROM nation) b USING (id) LEFT JOIN (SELECT s_suppkey::BIGINT AS id, s_name AS n FROM supplier) c USING (id)")
def first_table_with_key(spark: SparkSession, d: str) -> DataFrame:
    kinds = [table(spark, d, t).select(F.lit(k).alias("place"), F.col(i).cast("long").alias("id"), F.col(n).alias("n")) for k, (t, i, n) in enumerate((("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name")))]
    first = kinds[0].union(kinds[1]).union(kinds[2]).groupBy("id").agg(F.min_by("n", "place").alias("found"))
    return spark.range(60).join(first, "id", "left")


@query("G33", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT DISTINCT FROM NULL OR quality IS NOT DISTINCT FROM 0")
def null_safe_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.where(F.col("quality").eqNullSafe(None) | F.col("quality").eqNullSafe(0))
