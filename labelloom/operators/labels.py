"""The label engine: page scores, human overrides, roll-up over the label graph, and the delta of labels."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.joins import closure, longest_path_rank, phrase_join, ranks, suffix_join


def keyword_scores(pages: DataFrame, keywords: DataFrame, longest: int) -> DataFrame:
    """pages: page_id, title_tokens, body_tokens; keywords: label_id, phrase, title_weight, body_weight.

    A phrase counts its title weight where the title holds it and that weight is not 0, else its body
    weight where the body holds it.
    """
    sides = pages.select("page_id", F.explode(F.array(F.struct(F.lit(True).alias("title"), F.col("title_tokens").alias("tokens")), F.struct(F.lit(False).alias("title"), F.col("body_tokens").alias("tokens")))).alias("s"))
    sides = sides.select("page_id", "s.title", "s.tokens")
    hits = phrase_join(sides, "tokens", F.broadcast(keywords), "phrase", longest).groupBy("page_id", "label_id", "phrase", "title_weight", "body_weight").agg(F.bool_or("title").alias("in_title"), F.bool_or(~F.col("title")).alias("in_body"))
    weight = F.when(F.col("in_title") & (F.col("title_weight") != 0), F.col("title_weight")).when(F.col("in_body"), F.col("body_weight")).otherwise(0)
    return hits.select("page_id", "label_id", weight.cast("long").alias("score"))


def target_scores(text_results: DataFrame, video_results: DataFrame, active: DataFrame, weights: DataFrame) -> DataFrame:
    """text_results: page_id, target_id; video_results: video_id, target_id; active: page_id, video_id;
    weights: label_id, target_id, weight. A text result counts once, a video result once for each active video."""
    once = text_results.select("page_id", "target_id").distinct()
    each = active.distinct().join(video_results.distinct(), "video_id").select("page_id", "target_id")
    return once.unionByName(each).join(F.broadcast(weights), "target_id").select("page_id", "label_id", F.col("weight").cast("long").alias("score"))


def domain_scores(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages: page_id, host; rules: label_id, domain, weight."""
    return suffix_join(pages, "host", F.broadcast(rules), "domain").select("page_id", "label_id", F.col("weight").cast("long").alias("score"))


def page_scores(*parts: DataFrame) -> DataFrame:
    """The sum of all scores of a page and label."""
    return reduce(DataFrame.unionByName, parts).groupBy("page_id", "label_id").agg(F.sum("score").alias("score"))


def overrides(results: DataFrame, edges: DataFrame) -> DataFrame:
    """results: page_id, label_id, level (greater goes first), result -> the verdict that holds.

    Of several verdicts that of the greatest level holds. A False reaches all descendants, over their own True.
    """
    held = results.groupBy("page_id", "label_id").agg(F.max_by("result", "level").alias("result"))
    below = closure(edges, "parent_id", "child_id")
    spread = held.where("NOT result").join(below, F.col("label_id") == F.col("ancestor"), "left").select("page_id", F.coalesce("node", "label_id").alias("label_id"), F.lit(False).alias("result"))
    return held.unionByName(spread).groupBy("page_id", "label_id").agg(F.bool_and("result").alias("result"))


#: Labels, and edges between them, that go into one expression at most.
SMALL_LABELS = 500


def _rolled_up(scores: DataFrame, edges: list[dict], thresholds: dict[int, int], verdicts: DataFrame) -> DataFrame:
    """roll_up() in one pass: a page's scores and verdicts become maps, and the labels, deepest first, are folded
    over the list of those that are true so far."""
    rank = ranks([(e["parent_id"], e["child_id"]) for e in edges])
    order = sorted(thresholds, key=lambda x: (-rank.get(x, 0), x))
    kind = "struct<label:bigint,threshold:bigint,children:array<struct<child:bigint,weight:bigint>>>"
    visited = [{"label": x, "threshold": thresholds[x], "children": [{"child": e["child_id"], "weight": e["weight"]} for e in edges if e["parent_id"] == x]} for x in order]
    visits = F.from_json(F.lit(json.dumps(visited)), f"array<{kind}>")  # a literal, folded once
    own = scores.groupBy("page_id", "label_id").agg(F.sum("score").cast("long").alias("score")).select("page_id", F.struct("label_id", "score").alias("s"), F.lit(None).cast("struct<label_id:bigint,result:boolean>").alias("v"))
    said = verdicts.groupBy("page_id", "label_id").agg(F.bool_and("result").alias("result")).select("page_id", F.lit(None).cast("struct<label_id:bigint,score:bigint>").alias("s"), F.struct("label_id", "result").alias("v"))
    pages = own.unionByName(said).groupBy("page_id").agg(F.map_from_entries(F.collect_list("s")).alias("s"), F.map_from_entries(F.collect_list("v")).alias("v"))

    def visit(true, x):
        score, held = F.element_at("s", x["label"]), F.filter(x["children"], lambda c: F.array_contains(true, c["child"]))
        total = F.coalesce(score, F.lit(0)) + F.aggregate(held, F.lit(0).cast("long"), lambda a, c: a + c["weight"])
        reached = (score.isNotNull() | (F.size(held) > 0)) & (total >= x["threshold"])
        return F.when(~F.map_contains_key("v", x["label"]) & reached, F.array_append(true, x["label"])).otherwise(true)

    first = F.map_keys(F.map_filter("v", lambda _, result: result))
    return pages.select("page_id", F.explode(F.aggregate(visits, first, visit)).alias("label_id"))


def roll_up(scores: DataFrame, edges: DataFrame, labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """True labels of each page (page_id, label_id).

    scores: page_id, label_id, score; edges: parent_id, child_id, weight; labels: label_id, threshold;
    verdicts: page_id, label_id, result. Labels are visited deepest first: a label's score grows by the
    weight of each true child, and it is true from its threshold on; a verdict goes before any score. With at
    most SMALL_LABELS labels and edges these go into one expression over each page's scores (`_rolled_up`). With
    more, each step handles all pages and all labels of one rank, so there are as many steps as the graph is deep.
    """
    some, graph = labels.limit(SMALL_LABELS + 1).collect(), edges.limit(SMALL_LABELS + 1).collect()
    if max(len(some), len(graph)) <= SMALL_LABELS:
        return _rolled_up(scores, [r.asDict() for r in graph], {r["label_id"]: r["threshold"] for r in some}, verdicts)
    ranks = longest_path_rank(edges, "parent_id", "child_id")
    ranked = labels.join(ranks, F.col("label_id") == F.col("node"), "left").select("label_id", "threshold", F.coalesce("rank", F.lit(0)).alias("rank"))
    true = verdicts.where("result").select("page_id", "label_id").checkpoint()
    for depth in sorted((r[0] for r in ranked.select("rank").distinct().collect()), reverse=True):  # a number for each level of the label graph
        here = F.broadcast(ranked.where(F.col("rank") == depth).select("label_id", "threshold"))
        up = edges.select(F.col("child_id").alias("label_id"), "parent_id", "weight").join(here.withColumnRenamed("label_id", "parent_id"), "parent_id").drop("threshold")
        gained = true.join(F.broadcast(up), "label_id").select("page_id", F.col("parent_id").alias("label_id"), F.col("weight").cast("long").alias("score"))
        own = scores.join(here, "label_id", "left_semi").select("page_id", "label_id", "score")
        total = own.unionByName(gained).groupBy("page_id", "label_id").agg(F.sum("score").alias("score")).join(here, "label_id").where("score >= threshold")
        fresh = total.select("page_id", "label_id").join(verdicts.select("page_id", "label_id"), ["page_id", "label_id"], "left_anti")
        true = true.unionByName(fresh).checkpoint()
    return true.distinct()


def delta(calculated: DataFrame, existing: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(change, page_id, label_id): calculated labels that are missing are added; existing ones that were not
    calculated are deleted, in partial mode only those among the expected."""
    keys = ["page_id", "label_id"]
    add = calculated.select(*keys).distinct().join(existing, keys, "left_anti")
    gone = existing.select(*keys).distinct().join(calculated, keys, "left_anti")
    if expected is not None:
        gone = gone.join(expected, keys, "left_semi")
    return add.select(F.lit("add").alias("change"), *keys).unionByName(gone.select(F.lit("delete").alias("change"), *keys))


def candidates(labels: DataFrame, related: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels to calculate: those with a keyword or target, and all their ancestors."""
    up = closure(edges, "parent_id", "child_id")
    above = related.select("label_id").distinct().join(up, F.col("label_id") == F.col("node")).select(F.col("ancestor").alias("label_id"))
    return related.select("label_id").unionByName(above).distinct().join(labels, "label_id", "left_semi")


def last_detection(active: DataFrame, videos: DataFrame) -> DataFrame:
    """page_id, last: null if a page has no active video or any without a detection, else the earliest."""
    seen = active.join(videos, "video_id", "left")
    return seen.groupBy("page_id").agg(F.when(F.count("*") == F.count("last_detection"), F.min("last_detection")).alias("last"))


def crawl_merge(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """stored: page_id, video_id, active, seen_count; seen: page_id, video_id -> the rows after a crawl.

    On crawled pages all videos become inactive but those seen, which count once more; new ones start at 1.
    `changed` says whether the page's active set did.
    """
    keys = ["page_id", "video_id"]
    crawled = seen.select("page_id").distinct()
    joined = stored.join(seen.distinct().withColumn("_seen", F.lit(True)), keys, "full").join(crawled.withColumn("_crawled", F.lit(True)), "page_id", "left")
    is_seen = F.coalesce("_seen", F.lit(False))
    was = F.coalesce("active", F.lit(False))
    active = F.when(F.col("_crawled"), is_seen).otherwise(was)
    rows = joined.select(*keys, active.alias("active"), (F.coalesce("seen_count", F.lit(0)) + is_seen.cast("int")).cast("long").alias("seen_count"), (active != was).alias("_moved"))
    moved = rows.groupBy("page_id").agg(F.bool_or("_moved").alias("changed"))
    return rows.drop("_moved").join(moved, "page_id")
