"""Quality assurance with votes that may be true, false or null (a conflict)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbers(rows: DataFrame, by: list[str], result: str) -> DataFrame:
    """right (true), total (true or false) and conflicts (null) of each group."""
    r = F.col(result)
    return rows.groupBy(*by).agg(F.count_if(r).alias("right"), F.count(r).alias("total"), F.count_if(r.isNull()).alias("conflicts"))


def consensus(yes: Column, answers: Column, threshold: Column) -> Column:
    """True from the threshold of yes on, false from that of no on, else null."""
    return F.when(yes >= threshold, True).when(answers - yes >= threshold, False)


def votes(rows: DataFrame, hit: list[str], answer: str, threshold: int, max_answers: int | None = None) -> DataFrame:
    """The consensus of each hit. max_answers: no counts as what is missing up to it, as for items that nobody clicked."""
    total = F.count(answer) if max_answers is None else F.lit(max_answers)
    return rows.groupBy(*hit).agg(F.count_if(answer).alias("yes"), total.alias("answers")).withColumn("result", consensus(F.col("yes"), F.col("answers"), F.lit(threshold)))


def minority(rows: DataFrame, hit: list[str], worker: str, answer: str) -> DataFrame:
    """Workers whose answer the smaller side of a hit gave; nobody where all agree or sides are equal."""
    w = Window.partitionBy(*hit)
    yes, n = F.count_if(answer).over(w), F.count(answer).over(w)
    few = F.when((yes == 0) | (yes == n) | (yes * 2 == n), None).otherwise(yes * 2 < n)
    return rows.withColumn("_few", few).where(F.col("_few").isNotNull() & (F.col(answer) == F.col("_few"))).select(*hit, worker)


def explode_items(hits: DataFrame, items: str, clicked: str, seconds: str) -> DataFrame:
    """One row for each item of a hit: whether it was clicked, and its share of the time, rounded up."""
    n = F.size(items)
    rows = hits.withColumn("_time", F.ceil(F.col(seconds) / n)).withColumn("item", F.explode(items))
    return rows.withColumn("answer", F.array_contains(clicked, F.col("item"))).drop(items, clicked, seconds).withColumnRenamed("_time", seconds)


def inventory_change(now: Column, then: Column, ratio: float) -> tuple[Column, Column]:
    """The kind of change (increase, decrease or null) and its size in whole percent."""
    kind = F.when(now > then * ratio, "increase").when(now * ratio < then, "decrease")
    return kind, F.when(then > 0, F.floor(F.abs(now - then) * 100 / then))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
