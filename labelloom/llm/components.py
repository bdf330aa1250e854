"""Connected components of a link table, by large-star and small-star steps.

Each step is a join and an aggregation over links; nothing about nodes reaches the driver but a count and
a checksum. Each round's links are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import forget, materialise


def _nearest(links: DataFrame) -> DataFrame:
    """hi > lo links -> for each node the least of itself and its neighbours, as `least`, with all neighbours."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links between long ids -> (node, root): for each linked node the least node that it reaches.

    Null ends and links of a node to itself are left out; repeated links count once.
    """
    hi_lo = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
    now, sign = materialise(hi_lo.distinct(), "links"), None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if tuple(found) == sign:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        sign = tuple(found)
        large = _nearest(now).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("x"), F.col("m"))
        after = small.where("x > m").select(F.col("x").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct()
        before, now = now, materialise(after, "links")
        forget(before)
