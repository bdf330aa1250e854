"""Numbering rows in an order without one task for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.checkpoints import ready


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds 1, 2, ... in ascending order (nulls first): range partitions are numbered apart, and of each only
    its row count reaches the driver. Ties of `order` should be equal rows."""
    spark = rows.sparkSession
    ready(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    total, before = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("_part").count().collect())):
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before or [(0, 0)], "_part int, _before long")
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + n).drop("_part", "_before")
