"""Table changes as pure functions: (old rows, changes) -> new rows.

A Parquet folder has no row updates, so each change is a join that rewrites the table; the caller writes
the result to a new path and swaps it in (`swap`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators.ordering import numbered


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the new rows whose key is not there; of new rows with one key the first by all columns."""
    return old.unionByName(first_per_key(new, keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Replaces rows by key; of several new rows with one key the one with the greatest `order` wins."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
    return old.join(last.select(*keys), keys, "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


def first_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    least = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_v"))
    return least.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def get_or_create(old: DataFrame, wanted: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """The old rows and a new row with the next ids for each wanted key that is not there."""
    missing = wanted.select(*keys).distinct().join(old.select(*keys), keys, "left_anti")
    top = old.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))  # one row
    made = numbered(missing, keys, "_n").join(F.broadcast(top)).withColumn(id_, (F.col("_top") + F.col("_n")).cast(old.schema[id_].dataType))
    return old.unionByName(made.select(id_, *keys), allowMissingColumns=True)


def update_where(old: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns in the rows that meet a condition (null counts as not met)."""
    met = F.coalesce(condition, F.lit(False))
    return old.select(*[F.when(met, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])


def update_from(old: DataFrame, other: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Takes a column's value from another table where it has the key and the value is not null."""
    value = other.select(*keys, F.col(column).alias("_value"))
    return old.join(value, keys, "left").select(*[F.coalesce("_value", column).alias(column) if c == column else c for c in old.columns])


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    """Drops the rows that meet a condition; where it is null they stay."""
    return old.where(~F.coalesce(condition, F.lit(False)))


def set_or_clear(old: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Tri-state setter: a value replaces the row, a null removes it."""
    return old.join(changes.select(*keys), keys, "left_anti").select(*old.columns).unionByName(changes.where(F.col(value).isNotNull()).select(*old.columns))


def swap(spark, path: str, new_path: str) -> None:
    """Puts a freshly written folder in the place of the old one, which is kept as `<path>.old`."""
    jvm = spark._jvm
    there, fresh, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new_path, path + ".old"))
    fs = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(kept, True)
    if fs.exists(there):
        fs.rename(there, kept)
    fs.rename(fresh, there)
