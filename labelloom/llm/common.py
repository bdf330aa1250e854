"""What the operators of this package share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python operator handles at a time; only memory depends on it.
SLICE_ROWS = 256
#: Bytes of an Arrow batch between the JVM and a Python worker (one row at least); only memory depends on it.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or, only where that is
    unset (local tests), a new local one, which is then set for this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="labelloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost
    executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a DataFrame from materialise() that no later step reads."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def columns_first(df: DataFrame, added: Iterable[str]) -> list[str]:
    """The columns that an operator passes on: an input column with the name of an output column is replaced."""
    names = set(added)
    return [c for c in df.columns if c not in names]


def map_slices(
    df: DataFrame,
    schema: T.StructType,
    open_: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch]],
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """mapInArrow by slices of few rows, so that a batch of very long texts is never held twice as a whole.

    open_() runs once in each task and returns what turns a slice into one batch or several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = open_()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = handle(batch.slice(at, rows))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return map_arrow(df, run, schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow by batches of BATCH_BYTES, whose worker gives back what it held when the task ends: workers
    serve many tasks, so what each kept would add up from stage to stage."""

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    spark = df.sparkSession
    if int(spark.conf.get(_BATCH, str(BATCH_BYTES + 1)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(freeing, schema)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Hands freed memory back to the system."""
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def add_columns(
    df: DataFrame,
    added: list[T.StructField],
    open_: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """df with columns computed in Python from each slice; the others pass through unchanged."""
    kept = columns_first(df, [f.name for f in added])
    schema = T.StructType([df.schema[c] for c in kept] + added)
    names = [f.name for f in schema]

    def start():
        handle = open_()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = handle(batch)
            held = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            return pa.RecordBatch.from_arrays([*held, *new], names=names)

        return one

    return map_slices(df, schema, start, rows)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A column's strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def fold_of(doc_id: str, mod: int):
    """crc32 of the id as text, modulo mod; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string")) % mod


def bounded_sample(df: DataFrame, key: str, max_rows: int, by: str | None = None) -> DataFrame:
    """At most max_rows rows (of each value of `by`), those of least hash of a key without nulls; equal keys
    are in the order of their further columns, so a key repeated over and over stays within the bound.

    A count first sets the share of hashes that can matter, so what is sorted is bounded too, however
    many rows there are; where the count is below max_rows, all rows stay. The counts of `by` are broadcast
    up to MAX_KEYS values; of more, each has few rows on average, and the join deals them out by value.
    """
    from pyspark.sql import Window

    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    order = [place, *[c for c in df.columns if c != by]]
    near = lambda n: F.lit(1.5 * max_rows + 100) / n * F.lit(float(1 << 40))
    if by is None:
        n = max(1, df.count())
        return df.where(place <= near(F.lit(float(n)))).orderBy(*order).limit(max_rows)
    counts = materialise(df.groupBy(by).agg(F.count("*").alias("_all")), "sample-counts")
    sent = F.broadcast(counts) if counts.count() <= MAX_KEYS else counts
    few = df.join(sent, by).where(place <= near(F.col("_all"))).drop("_all")
    w = Window.partitionBy(by).orderBy(*order)
    return few.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_rows).drop("_n")


#: Values whose counts are broadcast at most.
MAX_KEYS = 100_000


def running_offsets(df: DataFrame, order: str, value: str, out: str, label: str) -> DataFrame:
    """df, written in ascending order, with the sum of `value` over all rows before each row as `out`.

    Range partitions are summed apart and only a sum for each partition reaches the driver; within a
    partition a window adds up. Ties of `order` are put in the order of all further columns.
    """
    spark = df.sparkSession
    from pyspark.sql import Window

    base = [c for c in df.columns if c not in ("_segment", "_before", out)]
    ties = [c for c in base if c != order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(*base).repartitionByRange(parts, F.col(order).asc_nulls_first(), *ties).withColumn("_segment", F.spark_partition_id())
    placed = materialise(placed, label)
    sums = {r[0]: r[1] or 0 for r in placed.groupBy("_segment").agg(F.sum(value)).collect()}
    total, before = 0, []
    for k in sorted(sums):
        before.append((k, total))
        total += sums[k]
    offsets = spark.createDataFrame(before or [(0, 0)], "_segment int, _before long")
    w = Window.partitionBy("_segment").orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(F.broadcast(offsets), "_segment").withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(w), F.lit(0)))
    return summed.select(*base, out)
