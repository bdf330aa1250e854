"""Sharding by a two-pass external shuffle.

Pass one scatters rows into buckets that fit into memory by a seeded hash; pass two loads each bucket,
puts it in a random order by Fisher-Yates with a generator seeded by the bucket, and writes it. The rows
before each bucket are known from a count, so each row learns its place in the whole random order. A shard is
a range of that order, and shards' row counts differ by one at most; a bucket's rows go to one shard, or two,
and each shard is a folder of its own, whose files hold its rows in the order of their slots.

Buckets take whole rows by a hash of the id and the text's checksum, so a hot id does not fill one of
them, except rows that agree in both; these share a bucket. Each bucket is a task of its own (`repartitionById`).

Defined results: a null text counts as no bytes and null ids hash like any value; repeated rows are each
kept; an empty table gives no rows; an input column named as an output column is replaced, all others
pass through. The order depends on the rows and the seed only, not on how the input lies in files.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import SLICE_ROWS, columns_first, map_arrow, running_offsets, shared_dir

#: Bytes of text that a bucket should hold; and the fewest buckets.
BUCKET_BYTES, FEWEST = 16 << 20, 64


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A random order of n rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = list(range(n))
    partners = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = partners[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled(df: DataFrame, id_: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds `place`, each row's place in one random order of all rows (gapless from 0)."""
    kept = columns_first(df, ["place"])
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    total = df.agg(F.sum(size)).first()[0] or 0
    n = max(FEWEST, -(-int(total) // bucket_bytes))
    check = F.crc32(F.coalesce(F.col(text), F.lit("")))
    scattered = df.select(*kept, F.pmod(F.xxhash64(F.lit(seed), F.col(id_), check), F.lit(n)).alias("_bucket"), F.coalesce(check, F.lit(0)).alias("_check"))
    counts = scattered.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    before = running_offsets(counts, "_bucket", "_rows", "_first", "shuffle-buckets").select("_bucket", "_first")
    # a row for each bucket says where it begins, and travels with the bucket's rows
    placed = scattered.withColumn("_first", F.lit(None).cast("long")).unionByName(before, allowMissingColumns=True)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("place", T.LongType())])
    names = [f.name for f in schema]

    def one(bucket: pa.Table) -> pa.Table:
        heads = bucket["_first"].is_valid()
        first, bucket = bucket["_first"].drop_null()[0].as_py(), bucket.filter(pa.compute.invert(heads))
        at = {c: bucket.schema.get_field_index(c) for c in bucket.column_names}
        order = bucket.select([at["_check"]]).append_column("id", bucket.column(at[id_])).append_column("size", pa.compute.fill_null(pa.compute.binary_length(bucket.column(at[text])), 0))
        steady = pa.compute.sort_indices(order, sort_keys=[("id", "ascending"), ("_check", "ascending"), ("size", "ascending")]).to_numpy()
        moved = steady[fisher_yates(bucket.num_rows, [seed, bucket.column(at["_bucket"])[0].as_py()])]
        rows = bucket.take(pa.array(moved)).combine_chunks()
        return pa.Table.from_arrays([*(rows.column(at[c]) for c in kept), pa.array(np.arange(first, first + len(moved)))], names=names)

    def run(batches):
        held = []
        for batch in batches:  # one bucket, or none
            held.append(batch)
        if held:
            yield from one(pa.Table.from_batches(held)).to_batches(max_chunksize=SLICE_ROWS)

    return map_arrow(placed.repartitionById(n, F.col("_bucket").cast("int")), run, schema)


def ranged(df: DataFrame, shards: int, rows: int, place: str = "place") -> DataFrame:
    """Adds `shard` and `slot`: the places cut into ranges, of which the first few hold one row more."""
    kept = columns_first(df, ["shard", "slot"])
    size, more = divmod(rows, shards)
    at, long_ = F.col(place), more * (size + 1)
    late = F.lit(more) + F.floor((at - long_) / max(1, size))
    shard = F.when(at < long_, F.floor(at / (size + 1))).otherwise(late).cast("int")
    first = F.when(at < long_, shard * (size + 1)).otherwise(long_ + (shard - more) * size)
    return df.select(*kept, shard.alias("shard"), (at - first).cast("long").alias("slot"))


def write_shards(df: DataFrame, shards: int, id_: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """Shuffles all rows and writes each shard as a folder `shard=k` in the shared folder; reads them again."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/shards-{uuid.uuid4().hex}"
    found = ranged(shuffled(df, id_, text, seed), shards, df.count())
    found.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(found.schema).parquet(path).select(*found.columns)
