"""File formats that the library reads and writes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.sources.merges import insert_ignore, upsert

#: The record kinds of a detector log, with the columns after the kind. Fixed values.
LOG_KINDS = {
    "VDR": ("video_id", "clf_target_id"),
    "IDR": ("video_id", "time", "clf_target_id"),
    "BDR": ("box_id", "clf_target_id"),
    "TDR": ("page_id", "clf_target_id"),
    "TBR": ("box_id", "text"),
}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST")


def bulk_load(old: DataFrame, path: str, keys: list[str], on_duplicate: str) -> DataFrame:
    """Loads a delimited file into a table: on_duplicate `ignore` keeps old rows, `replace` takes the file's last."""
    if on_duplicate not in ("ignore", "replace"):
        raise ValueError(f"on_duplicate is {on_duplicate!r}")
    new = read_tsv(old.sparkSession, path, old.schema)
    if on_duplicate == "ignore":
        return insert_ignore(old, new, keys)
    numbered = new.withColumn("_line", F.monotonically_increasing_id())
    return upsert(old, numbered, keys, "_line")


def log_fields(lines: DataFrame, line: str = "value") -> DataFrame:
    """Log lines as (kind, fields); an unknown kind raises when the row is computed."""
    parts = F.split(line, "\t")
    kind = parts[0]
    known = kind.isin(*LOG_KINDS)
    checked = F.when(known, kind).otherwise(F.raise_error(F.concat(F.lit("unknown record kind: "), kind)).cast("string"))
    return lines.select(checked.alias("kind"), F.slice(parts, 2, 10).alias("fields"))


def demux(lines: DataFrame, line: str = "value") -> dict[str, DataFrame]:
    """One table for each record kind of a detector log."""
    rows = log_fields(lines, line)
    return {
        kind: rows.where(F.col("kind") == kind).select(*[F.get("fields", F.lit(k)).cast("string" if c == "text" else "long").alias(c) for k, c in enumerate(columns)])
        for kind, columns in LOG_KINDS.items()
    }


def statements(script: str) -> list[str]:
    """The statements of a script, parted at semicolons outside quotes and comments."""
    found = [""]
    for token in re.findall(r"--[^\n]*|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|;|[^;'\"`-]+|.", script, re.S):
        if token == ";":
            found.append("")
        elif not token.startswith("--"):
            found[-1] += token
    return [s.strip() for s in found if s.strip()]


def run_script(spark: SparkSession, script: str) -> DataFrame | None:
    """Runs each statement; gives the last one's rows."""
    out = None
    for s in statements(script):
        out = spark.sql(s)
    return out


def text_of(ids: DataFrame, store: DataFrame, id_: str, text: str, silent: bool = True) -> DataFrame:
    """Batch get from a text store: a missing key gives an empty text, or raises if not silent."""
    found = ids.join(store.select(id_, F.col(text).alias("_text"), F.lit(True).alias("_there")), id_, "left")
    missing = F.raise_error(F.concat(F.lit("no text for "), F.col(id_).cast("string"))).cast("string")
    value = F.coalesce("_text", F.lit(""))
    return found.select(id_, (value if silent else F.when(F.col("_there"), value).otherwise(missing)).alias(text))


def to_libsvm(topics: DataFrame, label: str, pairs: str) -> DataFrame:
    """Lines of libsvm text from an array of (index, value) structs, by ascending index."""
    entry = F.transform(F.array_sort(F.col(pairs)), lambda p: F.concat_ws(":", p["index"].cast("string"), p["value"].cast("string")))
    return topics.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(entry, " ")).alias("value"))


def labelled_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, label) of all files below a folder; the label is the name of a file's own folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"))


def path_label(path):
    """The label in a file name of the form <label>__<rest>.jpg."""
    return F.regexp_extract(path, r"([^/]+)__[^/]+\.jpg$", 1)
