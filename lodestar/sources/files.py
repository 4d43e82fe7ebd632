"""Scanning a folder tree with Spark's binary reader. Nothing is written to it; content is opened only where needed."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import glob_regex
from ..operators.store import describe_paths, needs_hash, snapshot_diff


def walk(spark: SparkSession, root: str, ignore_dirs: tuple[str, ...] = (), ignore_globs: tuple[str, ...] = ()) -> DataFrame:
    """(uri, path, size, mtime) of files below a root, without ignored folders (any case) and names (shell globs).

    Only names, sizes and times are read. A root that isn't there gives an error from the reader.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _quoted(base.removeprefix("file:").rstrip("/")) + "/", "")
    rows = raw.select(F.col("path").alias("uri"), rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))
    parts = F.split("path", "/")
    for name in ignore_dirs:
        rows = rows.where(~F.array_contains(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.lower(p)), name.lower()))
    for glob in ignore_globs:
        rows = rows.where(~F.element_at(parts, -1).rlike(glob_regex(glob)))
    return rows


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def content_hash(content: Column) -> Column:
    """A 128-bit hash."""
    return F.md5(content)


@F.pandas_udf(StringType())
def xxh3(content: pd.Series) -> pd.Series:
    import xxhash

    return content.map(lambda b: None if b is None else xxhash.xxh3_128_hexdigest(b))


def hashed(spark: SparkSession, root: str, rows: DataFrame, max_bytes: int) -> DataFrame:
    """rows with content_hash; files over max_bytes keep a null hash and are never opened.

    The reader is pruned by size before content is read, then joined to the rows by name.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/"))
    h = raw.where(F.col("length") <= max_bytes).select(F.col("path").alias("uri"), "content").join(rows.select("uri"), "uri", "left_semi").select("uri", content_hash(F.col("content")).alias("content_hash"))
    return rows.join(h, "uri", "left")


def scan(spark: SparkSession, root: str, known: DataFrame, max_bytes: int = 50 << 20, ignore_dirs: tuple[str, ...] = (), ignore_globs: tuple[str, ...] = (), full: bool = False, rehash: bool = False) -> tuple[DataFrame, DataFrame]:
    """(seen, diff): the tree as it is, described and hashed where its size or time moved, and its changes against known."""
    seen = describe_paths(walk(spark, root, ignore_dirs, ignore_globs))
    todo = seen if full or rehash else seen.join(needs_hash(known, seen).select("path"), "path", "left_semi")
    fresh = hashed(spark, root, todo.select("uri", "path"), max_bytes).select("path", F.col("content_hash").alias("fresh"))
    old = known.select("path", F.col("content_hash").alias("old"))
    opened = todo.select("path", F.lit(True).alias("opened"))
    seen = seen.join(fresh, "path", "left").join(opened, "path", "left").join(old, "path", "left")
    seen = seen.withColumn("content_hash", F.when(F.col("opened"), F.col("fresh")).otherwise(F.col("old"))).drop("fresh", "old", "opened")
    return seen, snapshot_diff(known, seen, full=full, rehash=rehash)


def summary(seen: DataFrame, diff: DataFrame, max_bytes: int) -> DataFrame:
    """One row of counters of a scan."""
    c = diff.agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("new", "modified", "unchanged", "deleted")])
    return c.crossJoin(seen.agg(F.count_if(F.col("size") > max_bytes).alias("skipped_too_large"), F.sum("size").alias("bytes")))
