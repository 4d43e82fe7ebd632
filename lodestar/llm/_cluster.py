"""Written tables, size-checked joins and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key list of at most this many rows (of 8 to 24 bytes each) may be broadcast.
SMALL_ROWS = 200_000
#: Bytes of an Arrow batch on its way to or from a Python worker, where the session leaves them at Spark's default.
BATCH_BYTES = 4 << 20
# Fixed value: Spark's default for that.
SPARK_BATCH_BYTES = "67108864b"
#: Tables written in this context and not yet deleted.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a local master gets a folder of its own and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts don't add up in a worker; a session's own bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, SPARK_BATCH_BYTES) == SPARK_BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables that an operator writes to the shared folder: lineage is cut there, and a table's size is known to joins.

    What the operator's result doesn't read is deleted by `only` before it returns; the rest lives until `sweeping` ends
    or the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.name, self.paths = spark, name, {}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/tables/{self.name}-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths[name] = path
        if (listed := _written.get()) is not None:
            listed.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name)
            _delete(self.spark, path)
            if (listed := _written.get()) is not None:
                listed.remove(path)

    def only(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])


@contextmanager
def sweeping(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside are deleted at the end, but for those that the body takes off the list."""
    listed: list[str] = []
    mark = _written.set(listed)
    try:
        yield listed
    finally:
        _written.reset(mark)
        for path in listed:
            _delete(spark, path)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that a caller's other columns can't clash with those made here."""
    return df.select(*[df[n] for n in names])


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (stored, distinct). A list of over SMALL_ROWS isn't broadcast but shuffled."""
    small = ids.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in ids (stored, distinct); null keys stay. The counterpart of keep_ids."""
    small = ids.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), key, "left_anti")


def sized(df: DataFrame, items: str | None = None) -> DataFrame:
    """df (stored) with a broadcast hint if it has at most SMALL_ROWS rows, and at most ten times as many entries in
    the array `items`; else it is joined by a shuffle."""
    count = df.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(items)), F.lit(0)) if items else F.lit(0)).first()
    small = count[0] <= SMALL_ROWS and count[1] <= 10 * SMALL_ROWS
    return F.broadcast(df) if small else df.hint("shuffle_merge")


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(id, component) of every id in edges (a, b), written as `name`: component is the smallest id that links reach.

    Each round takes the least label among neighbours and then jumps to that label's own label, so the
    number of rounds grows with the logarithm of a chain's length. Every round is a written table, and goes after the next.
    """
    both = tables(f"{name}-edges", edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct())
    labels = tables(f"{name}-0", both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for i in range(1, 60):
        least = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        nearer = labels.join(least, "id").select("id", "component", F.least("component", "near").alias("near"))
        nearer = tables(f"{name}-near", nearer)
        jump = nearer.select(F.col("id").alias("near"), F.col("near").alias("far"))
        new = nearer.join(jump, "near", "left").select("id", F.col("component").alias("was"), F.least("near", F.coalesce("far", "near")).alias("component"))
        new = tables(f"{name}-{i}", new)
        tables.drop(f"{name}-near", f"{name}-{i - 1}")
        labels = new.select("id", "component")
        if new.where("was <> component").limit(1).count() == 0:
            tables.drop(f"{name}-edges")
            return labels
    raise RuntimeError("components did not settle")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
