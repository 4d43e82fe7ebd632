"""What operators need to run on many machines: the shared folder, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query that has ended leaves no shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written on the way to another one.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets one of its own and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


@contextmanager
def _leaving_none(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder once and read from there however often it is used; joins know its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with _leaving_none(spark):
        df.write.parquet(path)
    if (listed := _written.get()) is not None:
        listed.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_from(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """settled(build(), name); the tables that build settles on its way are deleted after that."""
    mark, spark = _written.set(listed := []), None
    try:
        df = build()
        spark = df.sparkSession
        out = settled(df, name)
        path = listed.pop()
    finally:
        _written.reset(mark)
        for passed in listed if spark is not None else []:
            at = spark._jvm.org.apache.hadoop.fs.Path(passed)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if (outer := _written.get()) is not None:
        outer.append(path)
    return out
