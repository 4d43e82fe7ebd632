"""How the engine's tables are read from the driver's star schema, for queries and their oracles alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its oracle."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return keep


#: Files: customers in their nation and region.
FILES = """
files AS (
  SELECT c_custkey AS file_id, r_name || '/' || n_name || '/' || c_name || CASE c_custkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' ELSE '.CSV' END AS path,
    r_name || '/' || n_name AS folder, CASE c_custkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' ELSE '.csv' END AS ext,
    CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS size, DATE '2024-01-01' + CAST(c_custkey % 400 AS INTEGER) AS mtime,
    CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE md5(c_name) END AS content_hash, CASE WHEN c_custkey % 17 = 0 THEN 'deleted' ELSE 'present' END AS status
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
"""
#: Entity postings: parts of orders, with the return flag as category.
ENTITIES = "entities AS (SELECT l_orderkey AS file_id, CAST(l_partkey AS VARCHAR) AS normalised, l_returnflag AS category FROM lineitem)"
#: Date mentions: ship dates of orders, with the order date as the file's time. A day at a supplier is what recurs, as every day alone is common.
MENTIONS = """
mentions AS (
  SELECT l_orderkey AS file_id, l_linenumber AS start, l_suppkey AS place, CAST(l_shipdate AS DATE) AS iso_date, CAST(o_orderdate AS DATE) AS mtime, l_returnflag = 'A' AS in_tabular,
    CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'year' ELSE 'day' END AS precision
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
"""
VECTORS = "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    kind = lambda *x: F.element_at(F.array(*[F.lit(e) for e in x]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return rows.select(
        F.col("c_custkey").alias("file_id"), F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), "c_name", kind(".md", ".txt", ".py", ".CSV")).alias("path"),
        F.concat("r_name", F.lit("/"), "n_name").alias("folder"), kind(".md", ".txt", ".py", ".csv").alias("ext"), F.floor(F.abs("c_acctbal") * 100).cast("long").alias("size"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 400).cast("int")).alias("mtime"),
        F.when(F.col("c_custkey") % 23 != 0, F.md5("c_name")).alias("content_hash"), F.when(F.col("c_custkey") % 17 == 0, "deleted").otherwise("present").alias("status"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").cast("string").alias("normalised"), F.col("l_returnflag").alias("category"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")  # noqa: E741
    rows = l.join(o, l.l_orderkey == o.o_orderkey)
    return rows.select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("start"), F.col("l_suppkey").alias("place"), F.col("l_shipdate").cast("date").alias("iso_date"), F.col("o_orderdate").cast("date").alias("mtime"),
        (F.col("l_returnflag") == "A").alias("in_tabular"), F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), "year").otherwise("day").alias("precision"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("block_index"), F.col("role").alias("kind"), F.col("role").alias("label"), "text", (F.col("role") == "assistant").alias("is_tabular"), (F.col("role") == "system").alias("is_heading"))


BLOCKS = "blocks AS (SELECT conv_id AS file_id, turn AS block_index, role AS kind, role AS label, text, role = 'assistant' AS is_tabular, role = 'system' AS is_heading FROM conversations)"
