"""Schemas of the stored tables, their version, and reading snapshots of an older one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 9
TABLES = {
    "meta": "key string, value string",
    "files": "file_id long, path string, abs_path string, name string, stem string, ext string, folder string, depth int, size long, mtime timestamp_ntz, content_hash string, status string, first_seen timestamp_ntz, last_seen timestamp_ntz, content_changed_at timestamp_ntz",
    "scan_runs": "id long, root string, started_at timestamp, finished_at timestamp, duration_ms double, full_rescan boolean, dry_run boolean, seen long, new long, modified long, unchanged long, deleted long, skipped_too_large long, bytes long",
    "scan_errors": "id long, scan_id long, path string, stage string, message string, at timestamp",
    "documents": "file_id long, path string, extractor string, ok boolean, error string, warnings array<string>, meta map<string,string>, text string, char_count long, word_count long, block_count long, has_tabular boolean, truncated boolean, content_hash string, extracted_at timestamp",
    "document_blocks": "file_id long, block_index int, kind string, label string, text string, is_tabular boolean, is_heading boolean, row_count int, char_start long, char_end long",
    "entities": "file_id long, text string, normalised string, category string, char_start int, char_end int",
    "keywords": "file_id long, term string, count long, rank int",
    "date_mentions": "file_id long, start int, end int, surface string, source string, iso_date date, precision string, in_tabular boolean, year_inferred boolean",
    "entity_runs": "file_id long, content_hash string, error string, duration_ms double, run_at timestamp",
    "embeddings": "file_id long, content_hash string, chunk_count long, model string, embedded_at timestamp",
    "tree_nodes": "node_id string, kind string, label string, parent_id string, file_id long, rel_path string, summary string, depth int, file_count long, v array<double>",
    "classified_dates": "file_id long, iso_date date, surface string, start int, end int, precision string, score double, is_meaningful boolean, sig_keyword double, sig_structured double, sig_metadata double, sig_crossfile double, reason string",
    "sessions": "session_id string, label string, kind string, start_at timestamp_ntz, end_at timestamp_ntz, size long, cohesion double, keywords array<string>, entities array<string>, dates array<date>",
    "session_members": "session_id string, file_id long, path string",
    "feedback": "query_norm string, file_id long, path string, event string, weight double, created_at timestamp",
    "last_query": "query_id long, text string, rank int, file_id long, path string, score double, signals map<string,double>, weights map<string,double>, contributions map<string,double>, dominant string, reasons array<string>, complete boolean",
    "migrations": "version int, at timestamp",
    "chunks": "chunk_id string, file_id long, chunk_index int, text string, is_tabular boolean, block_kinds string, v array<float>",
    "vertices": "id string, kind string",
    "edges": "src string, dst string, type string, weight double",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of a table: missing ones are null, others go."""
    want = T._parse_datatype_string(TABLES[name])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest snapshot of a table, whatever version wrote it; a table that isn't there is empty."""
    try:
        versions = spark.read.parquet(f"{root}/{name}")
    except AnalysisException:
        return empty(spark, name)
    newest = versions.agg(F.max("snapshot")).first()[0]
    return conform(versions.where(F.col("snapshot") == newest).drop("snapshot"), name)


def newest(spark: SparkSession, root: str, name: str) -> int:
    """The number of a table's newest snapshot, 0 if it has none."""
    try:
        return spark.read.parquet(f"{root}/{name}").agg(F.max("snapshot")).first()[0] or 0
    except AnalysisException:
        return 0


def migrate(spark: SparkSession, root: str) -> list[int]:
    """The versions applied now, each recorded once. Tables are made conform when they are read, so a step only has to note that it is there."""
    done = {r.version for r in read(spark, root, "migrations").collect()}
    todo = [v for v in range(1, VERSION + 1) if v not in done]
    if todo:
        rows = read(spark, root, "migrations").unionByName(spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in todo])).alias("version"), F.current_timestamp().alias("at")))
        write(rows, root, "migrations", newest(spark, root, "migrations") + 1)
    return todo


def write(df: DataFrame, root: str, name: str, v: int) -> None:
    """Snapshot number v of a table. Earlier ones stay, as the data may be read from them."""
    conform(df, name).write.mode("overwrite").parquet(f"{root}/{name}/snapshot={v}")
