"""Queries of the relational store: reads, change detection, votes and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import store as S
from .tables import ENTITIES, FILES, MENTIONS, entities, files, mentions, query, table

_SEEN = """
seen AS (
  SELECT path, CASE WHEN file_id % 7 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN file_id % 5 = 0 THEN mtime + 1 ELSE mtime END AS mtime,
    CASE WHEN file_id % 14 = 0 THEN md5(path) ELSE content_hash END AS content_hash FROM files WHERE file_id % 10 <> 1
), known AS (SELECT path, size, mtime, content_hash FROM files WHERE file_id % 10 <> 0)
"""


def _sides(spark, sf_dir):
    f = files(spark, sf_dir)
    moved = lambda c, n, x: F.when(F.col("file_id") % n == 0, x).otherwise(F.col(c)).alias(c)
    seen = f.where("file_id % 10 <> 1").select("path", moved("size", 7, F.col("size") + 1), moved("mtime", 5, F.date_add("mtime", 1)), moved("content_hash", 14, F.md5("path")))
    return f.where("file_id % 10 <> 0").select("path", "size", "mtime", "content_hash"), seen


@query(f"WITH {FILES} SELECT file_id, path, folder, size FROM files WHERE status = 'present'")
def present_files(spark, sf_dir):
    return S.present(files(spark, sf_dir)).select("file_id", "path", "folder", "size")


@query(f"WITH {FILES} SELECT ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE status = 'present' GROUP BY ext")
def extension_counts(spark, sf_dir):
    return S.present(files(spark, sf_dir)).groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"""WITH {FILES} SELECT path, regexp_extract(path, '([^/]+)$', 1) AS name, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS stem, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth FROM files""")
def path_parts(spark, sf_dir):
    return S.describe_paths(files(spark, sf_dir).select("path"))


@query(f"""WITH {FILES}, {_SEEN} SELECT coalesce(s.path, k.path) AS path,
  CASE WHEN k.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'deleted' WHEN s.size = k.size AND s.mtime = k.mtime THEN 'unchanged' WHEN s.content_hash = k.content_hash THEN 'unchanged' ELSE 'modified' END AS change,
  CASE WHEN k.path IS NOT NULL AND s.path IS NOT NULL AND NOT (s.size = k.size AND s.mtime = k.mtime) AND coalesce(s.content_hash = k.content_hash, FALSE) THEN TRUE ELSE FALSE END AS touched
  FROM seen s FULL OUTER JOIN known k ON s.path = k.path""")
def snapshot_diff(spark, sf_dir):
    return S.snapshot_diff(*_sides(spark, sf_dir)).withColumn("touched", F.coalesce("touched", F.lit(False)))


@query(f"WITH {FILES}, {_SEEN} SELECT s.path FROM seen s LEFT JOIN known k ON s.path = k.path AND s.size = k.size AND s.mtime = k.mtime WHERE k.path IS NULL")
def paths_to_hash(spark, sf_dir):
    return S.needs_hash(*_sides(spark, sf_dir)).select("path")


@query(f"""WITH {FILES}, {_SEEN} SELECT count(*) FILTER (WHERE k.path IS NULL OR (NOT (s.size = k.size AND s.mtime = k.mtime) AND NOT coalesce(s.content_hash = k.content_hash, FALSE))) / count(*) AS touched_fraction
  FROM seen s LEFT JOIN known k ON s.path = k.path""")
def touched_fraction(spark, sf_dir):
    return S.touched_fraction(S.snapshot_diff(*_sides(spark, sf_dir)))


@query(f"""WITH {FILES}, {_SEEN} SELECT coalesce(s.path, k.path) AS path, coalesce(s.size, k.size) AS size, coalesce(s.mtime, k.mtime) AS mtime, coalesce(s.content_hash, k.content_hash) AS content_hash,
  CASE WHEN s.path IS NULL THEN 'deleted' ELSE 'present' END AS status, CASE WHEN k.path IS NULL THEN 'new' ELSE 'old' END AS first_seen,
  CASE WHEN s.path IS NOT NULL THEN 'new' ELSE 'old' END AS last_seen, CASE WHEN k.path IS NULL OR (s.path IS NOT NULL AND s.content_hash <> k.content_hash) THEN 'new' ELSE 'old' END AS content_changed
  FROM seen s FULL OUTER JOIN known k ON s.path = k.path""")
def upsert_files(spark, sf_dir):
    known, seen = _sides(spark, sf_dir)
    was = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    known = known.withColumns({"status": F.lit("present"), "first_seen": was, "last_seen": was, "content_changed_at": was})
    out = S.upsert_files(known, seen, "2025-01-01 00:00:00")
    age = lambda c: F.when(F.year(c) == 2025, "new").otherwise("old")
    return out.select("path", "size", "mtime", "content_hash", "status", age("first_seen").alias("first_seen"), age("last_seen").alias("last_seen"), age("content_changed_at").alias("content_changed"))


@query(f"WITH {FILES}, {_SEEN} SELECT k.path, CASE WHEN s.path IS NULL THEN 'deleted' ELSE 'present' END AS status FROM known k LEFT JOIN seen s ON s.path = k.path")
def tombstones(spark, sf_dir):
    known, seen = _sides(spark, sf_dir)
    return S.tombstones(known.withColumn("status", F.lit("present")), seen).select("path", "status")


@query(f"WITH {FILES} SELECT count(*) AS kept FROM files WHERE status <> 'deleted'")
def purge_deleted(spark, sf_dir):
    return S.purge_deleted(files(spark, sf_dir)).agg(F.count(F.lit(1)).alias("kept"))


_DONE = "done AS (SELECT file_id, CASE WHEN file_id % 6 = 0 THEN md5(path) WHEN file_id % 29 = 0 THEN NULL ELSE content_hash END AS content_hash FROM files WHERE file_id % 9 <> 0)"


@query(f"WITH {FILES}, {_DONE} SELECT f.file_id, f.path FROM files f LEFT JOIN done d ON f.file_id = d.file_id WHERE f.status = 'present' AND (d.file_id IS NULL OR f.content_hash IS DISTINCT FROM d.content_hash)")
def staleness_diff(spark, sf_dir):
    f = files(spark, sf_dir)
    done = f.where("file_id % 9 <> 0").select("file_id", F.when(F.col("file_id") % 6 == 0, F.md5("path")).when(F.col("file_id") % 29 == 0, None).otherwise(F.col("content_hash")).alias("content_hash"))
    return S.needs_work(f, done).select("file_id", "path")


@query(f"WITH {FILES} SELECT file_id, ext, 'old' AS origin FROM files WHERE file_id % 3 <> 0 UNION ALL SELECT file_id, upper(ext), 'new' FROM files WHERE file_id % 3 = 0")
def replace_per_file(spark, sf_dir):
    f = files(spark, sf_dir).select("file_id", "ext")
    changed = f.where("file_id % 3 = 0")
    return S.replace_for(f.withColumn("origin", F.lit("old")), changed, changed.select("file_id", F.upper("ext").alias("ext"), F.lit("new").alias("origin")))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def latest_upsert(spark, sf_dir):
    return S.latest_wins(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query(f"WITH {ENTITIES} SELECT normalised, category, count(DISTINCT file_id) AS votes FROM entities GROUP BY 1, 2")
def entity_votes(spark, sf_dir):
    return S.category_votes(entities(spark, sf_dir))


@query(f"""WITH {ENTITIES}, v AS (SELECT normalised, category, count(DISTINCT file_id) AS votes FROM entities GROUP BY 1, 2),
  w AS (SELECT normalised, max(votes) AS most, count(*) FILTER (WHERE votes = m) AS tied, min(category) FILTER (WHERE votes = m) AS winner FROM (SELECT *, max(votes) OVER (PARTITION BY normalised) AS m FROM v) GROUP BY 1)
  SELECT e.file_id, e.normalised, CASE WHEN w.tied = 1 THEN w.winner ELSE e.category END AS category, count(*) AS n FROM entities e JOIN w USING (normalised) GROUP BY 1, 2, 3""")
def entity_reconcile(spark, sf_dir):
    return S.reconcile(entities(spark, sf_dir)).groupBy("file_id", "normalised", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENTITIES} SELECT category || ':' || normalised AS key, list_sort(list(DISTINCT file_id)) AS files FROM entities GROUP BY 1")
def entity_index(spark, sf_dir):
    return S.entity_index(entities(spark, sf_dir))


@query(f"WITH {MENTIONS} SELECT iso_date, count(DISTINCT file_id) AS files FROM mentions GROUP BY 1")
def date_recurrence(spark, sf_dir):
    return S.date_recurrence(mentions(spark, sf_dir))


@query(f"WITH {MENTIONS} SELECT count(*) FILTER (WHERE in_tabular) AS meaningful, count(*) FILTER (WHERE NOT in_tabular) AS incidental FROM mentions")
def verdict_totals(spark, sf_dir):
    return S.verdict_totals(mentions(spark, sf_dir).withColumn("is_meaningful", F.col("in_tabular")))


def feedback(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error"))
    return e.select("event_id", (F.col("user_id") % 20).cast("string").alias("query_norm"), (F.col("event_id") % 500).alias("file_id"), F.when(F.col("event_type") == "error", "reject").otherwise("pick").alias("event"), F.col("value").alias("weight"), "ts")


FEEDBACK = "feedback AS (SELECT event_id, CAST(user_id % 20 AS VARCHAR) AS query_norm, event_id % 500 AS file_id, CASE WHEN event_type = 'error' THEN 'reject' ELSE 'pick' END AS event, value AS weight, ts FROM events WHERE event_type IN ('click', 'error'))"


@query(f"WITH {FEEDBACK} SELECT query_norm, file_id, round(sum(CASE WHEN event = 'reject' THEN -weight ELSE weight END), 5) AS net FROM feedback GROUP BY 1, 2")
def feedback_net(spark, sf_dir):
    return S.feedback_net(feedback(spark, sf_dir)).withColumn("net", F.round("net", 5))


@query(f"WITH {FEEDBACK} SELECT event_id, query_norm, file_id FROM feedback ORDER BY ts DESC, event_id DESC LIMIT 50")
def feedback_newest(spark, sf_dir):
    return S.newest(feedback(spark, sf_dir), [F.col("ts"), F.col("event_id")], 50).select("event_id", "query_norm", "file_id")


@query(f"WITH {FEEDBACK} SELECT count(*) AS n FROM feedback WHERE query_norm IS DISTINCT FROM '7'")
def feedback_clear(spark, sf_dir):
    return S.clear_feedback(feedback(spark, sf_dir), "7").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, event_type AS root FROM events WHERE value > 1 AND event_type <> 'error' ORDER BY event_id DESC LIMIT 1")
def last_scan(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("root"), F.when(F.col("value") > 1, F.col("ts")).alias("finished_at"), (F.col("event_type") == "error").alias("dry_run"))
    return S.last_scan(runs).select("id", "root")


@query("SELECT o_custkey AS file_id, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS days FROM orders GROUP BY 1")
def ordered_children(spark, sf_dir):
    return S.ordered_list(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate"], "o_orderkey", "days").withColumnRenamed("o_custkey", "file_id")


@query(f"WITH {FILES} SELECT path FROM files WHERE status = 'present' AND contains(lower(path), 'er#00000001')")
def path_lookup(spark, sf_dir):
    return S.paths_like(S.present(files(spark, sf_dir)), "ER#00000001").select("path")


@query(f"WITH {FILES}, {ENTITIES} SELECT 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'feedback', count(*) FROM events WHERE event_type IN ('click', 'error')")
def table_counts(spark, sf_dir):
    return S.counts(files=files(spark, sf_dir), entities=entities(spark, sf_dir), feedback=feedback(spark, sf_dir))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS at FROM events""")
def iso_parse(spark, sf_dir):
    said = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 5 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ssXXX").substr(1, 19)).when(F.col("event_id") % 5 == 2, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 5 == 3, "not a day")
    return table(spark, sf_dir, "events").select("event_id", D.parse_iso(said).alias("at"))
