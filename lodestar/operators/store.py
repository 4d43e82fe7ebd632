"""Reads, writes and change detection over immutable snapshots of relational tables.

Snapshots can't be updated in place, so every write is an expression that makes the next snapshot from the last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(files: DataFrame) -> DataFrame:
    """Files that are not tombstones."""
    return files.where(F.col("status") == "present")


def of_present(rows: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of files that are present; nothing is added to the row."""
    return rows.join(present(files).select(key), key, "left_semi")


def count_by(rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def describe_paths(rows: DataFrame, path: str = "path") -> DataFrame:
    """name, stem, ext (lower case, with its dot), folder ('' at the root) and depth (folders above) of a path."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    dotted = name.rlike(r"^.+\.[^.]+$")
    ext = F.when(dotted, F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))).otherwise("")
    stem = F.when(dotted, F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    folder = F.when(F.instr(p, "/") > 0, F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise("")
    return rows.select("*", name.alias("name"), stem.alias("stem"), ext.alias("ext"), folder.alias("folder"), (F.size(F.split(p, "/")) - 1).alias("depth"))


def differs(a: str | Column, b: str | Column) -> Column:
    """Null-safe inequality."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return ~a.eqNullSafe(b)


# -- change detection ---------------------------------------------------------------------------------------------


def snapshot_diff(known: DataFrame, seen: DataFrame, full: bool = False, rehash: bool = False) -> DataFrame:
    """One row per path of either side with its change: new, modified, unchanged, deleted.

    known and seen hold path, size, mtime, content_hash. Equal size and time make a file unchanged without its hash,
    unless full or rehash ask; otherwise equal hashes make it unchanged. A hash that is absent is never equal.
    touched tells that only its time moved, so the row is written again.
    """
    k = known.select("path", *[F.col(c).alias(f"known_{c}") for c in ("size", "mtime", "content_hash")], F.lit(True).alias("was"))
    s = seen.select("path", "size", "mtime", "content_hash", F.lit(True).alias("is"))
    both = s.join(k, "path", "full_outer")
    same_stat = (F.col("size") == F.col("known_size")) & (F.col("mtime") == F.col("known_mtime"))
    same_hash = F.col("content_hash") == F.col("known_content_hash")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted")
    if full:
        change = change.otherwise("modified")
    elif rehash:
        change = change.when(F.coalesce(same_hash, F.lit(False)), "unchanged").otherwise("modified")
    else:
        change = change.when(F.coalesce(same_stat, F.lit(False)), "unchanged").when(F.coalesce(same_hash, F.lit(False)), "unchanged").otherwise("modified")
    return both.select("path", change.alias("change"), (F.col("was") & F.col("is") & ~F.coalesce(same_stat, F.lit(False)) & (change == "unchanged")).alias("touched"))


def needs_hash(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths whose content must be opened: new ones and those whose size or time moved."""
    k = known.select("path", "size", "mtime")
    return seen.join(k, ["path", "size", "mtime"], "left_anti")


def touched_fraction(diff: DataFrame) -> DataFrame:
    """Share of the files seen that are new or modified; 0 when none were seen."""
    seen = F.count_if(F.col("change") != "deleted")
    return diff.agg(F.coalesce(F.count_if(F.col("change").isin("new", "modified")) / F.nullif(seen, F.lit(0)), F.lit(0.0)).alias("touched_fraction"))


def upsert_files(known: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """The next snapshot of files: path, size, mtime, content_hash, status, first_seen, last_seen, content_changed_at.

    A path keeps its first_seen and, where the new hash is absent, its hash. content_changed_at moves only when
    both hashes are known and differ. What isn't seen becomes a tombstone; what is seen again is revived.
    """
    cols = ("size", "mtime", "content_hash", "status", "first_seen", "last_seen", "content_changed_at")
    k = known.select("path", *[F.col(c).alias(f"k_{c}") for c in cols])
    s = seen.select("path", "size", "mtime", "content_hash", F.lit(True).alias("is"))
    both = s.join(k, "path", "full_outer")
    at = F.lit(now).cast("timestamp_ntz")
    here, moved = F.col("is").isNotNull(), F.coalesce(F.col("content_hash") != F.col("k_content_hash"), F.lit(False))
    return both.select(
        "path",
        F.coalesce("size", "k_size").alias("size"),
        F.coalesce("mtime", "k_mtime").alias("mtime"),
        F.coalesce("content_hash", "k_content_hash").alias("content_hash"),
        F.when(here, "present").otherwise("deleted").alias("status"),
        F.coalesce("k_first_seen", at).alias("first_seen"),
        F.when(here, at).otherwise(F.col("k_last_seen")).alias("last_seen"),
        F.when(F.col("k_first_seen").isNull() | (here & moved), at).otherwise(F.col("k_content_changed_at")).alias("content_changed_at"),
    )


def tombstones(known: DataFrame, seen: DataFrame) -> DataFrame:
    """known with status 'deleted' where the path is not seen."""
    s = seen.select("path", F.lit(True).alias("is"))
    return known.join(s, "path", "left").withColumn("status", F.when(F.col("is").isNull(), "deleted").otherwise(F.col("status"))).drop("is")


def purge_deleted(files: DataFrame) -> DataFrame:
    return files.where(F.col("status") != "deleted")


def needs_work(files: DataFrame, done: DataFrame, key: str = "file_id", content: str = "content_hash") -> DataFrame:
    """Present files without a record in done, or with one for other content."""
    d = done.select(key, F.col(content).alias("done_hash"), F.lit(True).alias("is"))
    return present(files).join(d, key, "left").where(F.col("is").isNull() | differs(content, "done_hash")).drop("is", "done_hash")


def replace_for(existing: DataFrame, changed: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """existing with the rows of changed keys replaced by new."""
    return existing.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def forget(rows: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by order (descending); it must break ties."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


class AmbiguousPath(LookupError):
    """Several files, or none, answer to a path."""


def paths_like(files: DataFrame, said: str) -> DataFrame:
    """Files whose path is `said`, or else holds it somewhere, whatever its case."""
    exact = files.where(F.col("path") == said)
    part = files.where(F.contains(F.lower("path"), F.lit(said.lower())))
    return part if exact.isEmpty() else exact


def one_path(files: DataFrame, said: str, named: int = 10) -> str:
    """The only path that answers to `said`; an error names up to `named` of several."""
    found = [r.path for r in paths_like(files, said).select("path").orderBy("path").limit(named + 1).collect()]
    if len(found) != 1:
        raise AmbiguousPath(f"no file has {said!r} in its path" if not found else f"{said!r} is in {'more than ' * (len(found) > named)}{min(len(found), named)} paths: {', '.join(found[:named])}")
    return found[0]


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of tables."""
    return union_all(*[t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, t in tables.items()])


# -- aggregates ---------------------------------------------------------------------------------------------------


def category_votes(entities: DataFrame) -> DataFrame:
    """Distinct files by (normalised, category)."""
    return entities.groupBy("normalised", "category").agg(F.countDistinct("file_id").alias("votes"))


def consensus(entities: DataFrame) -> DataFrame:
    """(normalised, winner): the category with strictly most files; a tie decides nothing."""
    votes = category_votes(entities)
    w = Window.partitionBy("normalised").orderBy(F.col("votes").desc(), "category")
    ranked = votes.select("normalised", "category", "votes", F.row_number().over(w).alias("nth"), F.lead("votes").over(w).alias("next"))
    return ranked.where("nth = 1 AND (next IS NULL OR votes > next)").select("normalised", F.col("category").alias("winner"))


def reconcile(entities: DataFrame) -> DataFrame:
    """entities with each category replaced by its name's consensus, if there is one."""
    return entities.join(consensus(entities), "normalised", "left").withColumn("category", F.coalesce("winner", "category")).drop("winner")


def entity_index(entities: DataFrame) -> DataFrame:
    """(key, files): category:normalised and the sorted files that have it."""
    key = F.concat_ws(":", "category", "normalised")
    return entities.groupBy(key.alias("key")).agg(F.sort_array(F.collect_set("file_id")).alias("files"))


def date_recurrence(mentions: DataFrame) -> DataFrame:
    return mentions.where("iso_date IS NOT NULL").groupBy("iso_date").agg(F.countDistinct("file_id").alias("files"))


def verdict_totals(dates: DataFrame) -> DataFrame:
    return dates.agg(F.count_if("is_meaningful").alias("meaningful"), F.count_if(~F.col("is_meaningful")).alias("incidental"))


def feedback_net(events: DataFrame) -> DataFrame:
    """Signed weight by query and file: a reject counts against it."""
    w = F.when(F.col("event") == "reject", -F.col("weight")).otherwise(F.col("weight"))
    return events.groupBy("query_norm", "file_id").agg(F.sum(w).alias("net"))


def clear_feedback(events: DataFrame, query_norm: str | None = None) -> DataFrame:
    """The log without one query's events, or without any."""
    return events.limit(0) if query_norm is None else events.where(differs("query_norm", F.lit(query_norm)))


def newest(events: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The newest n rows; the report is n rows by definition."""
    return events.orderBy(*[c.desc() for c in order]).limit(n)


def last_scan(runs: DataFrame) -> DataFrame:
    """The last finished scan that was not a dry run."""
    return newest(runs.where("finished_at IS NOT NULL AND NOT dry_run"), [F.col("id")], 1)


def ordered_list(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Values of each key in order, as one array."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias(name))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
