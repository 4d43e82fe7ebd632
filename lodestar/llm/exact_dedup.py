"""Exact deduplication with DataFrame functions only.

Rows are grouped by the 128-bit hash of their normalised text. Inside a group of several rows the bytes of
each row are compared with those of the group's first row, so a hash collision can't join two texts: rows that
differ from it are grouped again by their whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import Tables, keep_ids

#: Characters that normalising deletes.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after deleting blanks; null counts as empty, and empty texts are
    equal. Of equal texts the longest original (code points) stays, then the smallest id. Rows with a repeated
    id are separate rows; their group counts each of them and each is marked kept if its id stays. A row with a
    null id takes part and stays only if no row with an id is as long. Other columns of docs are ignored. An
    empty table gives an empty result.

    One shuffle carries (hash, id, length, digest), the second joins it to the groups, which are written
    first so that a hot group's rows can be split over tasks. Texts are read again where a group has several
    rows; they are shuffled whole only if the list of such groups is too long to broadcast.
    """
    tables = Tables(docs.sparkSession, "exact")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    keyed = rows.select("id", F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm")).select("id", "n", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    keyed = tables("keys", keyed)

    order = F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"))
    groups = tables("groups", keyed.groupBy("h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")))

    joined = keyed.join(groups.select("h", F.col("first.id").alias("keep_id"), "size"), "h")
    odd = _collided(rows, groups, tables)
    if odd is not None:  # two texts share a 128-bit hash: those groups are made by whole text
        hashes = odd.select("h").distinct()
        joined = joined.join(hashes, "h", "left_anti").unionByName(odd.select(*joined.columns))
    tables.only("keys", "groups", "bad")
    return joined.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), (F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _collided(rows: DataFrame, groups: DataFrame, tables: Tables) -> DataFrame | None:
    """Rows of groups whose members' bytes differ, grouped again by whole text; None if all groups are sound."""
    several = groups.where("size > 1").select("h", F.col("first.id").alias("keep_id"))
    several = tables("several", several)
    text = rows.select("id", F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm"))
    text = text.withColumn("h", F.unhex(F.md5("norm")))
    # Each map task meets a text once per group: equal bytes fall together before the shuffle.
    kinds = keep_ids(text, several.select("h"), "h").groupBy("h", "norm").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    bad = tables("bad", kinds.where("kinds > 1").select("h"))
    if bad.limit(1).count() == 0:
        return None
    mine = text.join(bad, "h", "left_semi")
    order = F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"))
    exact = mine.groupBy("h", "norm").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
    return mine.join(exact, ["h", "norm"]).select("id", "n", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("first.id").alias("keep_id"), "size")
