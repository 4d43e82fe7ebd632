"""The folder hierarchy as a table: root, project (top folder), folder and file nodes, made from paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V


def nodes(files: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(node_id, kind, label, parent_id, depth, rel_path, file_id) of files (file_id, path), and chunks (file_id, chunk_index) below them."""
    parts = F.split("path", "/")
    prefix = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(prefix(n).alias("rel_path"), n.alias("depth")))).otherwise(F.array().cast("array<struct<rel_path:string,depth:int>>"))
    folders = files.select(F.explode(above).alias("x")).select("x.*").distinct()
    up = F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)
    name = F.element_at(F.split("rel_path", "/"), -1)
    folders = folders.select(_folder_id(F.col("rel_path")).alias("node_id"), F.when(F.col("depth") == 1, "project").otherwise("folder").alias("kind"), name.alias("label"), _folder_id(up).alias("parent_id"), "depth", "rel_path", F.lit(None).cast("long").alias("file_id"))
    leaf = files.select("file_id", F.col("path").alias("rel_path"), F.size(parts).alias("depth"))
    leaf = leaf.select(F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("node_id"), F.lit("file").alias("kind"), name.alias("label"), _folder_id(up).alias("parent_id"), "depth", "rel_path", F.col("file_id").cast("long").alias("file_id"))
    root = files.sparkSession.range(1).select(F.lit("root").alias("node_id"), F.lit("root").alias("kind"), F.lit("/").alias("label"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit("").alias("rel_path"), F.lit(None).cast("long").alias("file_id"))
    out = root.unionByName(folders).unionByName(leaf)
    if chunks is not None:
        below = chunks.join(leaf.select("file_id", "depth", "rel_path", F.col("node_id").alias("parent_id")), "file_id")
        out = out.unionByName(below.select(F.concat(F.lit("chunk:"), F.col("file_id").cast("string"), F.lit(":"), F.col("chunk_index").cast("string")).alias("node_id"), F.lit("chunk").alias("kind"), F.concat(F.lit("chunk "), F.col("chunk_index").cast("string")).alias("label"), "parent_id", (F.col("depth") + 1).alias("depth"), "rel_path", "file_id"))
    return out


def _folder_id(path):
    return F.when(path == "", "root").otherwise(F.concat(F.lit("dir:"), path))


def file_counts(files: DataFrame) -> DataFrame:
    """(node_id, file_count): files below the root and every folder; paths are spread over their prefixes and summed."""
    parts = F.split("path", "/")
    spread = F.explode(F.concat(F.array(F.lit("")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))))
    return files.select(spread.alias("p")).groupBy(_folder_id(F.col("p")).alias("node_id")).agg(F.count(F.lit(1)).alias("file_count"))


def pooled(tree: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node_id, v): a file's own vector; a folder's is the unit mean of its children's, the deepest first."""
    levels = tree.agg(F.max("depth")).first()[0] or 0
    done = tree.where("kind = 'file'").join(vectors.select("file_id", "v"), "file_id").select("node_id", "v")
    for depth in range(levels - 1, -1, -1):
        here = tree.where((F.col("depth") == depth) & F.col("kind").isin("root", "project", "folder")).select("node_id")
        kids = tree.select(F.col("node_id").alias("kid"), F.col("parent_id").alias("node_id")).join(here, "node_id").join(done.withColumnRenamed("node_id", "kid"), "kid")
        done = done.unionByName(V.mean_pool(kids, "node_id", "v"))
    return done


def children(tree: DataFrame, node_id: str) -> DataFrame:
    return tree.where(F.col("parent_id") == node_id)


def descendants(tree: DataFrame, rel_path: str) -> DataFrame:
    """Nodes below a folder."""
    return tree.where("parent_id IS NOT NULL") if rel_path == "" else tree.where(F.startswith("rel_path", F.lit(rel_path + "/")))


def ancestors(tree: DataFrame) -> DataFrame:
    """(node_id, ancestors): ids from the root down to the parent."""
    parts = F.split("rel_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: _folder_id(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    path = F.when(F.col("kind") == "root", F.array().cast("array<string>")).when(F.size(parts) > 1, F.concat(F.array(F.lit("root")), up)).otherwise(F.array(F.lit("root")))
    path = F.when(F.col("kind") == "chunk", F.concat(path, F.array("parent_id"))).otherwise(path)
    return tree.select("node_id", path.alias("ancestors"))


def orphans(tree: DataFrame) -> DataFrame:
    """Nodes whose parent is missing."""
    return tree.where("parent_id IS NOT NULL").join(tree.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti")
