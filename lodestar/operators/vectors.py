"""Vector operators on array<float> columns. Sums run in double."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .cluster import settled


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a with length 1; a zero vector stays."""
    d = F.transform(a, lambda x: x.cast("double"))
    return let(F.struct(d.alias("v"), norm(a).alias("n")), lambda s: F.when(s["n"] == 0, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))


def checked(a: Column, dimension: int) -> Column:
    """a, or an error if its dimension is another."""
    return F.when(F.size(a) == dimension, a).otherwise(F.raise_error(F.lit(f"a vector does not have {dimension} dimensions")))


#: Rows of a block of queries and of one of documents, whose products a task forms at once; of long vectors fewer.
QUERY_BLOCK, DOC_BLOCK, BLOCK_NUMBERS = 8192, 8192, 1 << 21
#: Bytes of documents that a task holds in memory while blocks of queries pass.
HELD_BYTES = 64 << 20
#: Queries of a block whose products are in memory together.
STRIP = 256


def _packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int, int]:
    """rows (id, v) with a vector as a stored table of blocks (block, ids, width, vs), the numbers as bytes; the number of
    blocks that their count asks for, and their bytes."""
    rows = rows.where("v IS NOT NULL")
    n = max(1, -(-rows.count() // size))
    kind = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held, width = [], [], 0, 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            return pa.RecordBatch.from_pydict({"block": [uuid.uuid4().hex], "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "width": pa.array([flat.shape[1]], pa.int32()), "vs": [flat.astype(kind).tobytes()]})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            v, own = _matrix(table["v"]), np.asarray(table["id"])
            if len(v) and held and v.shape[1] != width:
                raise ValueError("vectors differ in dimension")
            width = v.shape[1] if len(v) else width
            most = max(1, min(size, BLOCK_NUMBERS // max(1, width)))
            at = 0
            while at < len(own):
                take = min(most - held, len(own) - at)
                ids.append(own[at : at + take])
                parts.append(v[at : at + take].astype(kind))
                at, held = at + take, held + take
                if held == most:
                    yield block()
                    ids, parts, held = [], [], 0
        if held:
            yield block()

    blocks = rows.select(F.col("id").cast("long").alias("id"), "v").coalesce(n).mapInArrow(pack, "block string, ids binary, width int, vs binary")
    stored = settled(blocks.repartition(n) if n > 1 else blocks, name)
    return stored, n, stored.agg(F.coalesce(F.sum(F.length("vs") + F.length("ids")), F.lit(0))).first()[0]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    width = len(lists[0]) if len(lists) else 0
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    if len(flat) != width * len(lists):
        raise ValueError("vectors differ in dimension")
    return flat.reshape(len(lists), width)


def _best(of: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best sims of each `of`, in order; the least id wins ties, and NaN is the largest, as in sorts."""
    order = np.lexsort((ids, -np.where(np.isnan(sims), np.inf, sims), of))
    of = of[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < k]


def _products(k: int | None, least: float | None, apart: bool):
    """(query_id, doc_id, sim) of pairs of blocks, one of queries and one of documents; k, least and apart choose as in
    `similarities`. Of a block of queries that meets block after block only the k best so far are kept."""
    cols = ("query_id", "doc_id", "sim")
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def strips(q, ids, d, others, floor):
        for i in range(0, len(q), STRIP):
            sims = q[i : i + STRIP] @ d.T
            keep = ~(sims < floor[i : i + STRIP, None])
            if apart:
                own = others[None, :] == ids[i : i + STRIP, None]
                sims[own], keep[own] = -np.inf, False
            many = k is not None and np.count_nonzero(keep) > 4 * k * len(sims)
            if many and len(others) > k:
                keep &= ~(sims < np.partition(sims, len(others) - k, axis=1)[:, len(others) - k, None])
            r, c = np.nonzero(keep)
            s = sims[r, c]
            if many and len(r) > 4 * k * len(sims):  # ties
                at = _best(r, others[c], s, k)
                r, c, s = r[at], c[at], s[at]
            yield r + i, others[c], s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, q, floor, held = None, None, None, None, none
        rows = lambda r, other, s: pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array(other, pa.int64()), pa.array(s, pa.float64())], cols)
        for batch in batches:
            read = lambda c, i, kind: np.frombuffer(batch[c][i].as_buffer(), kind)  # noqa: B023, E731
            for i in range(batch.num_rows):
                width, other_width, wide, other_wide = (batch[c][i].as_py() for c in ("qw", "dw", "qk", "dk"))
                if width != other_width:
                    raise ValueError("vectors differ in dimension")
                if (block := batch["block"][i].as_py()) != now:
                    if len(held[0]):
                        yield rows(*held)
                    now, ids, held = block, read("qi", i, np.int64), none
                    q = read("qv", i, f"f{wide}").reshape(len(ids), width).astype(np.float64)
                    floor = np.full(len(ids), -np.inf if least is None else least)
                others = read("di", i, np.int64)
                d = read("dv", i, f"f{other_wide}").reshape(len(others), width).astype(np.float64)
                if k is None:
                    yield from (rows(*x) for x in strips(q, ids, d, others, floor))
                    continue
                held = tuple(np.concatenate(x) for x in zip(held, *strips(q, ids, d, others, floor)))
                at = _best(*held, k)
                held = tuple(x[at] for x in held)
                full = np.flatnonzero(np.bincount(held[0], minlength=len(ids)) == k)
                floor[full] = held[2][np.searchsorted(held[0], full, side="right") - 1]
        if len(held[0]):
            yield rows(*held)

    return run


def _met(queries: tuple[DataFrame, int, int], docs: tuple[DataFrame, int, int], k: int | None, least: float | None, apart: bool) -> DataFrame:
    """What blocks of queries and of documents give. Tasks read their blocks from the stored tables, so that nothing is
    shuffled: each has some blocks of queries, and as many documents as it may hold."""
    (q, nq, _), (d, nd, size) = queries, docs
    parts = max(-(-size // HELD_BYTES), min(nd, -(-q.sparkSession.sparkContext.defaultParallelism // nq)))
    wide = lambda ids, w, vs: (F.length(vs) / (F.length(ids) / 8 * F.col(w))).cast("int")
    q = q.select("block", F.col("ids").alias("qi"), F.col("width").alias("qw"), F.col("vs").alias("qv")).withColumn("qk", wide("qi", "qw", "qv"))
    d = d.select(F.col("ids").alias("di"), F.col("width").alias("dw"), F.col("vs").alias("dv")).withColumn("dk", wide("di", "dw", "dv"))
    pairs = q.crossJoin(d.coalesce(parts).hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(_products(k, least, apart), "query_id long, doc_id long, sim double")


def similarities(queries: DataFrame, docs: DataFrame, k: int | None = None, least: float | None = None, apart: bool = False) -> DataFrame:
    """(query_id, doc_id, sim) of a stated set of queries (query_id, v) against all docs (doc_id, v), by dot product of unit vectors.

    Both sides are stored in blocks, as many as their counts ask for, and each pair of blocks is one matrix product. With
    k, only a query's k best leave a task (the least doc_id wins ties); with least, only similarities of at least that;
    apart leaves out a row's similarity with itself. Rows without a vector take no part.
    """
    q = _packed(queries.select(F.col("query_id").alias("id"), "v"), QUERY_BLOCK, "query-blocks")
    return _met(q, _packed(docs.select(F.col("doc_id").alias("id"), "v"), DOC_BLOCK, "doc-blocks"), k, least, apart)


def top_k(scored: DataFrame, k: int, by: str = "sim", group: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The best k rows of each group, with their rank from 1; only k rows a group and task are shuffled."""
    w = Window.partitionBy(group).orderBy(F.col(by).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return top_k(similarities(queries, docs, k), k)


def neighbours(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(src, dst, sim): each vector's k best others at or above a threshold."""
    blocks = _packed(docs.select(F.col("doc_id").alias("id"), "v"), DOC_BLOCK, "vector-blocks")
    sims = _met(blocks, blocks, k, threshold, apart=True)
    return top_k(sims, k).select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst"), "sim")


def mean_pool(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): the unit mean of a key's vectors; positions are averaged before anything is gathered."""
    parts = chunks.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("v"))
    return ordered.withColumn("v", unit(F.col("v")))


def hashed_terms(text: Column, dimension: int = 384) -> Column:
    """A unit vector of term counts in hashed positions: the embedding that needs no model. Null texts have no vector."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    spots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int"))

    @F.pandas_udf("array<double>")
    def counted(spots: pd.Series) -> pd.Series:
        out = []
        for s in spots:
            counts = None if s is None else np.bincount(s, minlength=dimension).astype(float)
            out.append(counts if counts is None or not counts.any() else counts / np.sqrt(counts @ counts))
        return pd.Series(out)

    return counted(spots)
