"""Vector best-fit packing of token pieces into sequences.

A piece's demand on a sequence is a vector: its tokens, one document, and its attention cost (the square of its
length). All of it follows from the length, so pieces of equal length are interchangeable and the plan is made
on the histogram of lengths, which has at most `tokens` entries however large the corpus. Sequences are filled
one kind at a time: the next piece is the one that fits every residual capacity and scores best, by weighted
dot product or by the norm of what would be left. A filled kind is repeated as often as the histogram allows.
Pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import Tables
from ._tokens import encoder


def plan_sequences(counts: dict[int, int], tokens: int = 1024, documents: int | None = None, attention: int | None = None, score: str = "norm") -> list[tuple[int, list[int]]]:
    """Kinds of sequence as (how many, lengths in order), for counts of pieces by length.

    score is "norm" (least weighted residual norm) or "dot" (largest weighted dot product of demand and residual).
    A capacity of None is not a limit.
    """
    if score not in ("norm", "dot"):
        raise ValueError("score must be 'norm' or 'dot'")
    lengths = np.array(sorted(n for n, c in counts.items() if c > 0), dtype=np.int64)
    if not len(lengths):
        return []
    if lengths[0] < 1 or lengths[-1] > tokens or (attention is not None and lengths[-1] ** 2 > attention) or documents == 0:
        raise ValueError("a piece exceeds a capacity")
    left = np.array([counts[int(n)] for n in lengths], dtype=np.int64)
    demand = np.stack([lengths, np.ones_like(lengths), lengths**2], axis=1).astype(float)
    caps = np.array([tokens, np.inf if documents is None else documents, np.inf if attention is None else attention], dtype=float)
    limited = np.isfinite(caps)
    share = demand[:, limited] / caps[limited]
    weight = (share * left[:, None]).sum(axis=0)
    weight = weight / weight.sum()
    kinds = []
    while (alive := np.flatnonzero(left)).size:
        room = np.ones(int(limited.sum()))
        used = np.zeros_like(left)
        kind = []
        while True:
            fit = alive[(left[alive] > used[alive]) & (share[alive] <= room + 1e-12).all(axis=1)]
            if not fit.size:
                break
            if not kind:
                best = fit[-1]  # the longest piece opens a sequence
            elif score == "dot":
                best = fit[np.argmax((share[fit] * room * weight).sum(axis=1))]
            else:
                best = fit[np.argmin((((room - share[fit]) ** 2) * weight).sum(axis=1))]
            used[best] += 1
            kind.append(int(lengths[best]))
            room = room - share[best]
        several = used > 0
        times = int((left[several] // used[several]).min())
        left -= times * used
        kinds.append((times, kind))
    return kinds


def _slots(kinds: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of ranks by length: the rank-th piece of a length lies in run r, sequence base + (rank - first), at offset."""
    rows, taken, base = [], {}, 0
    for times, kind in kinds:
        offset = 0
        for n in kind:
            first = taken.get(n, 0)
            rows.append((n, first, base, offset))
            taken[n] = first + times
            offset += n
        base += times
    rows.sort()
    n, first, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    return {"n": n, "first": first, "sequence": sequence, "offset": offset}


def _pieces(path: str, tokens: int, end: int):
    def run(batches):
        encode, tail = encoder(path).encode, int(end).to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.columns
            row, piece, start, length, crc, blobs = [], [], [], [], [], []
            for d in range(batch.num_rows):
                raw = encode(texts[d].as_py() or "") + tail
                n = len(raw) // 4
                cut = n % tokens or tokens
                at = [0, *range(cut, n + 1, tokens)] if n > tokens else [0, n]
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    row.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    blobs.append(zlib.crc32(raw[4 * a : 4 * b]))
            crc = blobs
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def _placed(slots: dict[str, np.ndarray]):
    def run(batches):
        key = slots["n"] * (1 << 40) + slots["first"]
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            r = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
            out = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(slots["sequence"][r] + rank - slots["first"][r]), pa.array(slots["offset"][r])], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, tokens: int = 1024, end: int = 2, documents: int | None = None, attention: int | None = None, score: str = "norm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (null text: none) and the id `end`. One of over `tokens` ids is cut into pieces of
    `tokens`, of which only the first may be shorter. No sequence exceeds `tokens`, `documents` or `attention`; offsets in a
    sequence are gapless. Rows that repeat an id, or null ids, are documents of their own; other columns are
    ignored; an empty table gives an empty result.

    The driver holds the histogram of lengths and the plan on it, both bounded by `tokens`. Texts are never shuffled.
    """
    tables = Tables(docs.sparkSession, "packing")
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    pieces = rows.mapInArrow(_pieces(vocabulary, tokens, end), "id long, piece int, start long, length long, ids_crc32 long")
    pieces = tables("pieces", pieces.withColumn("row", F.monotonically_increasing_id()))
    pieces = pieces.withColumn("part", F.shiftright("row", 33))

    # rank among pieces of a length: those of earlier parts, then the row's place in its own part
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = tables("parts", parts.withColumn("before", F.expr("sum(n) OVER (PARTITION BY length ORDER BY part) - n")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_sequences(counts, tokens, documents, attention, score))
    ranked = pieces.withColumn("place", F.expr("row_number() OVER (PARTITION BY part, length ORDER BY row) - 1"))
    ranked = ranked.join(parts.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(slots), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
