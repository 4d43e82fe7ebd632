"""Line deduplication by pairwise alignment.

Documents of equal lines form a class, whose first one stands for it; of the others every line is deleted. Documents
that share a line (by hash) are candidates; each line pairs its later holders with its first, so a line held by n
documents gives n - 1 pairs. A pair's lines are aligned by patience diff: lines that are unique in both are anchors,
the longest rising chain of anchors is kept and extended over equal neighbours, and the gaps are aligned likewise;
where no line is unique in both, the nth places of a line are anchors. Common blocks of an alignment are deleted from
the later document, short and blank lines with the others, if a block has LINE_WORDS words in all. Short lines find
candidates by runs: from each one on, as many as make LINE_WORDS words. Rarity only says how a pair is joined: the first
holders of frequent lines are few and are broadcast, so that no task meets all holders of a line.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._cluster import SMALL_ROWS, Tables, drop_ids, keep_ids, sized

#: A line is rare if at most this share of documents, or RARE_LEAST documents, hold it; others are joined another way.
RARE_SHARE = 0.01
RARE_LEAST = 50
#: Words that a line, or a run of shorter ones, must have to be evidence of copying: to find candidates, or for a block to be deleted.
LINE_WORDS = 8


def _lines(text: str) -> tuple[list[str], list[bytes]]:
    lines = text.split("\n")
    return lines, [b" ".join(line.encode().split()) for line in lines]


def _hashes(texts: list[bytes]) -> np.ndarray:
    column = pa.array(texts, pa.large_binary())
    raw, at = K.text_buffers(column)
    n = int(at[-1])
    up, down = K._tables(K._BASE, n + 1)
    total = np.zeros(n + 1, dtype=K.U)
    if n:
        np.cumsum(K._BYTES[raw[:n]] * up[:n], out=total[1:])
    return K.mix((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(K.U))


def word_counts(plain: list[bytes]) -> list[int]:
    return [p.count(b" ") + 1 if p else 0 for p in plain]


def _starts(hashes: np.ndarray, words: list[int], least: int) -> np.ndarray:
    """Hashes that find candidates: of each line of enough words, and from each shorter one on of the run of short lines,
    blank ones left out, that reaches `least` words. What two documents have in common of such a run, both have whole."""
    out = [h for h, n in zip(hashes.tolist(), words) if n >= least]
    run: list[tuple[int, int]] = []
    total = 0
    for h, n in zip(hashes.tolist(), words):
        if n >= least:
            run, total = [], 0
        elif n:
            run.append((h, n))
            total += n
            while total >= least:
                own = hashlib.blake2b(b"".join(x.to_bytes(8, "little") for x, _ in run), digest_size=8)
                out.append(int.from_bytes(own.digest(), "little"))
                total -= run.pop(0)[1]
    return np.unique(np.array(out, dtype=K.U))


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by the first, whose second rises."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[k] = ends[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[at], ends[at] = b, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _nth_places(a: list[int], a0: int, a1: int, b: list[int], b0: int, b1: int) -> list[tuple[int, int]]:
    """The nth place of each line in a with its nth place in b."""
    places: dict[int, list[int]] = {}
    for j in range(b1 - 1, b0 - 1, -1):
        places.setdefault(b[j], []).append(j)
    return [(i, left.pop()) for i in range(a0, a1) if (left := places.get(a[i]))]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], rising in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        where: dict[int, int] = {}
        for i in range(a0, a1):
            where[a[i]] = -1 if a[i] in where else i
        seen: dict[int, int] = {}
        for j in range(b0, b1):
            seen[b[j]] = -1 if b[j] in seen else j
        anchors = _rising(sorted((i, seen[x]) for x, i in where.items() if i >= 0 and seen.get(x, -1) >= 0))
        if not anchors:
            anchors = _rising(sorted(_nth_places(a, a0, a1, b, b0, b1)))
        if not anchors:
            continue
        i, j = a0, b0
        for x, y in [*anchors, (a1, b1)]:
            if x > i and y > j:
                work.append((i, x, j, y))
            if x < a1 or y < b1:
                out.append((x, y))
            i, j = x + 1, y + 1
    return sorted(out)


_BLANK = int(_hashes([b""]).view(np.int64)[0])


def blocks(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ranges of b that are common blocks: aligned places that follow each other in both, but for blank lines."""
    out: list[tuple[int, int]] = []
    x, y = -1, -1
    for i, j in patience(a, b):
        if out and all(h == _BLANK for h in a[x + 1 : i]) and all(h == _BLANK for h in b[y + 1 : j]):
            out[-1] = (out[-1][0], j + 1)
        else:
            out.append((j, j + 1))
        x, y = i, j
    return out


def _index(least: int):
    def run(batches):
        for batch in batches:
            rows, text = batch.columns
            for i, j, _, _ in K.slices(text):
                same, hashes, lines = [], [], [0]
                for t in text.slice(i, j - i).to_pylist():
                    _, plain = _lines(t or "")
                    mine = _starts(_hashes(plain), word_counts(plain), least)
                    same.append(hashlib.md5(b"\n".join(plain)).digest() if any(plain) else None)
                    hashes.append(mine)
                    lines.append(lines[-1] + len(mine))
                yield pa.RecordBatch.from_arrays([rows.slice(i, j - i), pa.array(same, pa.binary()), K.list_array(K.signed(np.concatenate(hashes)), np.array(lines), pa.int64())], names=["key", "same", "lines"])

    return run


def _sets(batches):
    for batch in batches:
        keys, text = batch.columns
        out = [_hashes(_lines(t or "")[1]).tobytes() for t in text.to_pylist()]
        yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.binary())], names=["key", "hashes"])


def _aligned(batches):
    for batch in batches:
        later, first, own = batch.columns
        out = []
        for a, b in zip(first.to_pylist(), own.to_pylist()):
            x, y = np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist()
            out.append([i << 32 | j for i, j in blocks(x, y)])
        yield pa.RecordBatch.from_arrays([later, pa.array(out, pa.list_(pa.int64()))], names=["later", "places"])


def _cut(least: int, text_col: str, names: list[str]):
    def run(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for t, p, whole in zip(batch.column(text_col).to_pylist(), batch.column("places").to_pylist(), batch.column("whole").to_pylist()):
                lines, plain = _lines(t or "")
                words = word_counts(plain)
                ranges = [(0, len(lines))] if whole else [(x >> 32, x & 0xFFFFFFFF) for x in p]
                drop = {k for i, j in ranges if whole or sum(words[i:j]) >= least for k in range(i, j)}
                total.append(len(lines) if t else 0)
                gone.append(len(drop))
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else t)
            own = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_removed", "kept_text"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LINE_WORDS, rare_share: float = RARE_SHARE, rare_least: int = RARE_LEAST) -> DataFrame:
    """docs with n_lines, n_removed and kept_text (its text without the lines deleted) added.

    Lines are split at \\n and compared with blanks collapsed. A line is rare if at most max(rare_least, rare_share *
    rows) documents hold it; this chooses the join and not the result. Of two documents the later is the one with the greater id; null ids come last, and rows
    that share an id are ordered by a hash of the row, equal rows being one. Only lines, or runs of
    shorter ones, of `least` words or more find candidates, and only common blocks of as many are deleted; a document
    whose lines are all those of an earlier one goes whole, however short. Null texts stay null and empty ones empty; an empty table gives an empty result.
    Columns named like the three added, row_key, places or whole are dropped; all others stay.
    """
    tables = Tables(docs.sparkSession, "lines")
    docs = docs.drop("n_lines", "n_removed", "kept_text", "row_key", "places", "whole")
    ident, text = docs[id_col], docs[text_col]
    rows = docs.select(F.struct(ident.isNull().alias("none"), ident.cast("long").alias("id"), F.xxhash64(ident, text).alias("h")).alias("key"), text.alias("text"))
    schema = "key struct<none:boolean,id:long,h:long>"
    index = tables("index", rows.where("text <> ''").mapInArrow(_index(least), f"{schema}, same binary, lines array<long>"))
    classes = index.where("same IS NOT NULL").groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    classes = tables("classes", classes.where("n > 1").select("same", "first"))
    copies = tables("copies", index.join(sized(classes), "same").where("key <> first").select("key").distinct())
    lines = drop_ids(index, copies, "key").select("key", F.explode("lines").alias("line"))
    most = max(rare_least, int(rare_share * index.count()))
    shared = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).where("n > 1")
    shared = tables("shared", shared.select("line", "first", (F.col("n") > most).alias("often")))
    pairs = [lines.join(sized(shared.where(part)), "line").where("key <> first").select(F.col("key").alias("later"), "first", "often") for part in ("NOT often", "often")]
    pairs = tables("pairs", pairs[0].union(pairs[1]).groupBy("later", "first").agg(F.min("often").alias("often")))
    held = tables("held", pairs.select(F.col("later.h").alias("h")).union(pairs.select("first.h")).distinct())
    sets = keep_ids(rows.select("key", "text", F.col("key.h").alias("h")), held, "h").select("key", "text").mapInArrow(_sets, f"{schema}, hashes binary").dropDuplicates(["key"])
    sets = tables("sets", sets)
    firsts = tables("often", pairs.where("often").select(F.col("first").alias("key")).distinct())
    firsts = tables("firsts", keep_ids(sets, firsts, "key").toDF("first", "hf"))
    few = firsts.agg(F.coalesce(F.sum(F.octet_length("hf")), F.lit(0))).first()[0] <= 80 * SMALL_ROWS
    both = pairs.where("NOT often").join(sets.toDF("first", "hf"), "first").join(sets.toDF("later", "hl"), "later").select("later", "hf", "hl")
    wide = pairs.where("often").join(sets.toDF("later", "hl"), "later").join(F.broadcast(firsts) if few else firsts.hint("shuffle_merge"), "first").select("later", "hf", "hl")
    found = both.union(wide).mapInArrow(_aligned, "later struct<none:boolean,id:long,h:long>, places array<long>").groupBy("later").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    found = found.select(F.col("later.h").alias("row_key"), "places", F.lit(False).alias("whole")).where(F.size("places") > 0)
    found = tables("found", found.union(copies.select("key.h", F.array().cast("array<long>"), F.lit(True))))
    tables.only("found")
    keyed = docs.withColumn("row_key", F.xxhash64(ident, text))
    listed = found.select("row_key")
    changed = keep_ids(keyed, listed, "row_key").join(sized(found, "places"), "row_key").drop("row_key")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    changed = changed.mapInArrow(_cut(least, text_col, docs.columns), schema)
    same = drop_ids(keyed, listed, "row_key").drop("row_key")
    n = F.when(F.col(text_col) != "", F.size(F.split(F.col(text_col), "\n")).cast("long")).otherwise(F.lit(0).cast("long"))
    same = same.select("*", n.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col(text_col).alias("kept_text"))
    return changed.unionByName(same)
