"""Substring deduplication: every word inside a repeated run of words is found and removed.

Suffixes of all texts are partitioned by prefixes of variable length, and each group of suffixes with one prefix gets a
suffix tree of its own. A suffix matters as far as its first window. Its prefix starts at the window's minimiser (the
least of the PREFIX-word hashes in it), so equal windows have equal prefixes at equal offsets, and neighbouring windows
with one minimiser travel as one segment of words. The first prefix is the minimiser's own PREFIX words and stands for
all offsets. A prefix of more than GROUP unlike segments is made longer: its offsets are halved, and each half has more
words in common, on the one side or the other, up to the whole window. Which prefixes are to grow is kept in a bitmap of
fixed size; what falls into the same cell grows with them, everywhere alike. A prefix with one suffix is dropped.

A task holds whole groups, builds their trees as a sorted suffix array with the lengths of common prefixes, and takes for
each suffix the depth of its deepest inner node: if that is a window or more, so many words are a repeat, and the
stretches of such words are the maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._cluster import Tables, keep_ids, sized

#: Words of the first, shortest prefix of a suffix.
PREFIX = 8
#: Unlike segments that share a prefix before it is made longer.
GROUP = 4096
#: Cells of the bitmap of prefixes that are made longer.
CELLS = 1 << 20
#: Words of the segments that a task builds trees of at once.
TREE_WORDS = 400_000
#: Bytes that stand for a word inside a segment.
CODE = 6


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each run of width values (the first of equals), by doubling."""
    n = len(values) - width + 1
    at = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at[:n]


def _minimisers(w: K.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of whole windows, the position of each one's minimiser, and all prefix hashes."""
    k = min(PREFIX, window)
    grams, _ = w.grams(k)
    n = len(w.hashes)
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, grams
    last = np.repeat(w.bounds[1:], w.counts)
    whole = np.flatnonzero(np.arange(n) + window <= last)
    at = _window_min(grams[: n - k + 1], window - k + 1)
    return whole, at[whole], grams


class _Segments:
    """Runs of windows with one minimiser, of a slice of documents: windows lo to hi of the slice, the minimiser at place p, and offsets first to last that the run stands for."""

    def __init__(self, w: K.Words, window: int):
        self.w, self.window, self.sums = w, window, {}
        whole, at, self.grams = _minimisers(w, window)
        new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
        self.p, self.lo, self.hi = at[new], whole[new], whole[np.append(new[1:], len(whole)) - 1] if len(new) else whole
        self.first, self.last = np.zeros(len(new), np.int64), np.full(len(new), window - min(PREFIX, window))
        self.doc = np.searchsorted(w.bounds, self.p, side="right") - 1

    def core(self) -> np.ndarray:
        """Hash of the prefix of each run: the words that all its offsets have in common, and the offsets."""
        out = np.zeros(len(self.p), dtype=K.U)
        length = self.window - (self.last - self.first)
        for k in np.unique(length):
            if k not in self.sums:
                self.sums[k] = self.w.grams(int(k))[0]
            mine = length == k
            out[mine] = self.sums[k][self.p[mine] - self.first[mine]]
        return K.mix(out + (self.first * 64 + self.last).astype(K.U))

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each run's segment of words, the words' places, and the words of each segment."""
        size = self.hi - self.lo + self.window
        prior = np.cumsum(size) - size
        spots = np.repeat(self.lo - prior, size) + np.arange(size.sum())
        place = (np.arange(len(spots)) - np.repeat(prior, size)).astype(K.U)
        core, hashes = self.core(), self.w.hashes[spots]
        one, two = (K.mix(np.add.reduceat(K.mix(hashes + place * odd), prior) + core + size.astype(K.U)) if len(size) else core for odd in (K.U(0x9E3779B97F4A7C15), K.U(0xC2B2AE3D27D4EB4F)))
        return one, two, spots, size

    def take(self, rows: np.ndarray) -> None:
        for name in ("p", "lo", "hi", "first", "last", "doc"):
            setattr(self, name, getattr(self, name)[rows])

    def split(self, rows: np.ndarray) -> None:
        """Runs that `rows` marks become two, one for each half of their offsets; halves without a window go."""
        rows = rows & (self.last > self.first)
        half = (self.first + self.last) // 2
        parts = []
        for which, first, last in ((~rows, self.first, self.last), (rows, self.first, half), (rows, half + 1, self.last)):
            first, last = first[which], last[which]
            lo, hi = np.maximum(self.lo[which], self.p[which] - last), np.minimum(self.hi[which], self.p[which] - first)
            parts.append([x[lo <= hi] for x in (self.p[which], lo, hi, first, last, self.doc[which])])
        self.p, self.lo, self.hi, self.first, self.last, self.doc = (np.concatenate(x) for x in zip(*parts))

    def within(self, wanted: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which runs have a prefix that is among their document's wanted ones."""
        tie = lambda core, doc: K.mix(core + doc.astype(K.U) * K.U(0x9E3779B97F4A7C15))
        return np.isin(tie(self.core(), self.doc), tie(wanted.view(K.U), owner))


def _index(window: int):
    """Per document: id, row key, words, digest of all words, and the first prefixes of its suffixes with their segments."""

    def run(batches):
        for batch in batches:
            ids, keys, text = batch.columns
            for i, j, w in K.hashed(text, K.BLANKS, False):
                runs = _Segments(w, window)
                bounds = np.searchsorted(runs.p, w.bounds)
                digests = [hashlib.sha256(b" ".join(t.encode().split()) if t else b"").digest() for t in text.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), keys.slice(i, j - i), pa.array(w.counts, pa.int64()), pa.array(digests, pa.binary()), K.list_array(K.signed(runs.core()), bounds, pa.int64()), K.list_array(K.signed(runs.told()[0]), bounds, pa.int64())],
                    names=["id", "key", "n_words", "sha", "prefixes", "told"],
                )

    return run


def _grown(w: K.Words, window: int, growing: list[np.ndarray]) -> _Segments:
    """Runs of a slice, each split while its prefix is in the bitmap of its level."""
    runs = _Segments(w, window)
    for bits in growing:
        runs.split(bits[(runs.core() & K.U(CELLS - 1)).astype(np.int64)])
    return runs


def _longer(window: int, packed: list[np.ndarray], most: int = 1 << 18):
    """Distinct (prefix, segment) of the runs that the last split has made, of what a task has in hand."""
    total = window - min(PREFIX, window)

    def run(batches):
        growing = [np.unpackbits(x).astype(bool) for x in packed]
        cores, told, n = [], [], 0

        def out():
            both = np.unique(np.stack([np.concatenate(cores), np.concatenate(told)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(K.signed(np.ascontiguousarray(both[:, k]))) for k in (0, 1)], names=["core", "told"])

        for batch in batches:
            for _, _, w in K.hashed(batch.column(0), K.BLANKS, False):
                runs = _grown(w, window, growing)
                runs.take(runs.last - runs.first < total >> (len(growing) - 1))
                cores.append(runs.core())
                told.append(runs.told()[0])
                n += len(cores[-1])
                if n >= most:
                    yield out()
                    cores, told, n = [], [], 0
        if n:
            yield out()

    return run


def _coded(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :CODE]


def _segments(window: int, packed: list[np.ndarray], most: int = 1 << 20):
    """Segments under their prefixes, as rows (core, key, start, words, covered).

    A segment seen once in what a task has in hand is a row of its own. Of one seen more often every place is known to
    repeat: a document's places go into one row (covered, without words) under a hash of their own, and a single row
    without a key shows the segment to the others. So a hot segment has at most one row per task's block.
    """

    def flush(parts):
        core, key, start, size, one, two, codes = (np.concatenate(x) for x in zip(*parts))
        begin = np.cumsum(size) - size
        order = np.lexsort((two, one))
        same = np.zeros(len(order), bool)
        same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        group = np.cumsum(~same) - 1
        many = (np.bincount(group) > 1)[group] if len(group) else same
        single, shown, again = order[~many], order[many & ~same], order[many]
        again = again[np.lexsort((start[again], key[again]))]
        fresh = np.flatnonzero(np.diff(key[again], prepend=~key[again][:1]) != 0) if len(again) else np.zeros(0, np.int64)
        worded = np.concatenate([single, shown])
        n, m = len(worded), len(fresh)
        at = np.append(np.cumsum(size[worded]) - size[worded], size[worded].sum())
        spots = np.repeat(begin[worded] - at[:-1], size[worded]) + np.arange(at[-1])
        data = np.ascontiguousarray(codes[spots])
        offsets = np.concatenate([at * CODE, np.full(m, at[-1] * CODE)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n + m, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
        absent = np.zeros(n + m, bool)
        absent[len(single) : n] = True
        covered = K.list_array((start[again] << 32) | (start[again] + size[again]), np.concatenate([np.zeros(n, np.int64), fresh, [len(again)]]), pa.int64())
        own = key[again][fresh]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([core[worded], own])), pa.array(np.concatenate([key[worded], own]), mask=absent), pa.array(np.concatenate([start[worded], np.zeros(m, np.int64)])), words, covered],
            names=["core", "key", "start", "words", "covered"],
        )
        for x in range(0, n + m, 10_000):  # small batches, so that the JVM holds little at once
            yield batch.slice(x, 10_000)

    def run(batches):
        growing = [np.unpackbits(x).astype(bool) for x in packed]
        parts, n = [], 0
        for batch in batches:
            keys, shared = np.asarray(batch.column(0)), batch.column(2)
            flat, at = np.asarray(shared.flatten()), np.asarray(shared.offsets)
            at = at - at[0]
            for i, j, w in K.hashed(batch.column(1), K.BLANKS, False):
                runs = _Segments(w, window)
                runs.take(runs.within(flat[at[i] : at[j]], np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))))
                for bits in growing:
                    runs.split(bits[(runs.core() & K.U(CELLS - 1)).astype(np.int64)])
                one, two, spots, size = runs.told()
                parts.append((K.signed(runs.core()), keys[i + runs.doc], runs.lo - w.bounds[runs.doc], size, one, two, _coded(w.hashes[spots])))
                n += len(spots)
                if n >= most:
                    yield from flush(parts)
                    parts, n = [], 0
        if n:
            yield from flush(parts)

    return run


def depths(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each place in segments bounds[i]:bounds[i+1] of words, the depth of its suffix's deepest inner node in the tree of all suffixes: the length of its longest prefix that also starts at another place."""
    n = len(words)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # words to the segment's end
    ranks, length = [np.unique(words, return_inverse=True)[1].astype(np.int64) + 1], 1
    while length < left.max():  # order by twice as many words at a time; the end comes before any word
        beyond = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(left > length)
        beyond[inside] = ranks[-1][inside + length]
        ranks.append(np.unique(ranks[-1] * (n + 2) + beyond, return_inverse=True)[1].astype(np.int64) + 1)
        length *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    most = np.minimum(left[a], left[b])
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        ok = np.flatnonzero(common < most)
        x, y = a[ok] + common[ok], b[ok] + common[ok]
        same = ranks[k][x] == ranks[k][y]
        common[ok[same]] += 1 << k
    common = np.minimum(common, most)
    out = np.zeros(n, dtype=np.int64)
    out[order[1:]] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common)
    return out


def _trees(window: int):
    """Stretches of repeated words (start << 32 | end) per document, of rows that come sorted by prefix; a prefix's rows are held together."""

    def build(held):
        keys, starts, words = zip(*held)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, CODE)
        codes = np.zeros((len(raw), 8), dtype=np.uint8)
        codes[:, :CODE] = raw
        bounds = np.concatenate([[0], np.cumsum([len(x) // CODE for x in words])])
        depth = depths(codes.view(np.uint64).ravel(), bounds)
        at = np.flatnonzero(depth >= window)
        row = np.searchsorted(bounds, at, side="right") - 1
        keep = np.array([k is not None for k in keys])[row]
        at, row = at[keep], row[keep]
        start = np.array(starts, dtype=np.int64)[row] + at - bounds[row]
        end = start + depth[at]
        # stretches of one row that meet are one
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > np.maximum.accumulate(end + row * (1 << 33))[:-1] - row[1:] * (1 << 33))
        first = np.flatnonzero(new)
        if not len(first):
            return None
        ends = np.maximum.reduceat(end, first)
        return pa.array([keys[r] for r in row[first].tolist()], pa.int64()), K.list_array((start[first] << 32) | ends, np.arange(len(first) + 1), pa.int64())

    def run(batches):
        held, n, last, seen = [], 0, None, set()
        for batch in batches:
            known = batch.filter(pc.greater(pc.list_value_length(batch.column("covered")), 0))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column("key"), known.column("covered")], names=["key", "covered"])
            for core, key, start, words in zip(*(batch.column(c).to_pylist() for c in ("core", "key", "start", "words"))):
                if not words:
                    continue
                if core != last:
                    if n >= TREE_WORDS:
                        if found := build(held):
                            yield pa.RecordBatch.from_arrays(list(found), names=["key", "covered"])
                        held, n = [], 0
                    last, seen = core, set()
                if key is None:
                    if words in seen:
                        continue
                    seen.add(words)
                held.append((key, start, words))
                n += len(words) // CODE
        if held and (found := build(held)):
            yield pa.RecordBatch.from_arrays(list(found), names=["key", "covered"])

    return run


def covered(stretches: np.ndarray, n_words: int) -> np.ndarray:
    """Which of n_words words lie in the stretches (start << 32 | end)."""
    change = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(change, stretches >> 32, 1)
    np.add.at(change, stretches & 0xFFFFFFFF, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(batches):
    for batch in batches:
        ids, text, places = batch.columns
        ids, out = ids.to_pylist(), []
        for d in range(batch.num_rows):
            words = (text[d].as_py() or "").encode().split()
            gone = covered(np.asarray(places[d].values), len(words))
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            out.append((ids[d], len(words), int(gone.sum()), hashlib.sha256(kept).digest(), kept.decode()))
        a, b, c, d, e = zip(*out) if out else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary()), pa.array(e)], names=["id", "n_words", "n_removed", "sha", "kept"])


def _to_grow(index: DataFrame, inner: DataFrame, text: DataFrame, tables: Tables, window: int) -> list[np.ndarray]:
    """Bitmaps of the prefixes that are made longer, level by level: those of more than GROUP unlike segments."""

    def bitmap(pairs: DataFrame) -> np.ndarray:
        hot = pairs.distinct().groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
        cells = [r.cell for r in hot.select(F.col("core").bitwiseAND(CELLS - 1).alias("cell")).distinct().collect()]  # at most CELLS
        bits = np.zeros(CELLS, dtype=bool)
        bits[cells] = True
        return np.packbits(bits)

    many = tables("many", inner.where(F.col("n") > GROUP).select("core"))
    if many.isEmpty():
        return []
    listed = F.explode(F.arrays_zip(F.col("prefixes").alias("core"), F.col("told").alias("told")))
    runs = index.select("key", listed.alias("run")).select("key", "run.core", "run.told").join(sized(many), "core")
    runs = tables("runs", runs)
    packed = [bitmap(runs.select("core", "told"))]
    held = tables("warm", runs.select("key").distinct())
    warm = keep_ids(text, held, "key").select("text")
    while packed[-1].any() and (window - min(PREFIX, window)) >> len(packed):
        packed.append(bitmap(warm.mapInArrow(_longer(window, packed), "core long, told long")))
    return packed if packed[-1].any() else packed[:-1]


def repeated_words(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (and kept_text if texts is set).

    Words are [^\\x20\\x09-\\x0D]+, unchanged; null texts have none. A word goes if a window of `window` words over
    it also starts at another place, in the same document or another; judged on the input. Documents shorter
    than the window keep all. Rows that repeat an id, or whole rows, are documents of their own. Ids may be
    null; other columns of docs are ignored; an empty table gives an empty result.

    Words are compared by the CODE low bytes of a 64-bit hash. Texts are shuffled only for documents with a shared prefix.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[id_col], docs[text_col]).alias("key"), docs[text_col].alias("text"))
    tables = Tables(docs.sparkSession, "suffix")
    index = tables("index", rows.mapInArrow(_index(window), "id long, key long, n_words long, sha binary, prefixes array<long>, told array<long>"))
    suffixes = index.select("key", F.explode("prefixes").alias("core"))
    inner = tables("inner", suffixes.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = tables("shared", suffixes.join(inner.select("core"), "core").groupBy("key").agg(F.collect_set("core").alias("prefixes")))
    text = keep_ids(rows.select("key", "text"), shared.select("key"), "key")
    packed = _to_grow(index, inner, text, tables, window)
    segments = text.join(shared, "key").select("key", "text", "prefixes").mapInArrow(_segments(window, packed), "core long, key long, start long, words binary, covered array<long>")
    found = segments.repartition("core").sortWithinPartitions("core").mapInArrow(_trees(window), "key long, covered array<long>")
    hit = tables("hit", found.groupBy("key").agg(F.flatten(F.collect_list("covered")).alias("places")))

    tables.only("index", "hit")
    changed = keep_ids(rows, hit.select("key"), "key").join(hit, "key").select("id", "text", "places")
    changed = changed.mapInArrow(_cut, "id long, n_words long, n_removed long, sha binary, kept string")
    same = index.select("id", "key", "n_words", "sha").join(hit.select("key"), "key", "left_anti")
    if not texts:
        changed = changed.drop("kept")
        out = changed.unionByName(same.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha"))
        return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"))
    whole = rows.join(hit.select("key"), "key", "left_anti").mapInArrow(_cut_none, "id long, n_words long, n_removed long, sha binary, kept string")
    return changed.unionByName(whole).select(F.col("id").alias(id_col), "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"), F.col("kept").alias("kept_text"))


def _cut_none(batches):
    for batch in batches:
        ids, _, text = batch.select(["id", "key", "text"]).columns
        words = [(t or "").encode().split() for t in text.to_pylist()]
        kept = [b" ".join(w) for w in words]
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([hashlib.sha256(k).digest() for k in kept], pa.binary()), pa.array([k.decode() for k in kept])], names=["id", "n_words", "n_removed", "sha", "kept"])
