"""Size-aware set-similarity join over word n-grams.

Sets of at most a boundary size are light: they enumerate their subsets of the size that a linked pair must
share, so that two light sets meet only if they are linked. Larger sets are heavy: they scan inverted lists of
their rarest shingles (a prefix long enough that linked sets must meet there). The boundary is chosen by
comparing the number of subsets with the length of the lists scanned, which is measured: shingles that aren't frequent
by the number of distinct ones. Frequent shingles, found by a sketch of fixed size, come last in the order and so
hardly ever own a list.

Only classes of equal sets (128 bits and the size agree) take part. A list links its members to its first one; what that
leaves apart is compared inside the list by parity sketches, whose distance never exceeds the true difference: first each
member with its nearest, which joins most of what belongs together, then always all whose components still differ.
Every link counted is verified on the whole sets, and no pair that could link distinct components is left out,
so components are exact while the pairs handled stay near-linear in a group's size.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._cluster import Tables, components, keep_ids, sized

#: Cells of the shingle sketch.
CELLS = 1 << 20
#: Least hashes that the number of distinct shingles is estimated from.
LEAST_HASHES = 1024
#: No set of more shingles than this is ever light.
LIGHT_AT_MOST = 14
#: Members of a list that are compared with one another in one piece; longer lists are cut into blocks.
BLOCK = 800
#: Members of a list that are compared pair by pair.
FEW = 12
_TOP = K.U(1 << 63)


class Rule:
    """Linked when 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n):
        return n - -(-self.percent * n // 100) + 1

    def partners(self, n: int) -> range:
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)


def shingles(w: K.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice and their bounds; a document of fewer words is one shingle."""
    grams, whole = w.grams(size)
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    take = whole.copy()
    for d in short:
        a, b = w.bounds[d], w.bounds[d + 1]
        h = K.U(int(b - a))
        with np.errstate(over="ignore"):
            for x in w.hashes[a:b]:
                h = K.mix(np.array([h * K.U(0x9FB21C651E98DF25) + x]))[0]
        grams[a], take[a] = h, True
    at = np.flatnonzero(take)
    return grams[at], np.searchsorted(at, w.bounds)


def _count_cells(size: int):
    """Rows (kind, value, n) of a partition: "cell" counts of at least four times the mean, the "all" count, and its "least" hashes."""

    def run(batches):
        total = np.zeros(CELLS, dtype=np.int64)
        least = np.zeros(0, dtype=K.U)
        for batch in batches:
            for _, _, w in K.hashed(batch.column(0), K.BLANKS, True):
                h, _ = shingles(w, size)
                total += np.bincount((h & K.U(CELLS - 1)).astype(np.int64), minlength=CELLS)
                m = K.mix(h)
                if len(least) == LEAST_HASHES:
                    m = m[m < least[-1]]
                least = np.unique(np.concatenate([least, m]))[:LEAST_HASHES]
        n = int(total.sum())
        cells = np.flatnonzero(total >= max(8, 4 * n / CELLS))
        kind = ["cell"] * len(cells) + ["all"] + ["least"] * len(least)
        value = np.concatenate([cells, [-1], (least >> K.U(1)).astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(value, pa.int64()), pa.array(np.concatenate([total[cells], [n], np.zeros(len(least), np.int64)]), pa.int64())], names=["kind", "value", "n"])

    return run


def frequent_cells(docs: DataFrame, size: int, tables: Tables) -> tuple[np.ndarray, float]:
    """Cells of the sketch that hold frequent shingles, a bitmap of CELLS bits whatever the corpus; and the mean length of the other shingles' lists."""
    found = tables("cells", docs.select("text").mapInArrow(_count_cells(size), "kind string, value long, n long"))
    rows = found.where("kind <> 'least'").groupBy("kind", "value").agg(F.sum("n").alias("n")).collect()  # at most CELLS + 1
    least = [r.value for r in found.where("kind = 'least'").select("value").distinct().orderBy("value").limit(LEAST_HASHES).collect()]
    tables.drop("cells")
    total = rare = next((r.n for r in rows if r.kind == "all"), 0)
    out = np.zeros(CELLS, dtype=bool)
    for r in rows:
        if r.kind == "cell" and r.n >= 2 * total / CELLS:
            out[r.value] = True
            rare -= r.n
    distinct = len(least) if len(least) < LEAST_HASHES else (LEAST_HASHES - 1) / ((least[-1] + 1) / 2.0**63)
    return out, max(1.0, rare / max(1.0, distinct))


def choose_boundary(sizes: dict[int, int], rule: Rule, list_length: float) -> int:
    """The largest size whose sets enumerate subsets for less than their prefix lists cost to scan."""
    best, best_cost = 0, None
    for x in range(0, LIGHT_AT_MOST + 1):
        cost = 0.0
        for n, count in sizes.items():
            light = sum(comb(n, c) for c in _subset_sizes(n, x, rule)) if n <= x else 0
            lists = rule.prefix(n) * list_length if n > x or 100 * n >= rule.percent * (x + 1) else 0
            cost += count * (light + lists)
        if best_cost is None or cost < best_cost:
            best, best_cost = x, cost
    return best


def _subset_sizes(n: int, boundary: int, rule: Rule) -> list[int]:
    return sorted({int(rule.overlap(n, b)) for b in rule.partners(n) if 0 < b <= boundary and rule.overlap(n, b) <= min(n, b)})


def _sketch_bits(n: int) -> int:
    return max(64, 1 << int(n - 1).bit_length()) if n > 1 else 64


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Bits that flip for each token, as many as the next power of two; a longer sketch folds onto a shorter by XOR."""
    m = _sketch_bits(len(tokens))
    counts = np.bincount((K.mix(tokens ^ K.U(0x5851F42D4C957F2D)) & K.U(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        sketch = (sketch >> bits) ^ (sketch & ((1 << bits) - 1))
    return sketch


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to fewer words."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _tokens(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Distinct shingles in global order: rare before frequent, then by hash."""
    heavy = frequent[(h & K.U(CELLS - 1)).astype(np.int64)]
    return np.unique((h >> K.U(1)) | np.where(heavy, _TOP, K.U(0)))


def _features(size: int, frequent: np.ndarray, rule: Rule, boundary: int):
    packed = np.packbits(frequent)

    def run(batches):
        heavy = np.unpackbits(packed).astype(bool)
        for batch in batches:
            ids, rows, text = batch.columns
            for i, j, w in K.hashed(text, K.BLANKS, True):
                h, bounds = shingles(w, size)
                n, s1, s2, keys, sketches, at = [], [], [], [], [], [0]
                for d in range(j - i):
                    t = _tokens(h[bounds[d] : bounds[d + 1]], heavy)
                    n.append(len(t))
                    s1.append(int(K.signed(np.add.reduce(K.mix(t), keepdims=True))[0]) if len(t) else 0)
                    s2.append(int(K.signed(np.add.reduce(K.mix(t ^ K.U(0xC2B2AE3D27D4EB4F)), keepdims=True))[0]) if len(t) else 0)
                    mine = _keys(t, rule, boundary)
                    keys.append(mine)
                    at.append(at[-1] + len(mine))
                    sketches.append(parity_sketch(t))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), rows.slice(i, j - i), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), K.list_array(K.signed(np.concatenate(keys)), np.array(at), pa.int64()), pa.array(sketches, pa.binary())],
                    names=["doc", "id", "n", "s1", "s2", "keys", "sketch"],
                )

    return run


def _keys(t: np.ndarray, rule: Rule, boundary: int) -> np.ndarray:
    n = len(t)
    if not n:
        return np.zeros(0, dtype=K.U)
    out = []
    if n <= boundary:
        m = K.mix(t)
        for c in _subset_sizes(n, boundary, rule):
            sums = [np.add.reduce(m[list(s)]) for s in combinations(range(n), c)]
            out.append(K.mix(np.array(sums, dtype=K.U) + K.U(c)))
    if n > boundary or 100 * n >= rule.percent * (boundary + 1):
        out.append(K.mix(t[: rule.prefix(n)]))
    return np.concatenate(out) if out else np.zeros(0, dtype=K.U)


def _near(a, b, na, nb, rule: Rule) -> bool:
    """Whether two sketches allow a link."""
    words = min(len(a), len(b))
    d = int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum())
    return d <= na + nb - 2 * int(rule.overlap(na, nb))


def _sifted(rule: Rule):
    """Pairs whose sizes and sketches allow a link."""

    def run(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(k) for k in range(6))
            na, nb = na.to_pylist(), nb.to_pylist()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for r in range(batch.num_rows):
                lo, hi = (na[r], nb[r]) if na[r] <= nb[r] else (nb[r], na[r])
                keep[r] = 100 * lo >= rule.percent * hi and _near(np.frombuffer(sa[r].as_py(), K.U), np.frombuffer(sb[r].as_py(), K.U), na[r], nb[r], rule)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    return run


def _verified(rule: Rule):
    def run(batches):
        for batch in batches:
            a, b, ta, tb = batch.columns
            keep = np.zeros(batch.num_rows, dtype=bool)
            for r in range(batch.num_rows):
                x, y = np.frombuffer(ta[r].as_buffer(), K.U), np.frombuffer(tb[r].as_buffer(), K.U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[r] = 100 * common >= rule.percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    return run


def _sets(size: int, frequent: np.ndarray):
    packed = np.packbits(frequent)

    def run(batches):
        heavy = np.unpackbits(packed).astype(bool)
        for batch in batches:
            ids, text = batch.columns
            for i, j, w in K.hashed(text, K.BLANKS, True):
                h, bounds = shingles(w, size)
                tokens = [_tokens(h[bounds[d] : bounds[d + 1]], heavy).tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(tokens, pa.binary())], names=["id", "tokens"])

    return run


def _apart(rule: Rule, nearest: int):
    """Pairs inside a list whose components differ and whose sketches allow a link: for each member the nearest ones, or all if nearest is 0.

    Rows come sorted by (key, block_a, block_b); a row is in the left block, the right one, or both.
    """

    def few(rows):
        """Pairs of a short list, whose sketches are compared as whole numbers."""
        found = []
        for x, (ida, ca, na, da, sa) in enumerate(rows):
            for idb, cb, nb, db, sb in rows[:x]:
                if ca == cb or 100 * min(na, nb) < rule.percent * max(na, nb) or da + db in (2, 4) and da and db:
                    continue
                a, b, bits = int.from_bytes(sa, "little"), int.from_bytes(sb, "little"), 8 * min(len(sa), len(sb))
                a, b = _folded(a, 8 * len(sa), bits), _folded(b, 8 * len(sb), bits)
                if (a ^ b).bit_count() <= na + nb - 2 * rule.overlap(na, nb):
                    found.append((ida, idb) if ida < idb else (idb, ida))
        return found

    def pairs(rows):
        """Pairs of a longer list, as arrays; a pair is met once, from the member with the shorter sketch."""
        ids, comp, n, side, sketch = rows
        if (comp == comp[0]).all():
            return
        left, right = side != 2, side != 1
        words = np.array([len(s) // 8 for s in sketch])
        for m in np.unique(words):  # fold what is longer than the shorter partner of each pair
            longer = np.flatnonzero((words >= m) & (words <= 4 * m))
            table = np.stack([fold(np.frombuffer(sketch[x], K.U), m) for x in longer])
            for at_x, x in enumerate(longer):
                if words[x] != m:
                    continue
                ok = (comp[longer] != comp[x]) & ((words[longer] > m) | (longer > x))
                if side[x] != 0:
                    ok &= (right if side[x] == 1 else left)[longer]
                lo, hi = np.minimum(n[longer], n[x]), np.maximum(n[longer], n[x])
                ok &= 100 * lo >= rule.percent * hi
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                d = np.bitwise_count(table[at] ^ table[at_x]).sum(axis=1)
                fine = d <= n[x] + n[longer[at]] - 2 * rule.overlap(n[x], n[longer[at]])
                at, d = at[fine], d[fine]
                if nearest and len(at) > nearest:
                    at = at[np.argpartition(d, nearest)[:nearest]]
                other = ids[longer[at]]
                yield np.minimum(other, ids[x]), np.maximum(other, ids[x])

    def close(held):
        if len(held) <= FEW:
            found = few(held)
            if found:
                yield tuple(np.array(x) for x in zip(*found))
        else:
            ids, comp, n, side, sketch = zip(*held)
            yield from pairs((np.array(ids), np.array(comp), np.array(n), np.array(side), sketch))

    def closed(batches):
        held, mark = [], None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, ba, bb, *row in zip(*columns):
                if (key, ba, bb) != mark:
                    yield from close(held)
                    held, mark = [], (key, ba, bb)
                held.append(row)
        yield from close(held)

    def run(batches):
        found, n = [], 0
        for a, b in closed(batches):
            found.append((a, b))
            n += len(a)
            if n >= 20_000:
                yield _pair_batch(found)
                found, n = [], 0
        if n:
            yield _pair_batch(found)

    return run


def _pair_batch(found):
    a, b = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", pairs: bool = False, keys: bool = False):
    """One row per row of docs: id, n_shingles, component_id, and with keys row_key and keep_key; with pairs, also the verified links found.

    A-Z become a-z; words are [^\\x20\\x09-\\x0D]+; a set holds the distinct shingles of `size` words, or the whole
    sequence if there are fewer words. Sets link when 100 * intersection >= percent * union. component_id is the
    smallest id that links reach. Null and empty texts have no set and are their own component. Rows with
    equal sets are linked. Ids are integers; a row with a null id takes part, and component_id is null where no id is
    reached. Rows that repeat an id are documents of their own. row_key is xxhash64(id, text), alike for equal rows only;
    keep_key is that of the row with the smallest id of the component (null ids last, then the smallest key).
    An empty table gives an empty result; other columns of docs are ignored.

    The links returned connect the components; pairs inside a component that follow from others are not all listed.
    """
    rule = Rule(percent)
    # a row is known by a hash of its id and text; equal rows are one and share their set
    rows = docs.select(docs[id_col].cast("long").alias("doc"), F.xxhash64(docs[id_col].cast("long"), docs[text_col]).alias("id"), docs[text_col].alias("text"))
    tables = Tables(docs.sparkSession, "join")
    frequent, list_length = frequent_cells(rows, size, tables)
    # light sets have few words: their sizes follow from a cheap bound, so the histogram is at most LIGHT_AT_MOST rows
    short = rows.where(F.length("text") <= 400).select(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")).alias("w")).where(F.col("w").between(1, LIGHT_AT_MOST + size)).groupBy("w").count().collect()
    sizes: dict[int, int] = {}
    for r in short:
        n = max(1, r.w - size + 1)
        sizes[n] = sizes.get(n, 0) + r["count"]
    boundary = choose_boundary(sizes, rule, list_length)

    features = tables("features", rows.mapInArrow(_features(size, frequent, rule, boundary), "doc long, id long, n long, s1 long, s2 long, keys array<long>, sketch binary"))
    named = features.where("n > 0")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id"))
    classes = tables("classes", named.groupBy("s1", "s2", "n").agg(first.alias("least"), first["id"].alias("rep")))

    reps = classes.select(F.col("rep").alias("id"), "s1", "s2", "n")
    own = named.join(reps, ["id", "s1", "s2", "n"], "left_semi").select("id", "n", "keys", "sketch").dropDuplicates(["id"])
    postings = own.select("id", "n", F.explode("keys").alias("key")).repartition("key")
    lists = postings.withColumn("m", F.expr("count(1) OVER (PARTITION BY key)")).where("m > 1")
    lists = lists.withColumn("leader", F.expr("min(struct(n, id)) OVER (PARTITION BY key)").getField("id"))
    lists = tables("lists", lists)
    listed = tables("listed", lists.select("id").distinct())
    sketches = tables("sketches", own.select("id", "n", "sketch").join(listed, "id", "left_semi"))

    def linked(candidates: DataFrame, name: str) -> DataFrame:
        """The candidates (a < b) that are links."""
        left = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        sifted = candidates.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
        sifted = tables(f"sifted-{name}", sifted.mapInArrow(_sifted(rule), "a long, b long"))
        ids = tables(f"ids-{name}", sifted.select(F.col("a").alias("id")).union(sifted.select("b")).distinct())
        sets = keep_ids(rows.select("id", "text"), ids, "id").mapInArrow(_sets(size, frequent), "id long, tokens binary").dropDuplicates(["id"])
        sets = tables(f"sets-{name}", sets)
        both = sets.toDF("a", "ta").join(sized(sifted), "a").join(sets.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return tables(f"links-{name}", both.mapInArrow(_verified(rule), "a long, b long"))

    star = lists.where("leader <> id").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
    links = linked(star, "star")
    for name, nearest in (("near", 3), ("rest", 0)):
        comp = components(links, tables, f"comp-{name}")
        # pairs with a list's leader are tested already
        tagged = lists.where("m > 2 AND id <> leader").select("key", "id", "n", "m").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        tagged = tables(f"tagged-{name}", tagged)
        mixed = tagged.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        mixed = tables(f"mixed-{name}", mixed)
        rest = tagged.join(mixed, "key").join(sketches.select("id", "sketch"), "id")
        found = tables(f"found-{name}", _blocks(rest).mapInArrow(_apart(rule, nearest), "a long, b long").distinct())
        links = tables(f"all-{name}", links.union(linked(found, name)).distinct())
        tables.drop(f"tagged-{name}", f"mixed-{name}", f"found-{name}")
    comp = components(links, tables, "comp-last").withColumnRenamed("id", "rep")
    # links join rows; a component is named by the least id of its classes
    reached = classes.join(comp, "rep", "left").select("s1", "s2", "n", "least", F.coalesce("component", "rep").alias("component"))
    reached = tables("reached", reached)
    least = tables("least", reached.groupBy("component").agg(F.min("least").alias("least")))
    reached = tables("named", reached.drop("least").join(least, "component").select("s1", "s2", "n", F.col("least.doc").alias("component_id"), F.col("least.id").alias("keep")))
    result = features.select("doc", "id", "n", "s1", "s2").join(reached, ["s1", "s2", "n"], "left")
    some = F.col("n") > 0
    own = [F.col("id").alias("row_key"), F.when(some, F.col("keep")).otherwise(F.col("id")).alias("keep_key")] if keys else []
    result = result.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"), *own)
    if not pairs:
        tables.only("features", "named")
        return result
    tables.only("features", "named", "classes", "all-rest")
    ids = classes.select("rep", F.col("least.doc").alias("least"))
    named_links = links.join(ids.toDF("a", "first"), "a").join(ids.toDF("b", "second"), "b")
    return result, named_links.select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows dealt to pieces of at most about BLOCK x BLOCK members; side 0 is in both blocks, 1 left, 2 right."""
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), n.cast("long")).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("ba"), F.greatest(x, F.col("mine")).alias("bb"), F.when(x == F.col("mine"), 0).when(F.col("mine") < x, 1).otherwise(2).alias("side")))
    dealt = rows.withColumn("mine", mine).withColumn("piece", F.explode(pieces))
    dealt = dealt.select("key", F.col("piece.ba").alias("ba"), F.col("piece.bb").alias("bb"), "id", "component", "n", F.col("piece.side").alias("side"), "sketch")
    return dealt.repartition("key", "ba", "bb").sortWithinPartitions("key", "ba", "bb")
