"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions only.

A fingerprint is the least hash of GRAM-word grams in a sliding window of (window - GRAM + 1) grams, so any
`window` consecutive words hold at least one, on both sides the same. Documents' fingerprints are joined to the
benchmark's; every window around a meeting point is then extended to its whole words and compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import SMALL_ROWS, Tables, keep_ids

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Low bits of a fingerprint that hold its position, which no string's words exceed; the rest is the gram's hash.
_PLACE = 30
#: First words of short items that are looked for in place; where there are more, every place is joined.
FIRST_WORDS = 2000
#: Words of a gram; windows of fewer words use grams of one word less than the window.
GRAM = 8


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _fingerprints(rows: DataFrame, window: int) -> DataFrame:
    """rows (with words, n_words) and their array of fingerprints, hash above place."""
    k = min(GRAM, max(1, window - 1))
    width = window - k + 1
    mask = (1 << _PLACE) - 1
    gram = lambda i: F.xxhash64(F.slice("words", i + 1, k)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(mask)))
    grams = F.when(F.col("n_words") >= window, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - k), gram)).otherwise(F.array().cast("array<long>"))
    least = lambda i: F.least(*[F.get("grams", i + j) for j in range(width)]) if width > 1 else F.get("grams", i)
    marks = F.when(F.size("grams") > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("grams") - width), least))).otherwise(F.array().cast("array<long>"))
    return rows.withColumn("grams", grams).withColumn("marks", marks).drop("grams")


def _sized(df: DataFrame) -> DataFrame:
    """A broadcast hint where df (stored) is small enough; else a shuffled join."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df.hint("shuffle_merge")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", spans: bool = False, keys: bool = False):
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, and with keys row_key, xxhash64(id, text); with spans, also (id, start, length, items).

    Words follow WORD after A-Z became a-z; null texts have none. A window is `window` consecutive words of an item;
    an item of fewer words, but not none, is one window. A document word inside an occurrence of a window is hit.
    Items may repeat; a null item_id never counts as an item but its windows do hit. Rows that repeat an id are
    judged each by itself. Empty tables give empty results or no hits; other columns are ignored.
    """
    tables = Tables(docs.sparkSession, "decontam")
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], docs[text_col]).alias("key"), docs[text_col].alias("text"))
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), words_of(benchmark[item_text_col]).alias("words"))
    items = items.withColumn("n_words", F.size("words").cast("long")).where("n_words > 0")
    items = tables("items", items)

    # the windows, as whole strings, each with its items
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_words").cast("int") - window))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, window), " "))).alias("window"))
    windows = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    windows = tables("item-windows", windows.withColumn("size", F.size(F.split("window", " "))))
    marks = _fingerprints(items.where(F.col("n_words") >= window), window).select(F.explode("marks").alias("v")).select(F.shiftright("v", _PLACE).alias("mark")).distinct()
    marks = _sized(tables("item-marks", marks.withColumn("met", F.lit(True))))

    worded = rows.select("id", "key", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    marked = _fingerprints(worded, window).select("id", "key", "n_words", F.explode(F.concat("marks", F.array(F.lit(-1).cast("long")))).alias("v"))
    met = marked.withColumn("mark", F.shiftright("v", _PLACE)).join(marks, "mark", "left").where("v = -1 OR met")
    met = tables("marks", met.select("id", "key", "n_words", "v"))

    # a window of the document that holds the fingerprint at place p starts between p - (window - GRAM) and p
    k = min(GRAM, max(1, window - 1))
    place = F.col("v").bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
    near = met.where("v <> -1").select("key", F.explode(F.sequence(F.greatest(F.lit(0), place - (window - k)), place)).alias("start"))
    near = tables("starts", near.groupBy("key").agg(F.collect_set("start").alias("starts")))
    text = keep_ids(rows.select("key", "text"), near.select("key"), "key").dropDuplicates(["key"])
    cut = text.join(near, "key").select("key", words_of(F.col("text")).alias("words"), "starts")
    cut = cut.select("key", F.explode(F.transform(F.filter("starts", lambda s: s + window <= F.size("words")), lambda s: F.struct(s.alias("start"), F.array_join(F.slice("words", s + 1, window), " ").alias("window")))).alias("x"))
    full = _sized(windows.where(F.col("size") == window))
    hits = cut.select("key", F.col("x.start").alias("start"), F.col("x.window").alias("window")).join(full, "window").select("key", "start", "size", "items")

    # items of fewer words than a window have no fingerprint: where their first word stands, as many words as each of
    # their lengths are joined to them, in one pass over the texts
    sizes = sorted(r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect())  # less than `window` numbers
    if sizes:
        short = windows.where(F.col("size") < window)
        first = [r.word for r in short.select(F.substring_index("window", " ", 1).alias("word")).distinct().limit(FIRST_WORDS + 1).collect()]
        here = lambda i: F.get("words", i).isin(first) if len(first) <= FIRST_WORDS else F.lit(True)
        spots = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
        run = lambda i, n: F.when(i + n <= F.size("words"), F.struct(i.alias("start"), F.array_join(F.slice("words", i + 1, n), " ").alias("window")))
        runs = F.flatten(F.transform(spots, lambda i: F.array_compact(F.array(*[run(i, n) for n in sizes]))))
        mine = worded.where("n_words > 0").select("key", F.explode(runs).alias("x")).select("key", "x.start", "x.window")
        hits = hits.unionByName(mine.join(_sized(short), "window").select("key", "start", "size", "items").distinct())
    hits = tables("hits", hits)

    spots = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"))
    total = F.aggregate("spots", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])
    per = hits.groupBy("key").agg(spots.alias("spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per = per.select("key", total.alias("n_hit"), "items")
    per = tables("totals", per)
    out = met.where("v = -1").select("id", "key", "n_words").join(per, "key", "left")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), *([F.col("key").alias("row_key")] if keys else []))
    tables.only("marks", "totals", *(["hits"] if spans else []))
    if not spans:
        return out
    named = met.where("v = -1").select("id", "key").distinct().join(hits, "key")
    return out, named.select(F.col("id").alias(id_col), "start", F.col("size").alias("length"), "items")
