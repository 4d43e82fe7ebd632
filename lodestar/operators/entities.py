"""Entities and keywords. Recognisers are providers; the default needs no model and makes no claim to one's quality."""

from __future__ import annotations

import re
from collections import Counter
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Labels of a recogniser and what they count as.
CATEGORIES = {"PERSON": "person", "ORG": "org", "GPE": "location", "LOC": "location", "FAC": "location", "NORP": "org", "EVENT": "event", "PRODUCT": "product", "WORK_OF_ART": "work"}
# Words that are never a keyword.
NO_KEYWORD = frozenset("thing things stuff note notes item items page file files day days time times year years week month lot bit part way kind sort number e.g i.e".split())
ACRONYM_FREE = ("org", "product", "work")
KEYWORDS = 25


class Recogniser(Protocol):
    """Gives (surface, label, start, end) of a text."""

    def __call__(self, text: str) -> list[tuple[str, str, int, int]]: ...


_CAPITALS = re.compile(r"\b[A-Z][\w'’.-]*(?:\s+(?:of|the|and|de|von|for)\s+[A-Z][\w'’.-]*|\s+[A-Z][\w'’.-]*)+")


def capitalised(text: str) -> list[tuple[str, str, int, int]]:
    """Runs of capitalised words, as persons unless a word names another category."""
    out = []
    for m in _CAPITALS.finditer(text):
        low = m[0].lower()
        label = "ORG" if re.search(r"\b(university|institute|college|inc|ltd|corp|company|bank|agency)\b", low) else "GPE" if re.search(r"\b(city|street|road|river|lake|mount|state)\b", low) else "PERSON"
        out.append((m[0], label, m.start(), m.end()))
    return out


def recognise(docs: DataFrame, recogniser: Recogniser = capitalised, key: str = "file_id", text: str = "text", longest: int | None = None) -> DataFrame:
    """(key, text, normalised, category, char_start, char_end): what a recogniser finds in each text, filtered.

    Texts are read whole; `longest` is for a recogniser whose memory needs a bound. Unknown labels, names under two characters, numbers, and bare acronyms of organisations, products and works go.
    """

    @F.pandas_udf("array<struct<surface:string,label:string,char_start:int,char_end:int>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("surface", "label", "char_start", "char_end"), x)) for x in recogniser((t or "")[:longest])])

    labels = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    rows = docs.select(key, F.explode(find(F.col(text))).alias("e")).select(key, "e.*")
    rows = rows.select(key, F.col("surface").alias("text"), T.normalise_entity("surface").alias("normalised"), F.try_element_at(labels, F.col("label")).alias("category"), "char_start", "char_end")
    return admissible(rows)


def places(surfaces: list[str], original: str) -> list[int]:
    """Where each of some surfaces, given in order, stands in a text: from where the one before ended, else anywhere; -1 if it doesn't."""
    out, after = [], 0
    for surface in surfaces:
        at = original.find(surface, after)
        at = original.find(surface) if at < 0 else at
        after = at + len(surface) if at >= 0 else after
        out.append(at)
    return out


def remap(found: DataFrame, docs: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """found (key, text, char_start, ...), named in a prepared text, with char_start and char_end in the documents' own texts; -1 where the surface is lost.

    Rows of a document are taken in the order of their char_start. A document without text loses all.
    """

    @F.pandas_udf("array<int>")
    def located(surfaces: pd.Series, original: pd.Series) -> pd.Series:
        return pd.Series([places(list(s), t or "") for s, t in zip(surfaces, original)])

    rest = [c for c in found.columns if c not in (key, "char_start", "char_end")]
    rows = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("char_start", *rest))).alias("rows"))
    rows = rows.join(docs.select(key, F.col(text).alias("original")), key, "left").withColumn("at", located(F.transform("rows", lambda x: x["text"]), F.col("original")))
    flat = rows.select(key, F.explode(F.arrays_zip("rows", "at")).alias("x")).select(key, *[F.col(f"x.rows.{c}").alias(c) for c in rest], F.col("x.at").alias("char_start"))
    return flat.withColumn("char_end", F.when(F.col("char_start") >= 0, F.col("char_start") + F.length("text")).otherwise(-1))


def admissible(rows: DataFrame) -> DataFrame:
    """Rows (normalised, category) worth keeping as entities."""
    keep = F.col("category").isNotNull() & (F.length("normalised") >= 2) & ~F.col("normalised").rlike("^[0-9]+$")
    return rows.where(keep & ~(F.col("category").isin(*ACRONYM_FREE) & T.is_acronym("normalised")))


def first_seen(entities: DataFrame) -> DataFrame:
    """Distinct names by file and category in the order they first appear."""
    first = entities.groupBy("file_id", "category", "normalised").agg(F.min("char_start").alias("at"))
    return first.groupBy("file_id", "category").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "normalised"))), lambda x: x["normalised"]).alias("names"))


def gazetteer(entities: DataFrame, least: int = 4) -> DataFrame:
    """(surface, category) of names of `least` characters or more with a lower-case letter, by their most frequent category."""
    good = entities.where((F.length("normalised") >= least) & F.col("normalised").rlike("[a-z]"))
    n = good.groupBy("normalised", "category").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("normalised").orderBy(F.col("n").desc(), "category")
    return n.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(F.col("normalised").alias("surface"), "category")


def propagate(docs: DataFrame, names: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, surface, category, n): whole-word places of known names in every text, case-sensitive.

    Texts are cut into runs of as many words as names have, whatever that is, and joined to the names by equality.
    """
    lengths = [r.n for r in names.select(F.size(F.split("surface", " ")).alias("n")).distinct().collect()]  # a few numbers
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}'’.-]+"), 0)
    runs = F.flatten(F.transform(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    rows = docs.select(key, words.alias("w")).select(key, F.explode(runs).alias("run")).select(key, F.regexp_replace("run", r"[.'’-]+$", "").alias("surface"))
    return rows.join(names, "surface").groupBy(key, "surface", "category").agg(F.count(F.lit(1)).alias("n"))


def keywords(docs: DataFrame, key: str = "file_id", text: str = "text", stop: list[str] | None = None, n: int = KEYWORDS) -> DataFrame:
    """(key, term, count, rank from 0): the n most frequent words over three letters that aren't stop words; ties by term."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]{3,}"), 0)
    t = docs.select(key, F.explode(words).alias("term")).where(~F.col("term").isin(*sorted(NO_KEYWORD | set(stop or ()))))
    c = t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(key).orderBy(F.col("count").desc(), "term")
    return c.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n)


def noun_like(text: str) -> Counter:
    """A dependency-free stand-in for a tagger's noun counts."""
    return Counter(w for w in re.findall(r"[a-z][a-z'-]{3,}", text.lower()) if w not in NO_KEYWORD)
