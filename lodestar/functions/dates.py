"""Date mentions: finding them, resolving them, and scoring whether they are commitments."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import let

# The forms of a date, tried in this order.
MONTH = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
FORMS = (
    ("dmy_numeric", r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b"),
    ("iso", r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"),
    ("dmy_written", r"\b(\d{1,2})(?:st|nd|rd|th)?\s+" + MONTH + r"(?:\s+(\d{4}))?\b"),
    ("mdy_written", r"\b" + MONTH + r"\s+(\d{1,2})(?:,?\s+(\d{4}))?\b"),
    ("year_only", r"\b(19\d{2}|20\d{2})\b"),
)
# Vocabularies with their strength.
COMMITMENT = {
    "deadline": 1.00, "due": 1.00, "exam": 1.00, "examination": 1.00, "viva": 1.00, "submission": 0.95, "submit": 0.90, "closes": 0.90, "closing": 0.90, "last date": 1.00, "expires": 0.90,
    "meeting": 0.85, "review": 0.85, "interview": 0.85, "presentation": 0.80, "defence": 0.90, "defense": 0.90, "test": 0.75, "quiz": 0.75, "appointment": 0.85, "scheduled": 0.80, "timetable": 0.85, "hall ticket": 0.80,
    "milestone": 0.75, "delivery": 0.70, "deliverable": 0.75, "target": 0.60, "reminder": 0.75, "by": 0.35, "before": 0.40, "on or before": 0.85, "no later than": 0.95, "starts": 0.55, "begins": 0.55, "ends": 0.55,
}
RECORD = {"attendance": 0.90, "attended": 0.85, "absent": 0.70, "completed": 0.80, "logged": 0.80, "recorded": 0.75, "history": 0.70, "log": 0.60, "reading": 0.50, "timestamp": 0.80, "applied on": 0.70, "marks": 0.55, "experiment": 0.50, "status": 0.35}
REFERENCE = {
    "born": 1.00, "birthday": 1.00, "birth": 0.95, "published": 0.90, "publication": 0.85, "founded": 0.90, "established": 0.85, "released": 0.80, "anniversary": 0.70, "century": 0.80,
    "historical": 0.85, "assassinated": 0.90, "independence": 0.75, "war": 0.60, "et al": 0.85, "film": 0.70, "movie": 0.70, "novel": 0.70, "author": 0.60,
}
NEUTRAL = 0.5
HEADER_DISCOUNT = 0.7
WEIGHTS = {"keyword": 0.40, "structured": 0.25, "metadata": 0.20, "crossfile": 0.15}
THRESHOLD = 0.55
WINDOW_TOKENS = 12
CONSISTENCY_DAYS = 60
YEAR_PENALTY = 0.35
SATURATION = 4
TOKEN = r"[A-Za-z][A-Za-z'-]*|[0-9]+"

_COMPILED = tuple((name, re.compile(pattern, re.I if "written" in name else 0)) for name, pattern in FORMS)
_MONTH_OF = {m.lower(): i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def _day(y: int, m: int, d: int) -> dt.date | None:
    try:
        return dt.date(y, m, d) if 1900 <= y <= 2099 else None
    except ValueError:
        return None


def nearest_year(month: int, day: int, near: dt.date | None) -> dt.date | None:
    """The day of that month closest to a date, among its year and its neighbours; the earlier of equals."""
    if near is None:
        return None
    found = [x for y in (near.year - 1, near.year, near.year + 1) if (x := _day(y, month, day))]
    return min(found, key=lambda x: (abs((x - near).days), x), default=None)


def resolve(form: str, groups: tuple, near: dt.date | None) -> tuple[dt.date | None, str, bool, bool]:
    """(day, precision, year inferred, real): what a match of a form means. Days come first unless they can't."""
    if form == "year_only":
        day = _day(int(groups[0]), 1, 1)
        return day, "year", False, day is not None
    if form in ("dmy_numeric", "iso"):
        a, b, c = map(int, groups)
        y, m, d = (a, b, c) if form == "iso" else (c, b, a)
        if form == "dmy_numeric" and m > 12 and d <= 12:
            m, d = d, m
        if form == "dmy_numeric" and (m > 12 or d > 31):
            return None, "day", False, True  # kept as an unresolved mention
        day = _day(y, m, d)
        return day, "day", False, day is not None
    d, name = (groups[0], groups[1]) if form == "dmy_written" else (groups[1], groups[0])
    month = _MONTH_OF[name[:3].lower()]
    if groups[2]:
        day = _day(int(groups[2]), month, int(d))
        return day, "day", False, day is not None
    return nearest_year(month, int(d), near), "day", near is not None, True


def mentions(text: str, near: dt.date | None = None) -> list[dict]:
    """Date mentions of a text, one per region: resolved before unresolved, longer before shorter, earlier first."""
    found = []
    for form, pattern in _COMPILED:
        for m in pattern.finditer(text):
            day, precision, inferred, real = resolve(form, m.groups(), near)
            if real:
                found.append({"start": m.start(), "end": m.end(), "surface": m[0], "source": form, "iso_date": day, "precision": precision, "year_inferred": inferred})
    kept: list[dict] = []
    for x in sorted(found, key=lambda x: (x["start"], x["start"] - x["end"])):
        other = next((k for k, y in enumerate(kept) if x["start"] < y["end"] and y["start"] < x["end"]), None)
        if other is None:
            kept.append(x)
        else:
            rank = lambda y: (y["iso_date"] is not None, y["end"] - y["start"])
            if rank(x) > rank(kept[other]):
                kept[other] = x
    return sorted(kept, key=lambda x: x["start"])


MENTION = "struct<start:int,end:int,surface:string,source:string,iso_date:date,precision:string,year_inferred:boolean>"


def date_mentions(docs: DataFrame, key: str = "file_id", text: str = "text", near: str | None = None) -> DataFrame:
    """(key, start, end, surface, source, iso_date, precision, year_inferred) of every text; null texts have none."""

    @F.pandas_udf(f"array<{MENTION}>")
    def find(texts: pd.Series, anchors: pd.Series) -> pd.Series:
        return pd.Series([mentions(t or "", a if isinstance(a, dt.date) else None) for t, a in zip(texts, anchors)])

    anchor = F.col(near).cast("date") if near else F.lit(None).cast("date")
    return docs.select(key, F.explode(find(F.col(text), anchor)).alias("m")).select(key, "m.*")


def resolve_day(d: Column, m: Column, y: Column) -> Column:
    """Native day-first resolver of numeric dates: swapped if the month can't be one; impossible days are null."""
    swap = (m > 12) & (d <= 12)
    day, month = F.when(swap, m).otherwise(d), F.when(swap, d).otherwise(m)
    iso = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(y.between(1900, 2099) & month.between(1, 12) & day.between(1, 31), F.try_to_date(iso, "yyyy-MM-dd"))


def parse_iso(value: Column) -> Column:
    """The local time that an ISO text says, whatever its offset; null for null, empty and unreadable ones."""
    said = F.regexp_replace(F.trim(value), r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$", "")
    whole = said.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,6})?)?)?$")
    return F.when(whole, said.try_cast("timestamp_ntz"))


# -- signals --------------------------------------------------------------------------------------------------------


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def structured_signal(tabular: Column) -> Column:
    return F.when(tabular, 1.0).otherwise(NEUTRAL)


def metadata_signal(day: Column, modified: Column, days: int = CONSISTENCY_DAYS) -> Column:
    """Decays with the distance from the file's time, twice as fast into the past; 0.5 if either is unknown."""
    delta = F.datediff(day, modified)
    return F.when(delta.isNull(), NEUTRAL).when(delta >= 0, F.exp(-delta / F.lit(float(max(1, days))))).otherwise(F.exp(delta / F.lit(float(max(1.0, days / 2)))))


def crossfile_signal(files: Column, saturation: int = SATURATION) -> Column:
    n = F.coalesce(files, F.lit(1))
    return F.when(n <= 1, NEUTRAL).otherwise(NEUTRAL + 0.5 * F.least(F.lit(1.0), (n - 1) / F.lit(float(max(1, saturation - 1)))))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def _nearest(before: Column, after: Column, back: Column, ahead: Column, phrase: str) -> Column:
    """Tokens between a mention and the nearest place of a phrase, or null."""
    if " " in phrase:
        tail = F.substring_index(before, phrase, -1)
        head = F.substring_index(after, phrase, 1)
        left = F.when(F.contains(before, F.lit(phrase)), F.size(_tokens(tail)))
        right = F.when(F.contains(after, F.lit(phrase)), F.size(_tokens(head)))
    else:
        left = F.nullif(F.array_position(back, phrase), F.lit(0)).cast("int") - 1
        right = F.nullif(F.array_position(ahead, phrase), F.lit(0)).cast("int") - 1
    return F.least(left, right)


def _strongest(s: Column, vocabulary: dict[str, float], window: int) -> Column:
    """The strongest evidence of a vocabulary; header words count by substring, at a discount."""
    found = []
    for word, strength in vocabulary.items():
        far = _nearest(s["b"], s["a"], s["back"], s["ahead"], word)
        found.append(F.coalesce(strength * F.greatest(F.lit(0.0), 1.0 - far / F.lit(float(window))), F.lit(0.0)))
        found.append(F.when(F.contains(s["h"], F.lit(word)), strength * HEADER_DISCOUNT).otherwise(0.0))
    return F.greatest(*found)


def keyword_signal(before: Column, after: Column, header: Column, window: int = WINDOW_TOKENS) -> Column:
    """0.5, raised by the words of a commitment and lowered by those of a record or reference around a mention."""
    b, a, h = F.lower(before), F.lower(after), F.lower(F.coalesce(header, F.lit("")))
    around = F.struct(b.alias("b"), a.alias("a"), h.alias("h"), F.reverse(_tokens(b)).alias("back"), _tokens(a).alias("ahead"))
    return let(around, lambda s: clamp(NEUTRAL + 0.5 * _strongest(s, COMMITMENT, window) - 0.5 * F.greatest(_strongest(s, RECORD, window), _strongest(s, REFERENCE, window))))


def combine(keyword: Column, structured: Column, metadata: Column, crossfile: Column, precision: Column, weights: dict | None = None) -> Column:
    w = weights or WEIGHTS
    total = w["keyword"] * keyword + w["structured"] * structured + w["metadata"] * metadata + w["crossfile"] * crossfile
    return clamp(total * F.when(precision == "year", YEAR_PENALTY).otherwise(1.0))


def governing_header(mentions: DataFrame, blocks: DataFrame, key: str = "file_id", place: str = "start") -> DataFrame:
    """mentions with header: the first two lines of the table around them, else the last three headings before them.

    blocks: key, block_index, text, is_tabular, is_heading, char_start, char_end.
    """
    keyed = mentions.withColumn("mention_row", F.monotonically_increasing_id())
    at = keyed.select("mention_row", key, F.col(place).alias("place"))
    near = at.join(blocks.select(key, "block_index", "text", "is_tabular", "is_heading", "char_start", "char_end"), key).where("char_start <= place")
    table = near.where("is_tabular AND place < char_end").groupBy("mention_row").agg(F.min_by(F.array_join(F.slice(F.split("text", "\n"), 1, 2), " "), "block_index").alias("table"))
    w = Window.partitionBy("mention_row").orderBy(F.col("block_index").desc())
    heads = near.where("is_heading AND text <> ''").withColumn("nth", F.row_number().over(w)).where("nth <= 3")
    line = F.element_at(F.split("text", "\n"), 1)
    heads = heads.groupBy("mention_row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_index", line.alias("line")))), lambda x: x["line"]), " ").alias("heads"))
    out = keyed.join(table, "mention_row", "left").join(heads, "mention_row", "left")
    return out.withColumn("header", F.coalesce("table", "heads", F.lit(""))).drop("table", "heads", "mention_row")


def classify(mentions: DataFrame, docs: DataFrame, blocks: DataFrame | None = None, weights: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Verdicts on date mentions (file_id, start, end, iso_date, precision, in_tabular) of documents (file_id, text, mtime).

    Adds the four signals, score, is_meaningful and the reason; mentions without a day are left out. Recurrence is
    counted over the mentions given.
    """
    dated = mentions.where("iso_date IS NOT NULL")
    seen = dated.groupBy("iso_date").agg(F.countDistinct("file_id").alias("files"))
    rows = dated.join(docs.select("file_id", "text", "mtime"), "file_id").join(seen, "iso_date")
    rows = governing_header(rows.withColumnRenamed("text", "body"), blocks).withColumnRenamed("body", "text") if blocks is not None else rows.withColumn("header", F.lit(""))
    reach = WINDOW_TOKENS * 8
    before = F.substring(F.col("text"), F.greatest(F.lit(1), F.col("start") - reach + 1), F.least(F.col("start"), F.lit(reach)))
    after = F.substring(F.col("text"), F.col("end") + 1, F.lit(reach))
    rows = rows.select("*", keyword_signal(before, after, F.col("header")).alias("sig_keyword"), structured_signal(F.col("in_tabular")).alias("sig_structured"), metadata_signal(F.col("iso_date"), F.col("mtime").cast("date")).alias("sig_metadata"), crossfile_signal(F.col("files")).alias("sig_crossfile"))
    score = combine(F.col("sig_keyword"), F.col("sig_structured"), F.col("sig_metadata"), F.col("sig_crossfile"), F.col("precision"), weights)
    rows = rows.withColumn("score", score).withColumn("is_meaningful", F.col("score") >= threshold)
    reason = F.concat_ws("; ", F.when(F.col("sig_keyword") > NEUTRAL, "words of a commitment nearby").when(F.col("sig_keyword") < NEUTRAL, "words of a record or reference nearby"), F.when(F.col("in_tabular"), "inside a table"), F.when(F.col("files") > 1, F.concat(F.lit("in "), F.col("files").cast("string"), F.lit(" files"))), F.when(F.col("precision") == "year", "only a year"))
    return rows.withColumn("reason", reason).drop("text", "mtime")


def best_per_day(verdicts: DataFrame) -> DataFrame:
    """The highest-scoring verdict of each (file, day); the earlier mention wins ties."""
    w = Window.partitionBy("file_id", "iso_date").orderBy(F.col("score").desc(), "start")
    return verdicts.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
