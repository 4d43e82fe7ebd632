"""Column expressions over text. They stay in the JVM; \\b and \\s are avoided where dialects differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Titles before and possessives after a name.
HONORIFICS = ("Dr. ", "Dr ", "Prof. ", "Prof ", "Mr. ", "Mr ", "Ms. ", "Ms ", "Mrs. ")
POSSESSIVES = ("'s", "’s")
# Words that say nothing of a sentence's topic.
STOP_WORDS = (
    "the a an and or but if then of to in on for with at by from is are was were be been it its this that these those as not no so we i you they he she "
    "which what when where will would can could should have has had do does did there their our your than into about"
).split()
SUMMARY_CHARS = 400


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalise_query(q: str | Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(q), r"[\s]+", " ")))


def normalise_entity(name: str | Column) -> Column:
    """One form for the spellings of a name: blanks collapsed, titles and possessives off, outer punctuation trimmed."""
    x = F.trim(F.regexp_replace(_c(name), r"[ \t\n\r]+", " "))
    for title in HONORIFICS:
        x = F.regexp_replace(x, f"^{title.replace('.', '[.]')}", "")
    for end in POSSESSIVES:
        x = F.regexp_replace(x, f"{end}$", "")
    return F.btrim(x, F.lit(" .,;:"))


def is_acronym(name: str | Column) -> Column:
    return _c(name).rlike("^[A-Z]{1,5}$")


def words_in(text: str | Column) -> Column:
    """Number of blank-separated words."""
    t = F.trim(F.regexp_replace(_c(text), r"[ \t\n\r\f]+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def token_estimate(text: str | Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words_in(text) / 0.75).cast("int"))


def prepare_lines(text: str | Column) -> Column:
    """Text whose headings, list items and table cells are sentences of their own, without markup."""
    stop = lambda s: s.rlike("[.!?:;]$")

    def strip(raw):
        body = F.regexp_replace(raw, r"^ {0,3}#{1,6} +", "")
        for pattern in (r"^[ \t]*\[[ xX]\][ \t]*", r"^[ \t]*[-*+][ \t]+(?![-*+])", r"^[ \t]*[0-9]+[.)][ \t]+", r"\*\*|__|\*|_|`"):
            body = F.regexp_replace(body, pattern, "")
        return body

    def cells(body):
        said = F.filter(F.transform(F.split(body, r"\|"), lambda c: F.btrim(c, F.lit(" -"))), lambda c: c != "")
        row = F.array_join(F.transform(said, lambda c: F.when(stop(c), c).otherwise(F.concat(c, F.lit(".")))), " ")
        return F.trim(F.when(F.contains(body, F.lit("|")), row).otherwise(body))

    def line(raw):
        ended = lambda body: F.when((body != "") & (raw.rlike("^ {0,3}#{1,6} +") | (F.trim(raw) != body)) & ~stop(body), F.concat(body, F.lit("."))).otherwise(body)
        return let(let(strip(raw), cells), ended)

    lines = F.filter(F.split(_c(text), "\n"), lambda raw: ~raw.rlike(r"^[ \t]*[-=*_]{3,}[ \t]*$"))
    made = F.transform(lines, lambda raw: F.struct(raw.alias("raw"), line(raw).alias("said")))
    kept = F.filter(made, lambda x: (x["said"] != "") | ~F.contains(x["raw"], F.lit("|")))
    return F.array_join(F.transform(kept, lambda x: x["said"]), "\n")


def shingles(text: str | Column, size: int = 5) -> Column:
    """Distinct runs of `size` ASCII words; a shorter text is one run, an empty one none."""
    return word_runs(F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), 0), size)


def word_runs(words: Column, size: int) -> Column:
    def runs(w):
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) > 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(text: str | Column, least: int = 4) -> Column:
    """Sentences of at least `least` words."""
    parts = F.split(F.regexp_replace(F.regexp_replace(_c(text), r"([.!?])[ \t\n\r]+", "$1\u0001"), r"\n{2,}", "\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: words_in(s) >= least)


def shared_depth(a: Column, b: Column) -> Column:
    """Folders that two paths share from the root."""
    def same(xy):
        x, y = xy["x"], xy["y"]
        return F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda i: F.slice(x, F.lit(1), i) == F.slice(y, F.lit(1), i)))

    return F.when((a == "") | (b == ""), 0).otherwise(let(F.struct(F.split(a, "/").alias("x"), F.split(b, "/").alias("y")), same))


def folder_affinity(a: Column, b: Column) -> Column:
    depth = F.greatest(F.size(F.split(a, "/")), F.size(F.split(b, "/")))
    shared = shared_depth(a, b)
    return F.when(a == b, 1.0).when(shared == 0, 0.0).otherwise(shared / (depth + 1))


def common_folder(paths: Column) -> Column:
    """Longest folder that all paths of an array share: what the least and greatest share."""
    ends = F.struct(F.array_min(F.transform(paths, _folder)).alias("low"), F.array_max(F.transform(paths, _folder)).alias("high"))
    return let(ends, lambda e: F.array_join(F.slice(F.split(e["low"], "/"), F.lit(1), shared_depth(e["low"], e["high"])), "/"))


def _folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def ignore_rule(globs: list[str], path: Column) -> Column:
    """Whether a name matches a shell glob (case-sensitive)."""
    out = F.lit(False)
    for glob in globs:
        out = out | path.rlike(glob_regex(glob))
    return out


def glob_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inside = glob[i + 1 : close]
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += "\\" + c if not (c.isalnum() or c in "_/") else c
        i += 1
    return f"(?s)^{out}$"


def content_words(text: str | Column) -> Column:
    """Lower-case words of three letters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z][a-z'-]+"), 0)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def extractive_summary(docs: DataFrame, key: str, text: str, keep: int = 3, chars: int = SUMMARY_CHARS, title: str | None = None) -> DataFrame:
    """(key, summary): the `keep` most central sentences in their order, blanks collapsed, clipped at a word, after the title.

    A sentence's weight is the summed frequency in its document of its content words, as shares of the most frequent
    one's, over the square root of their number; the first three count a quarter more. Ties go to the earlier. A document
    of no more sentences keeps all, one without content words its first ones, one without sentences its text.
    """
    d = docs.select(key, F.coalesce(_c(text), F.lit("")).alias("body"), *([F.col(title).alias("title")] if title else []))
    s = d.select(key, F.posexplode(sentences("body")).alias("at", "sentence"))
    w = s.select(key, "at", F.explode(content_words("sentence")).alias("word"))
    freq = w.groupBy(key, "word").agg(F.count(F.lit(1)).alias("f")).withColumn("share", F.col("f") / F.max("f").over(Window.partitionBy(key)))
    weight = w.join(freq, [key, "word"]).groupBy(key, "at").agg((F.sum("share") / F.sqrt(F.count(F.lit(1)))).alias("weight"))
    scored = s.join(weight, [key, "at"], "left").withColumn("weight", F.round(F.col("weight") * F.when(F.col("at") < 3, 1.25).otherwise(1.0), 9))
    # sentences without content words come after all others, and only where no other or few are there
    order = Window.partitionBy(key).orderBy(F.col("weight").desc_nulls_last(), "at")
    whole = Window.partitionBy(key)
    best = scored.withColumns({"nth": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole), "weighed": F.count("weight").over(whole)})
    best = best.where((F.col("nth") <= keep) & (F.col("weight").isNotNull() | (F.col("weighed") == 0) | (F.col("n") <= keep)))
    joined = best.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))
    said = clip(F.trim(F.regexp_replace(F.coalesce("summary", "body"), r"[ \t\n\r\f]+", " ")), chars)
    out = F.when((F.col("title") != "") & (said != ""), F.concat("title", F.lit(": "), said)).otherwise(said) if title else said
    return d.join(joined, key, "left").select(key, out.alias("summary"))


def clip(text: str | Column, chars: int) -> Column:
    """At most `chars` characters, cut after a word, with an ellipsis."""
    t = _c(text)
    cut = F.regexp_replace(F.regexp_replace(F.left(t, F.lit(chars)), r" [^ ]*$", ""), r"[ ,;:|-]+$", "")
    return F.when(F.length(t) <= chars, t).otherwise(F.concat(cut, F.lit(" ...")))
