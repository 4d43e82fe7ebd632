"""The corpus pipeline: quality filter, line dedup, near-duplicate join, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._cluster import Tables, drop_ids, keep_ids, sweeping
from lodestar.llm.decontam import decontaminate
from lodestar.llm.line_dedup import line_dedup
from lodestar.llm.ngram_join import ngram_join
from lodestar.llm.packing import pack
from lodestar.llm.quality import quality_filter
from lodestar.llm.queries import table, vocabulary


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the row key of the operators under a name that no column has: rows are dropped by it, as ids may repeat or be null."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labelled ones, does not reject."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those of which nothing is left go. n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = line_dedup(docs.select("doc_id", "text", F.struct(*others).alias("others")))  # no other column can clash there
    cut = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    text = F.col("kept_text")
    return cut.select(*[text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c if c == "doc_id" else f"others.`{c}`").alias(c) for c in docs.columns])


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group that links of 5-word shingles at 0.8 reach, and one of rows with equal id and text. Rows without words stay."""
    tables = Tables(spark, "pipeline")
    groups = ngram_join(docs, size=5, percent=80, keys=True).where("n_shingles > 0")
    counts = groups.groupBy("row_key").agg(F.min("keep_key").alias("keep_key"), F.count(F.lit(1)).alias("n"))
    counts = tables("groups", counts.where("row_key <> keep_key OR n > 1"))
    keyed, name = _keyed(docs)
    left = drop_ids(keyed, tables("copies", counts.where("row_key <> keep_key").select(F.col("row_key").alias(name))), name)
    again = tables("again", counts.where("row_key = keep_key").select(F.col("row_key").alias(name)))
    once = keep_ids(left, again, name).dropDuplicates([name])
    return drop_ids(left, again, name).unionByName(once).drop(name)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of the benchmark."""
    keyed, name = _keyed(docs)
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark"), keys=True).where("contaminated").select(F.col("row_key").alias(name)).distinct()
    return drop_ids(keyed, Tables(spark, "pipeline")("contaminated", hit), name).drop(name)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of at most 1024 tokens."""
    return pack(docs, vocabulary(), tokens=1024, end=2, documents=1024, attention=1024**2)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_join", keep_first_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: SQL can state neither the classifier nor the alignment nor the packing; the tests hold run() against stages written out plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages. Each stage's result is written before the next reads it; then the tables it was made from go."""
    docs, tables, before = table(spark, sf_dir, "documents"), Tables(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with sweeping(spark) as written:
            docs = tables(name, stage(spark, docs, sf_dir))
            written.remove(tables.paths[name])
        if before:
            tables.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
