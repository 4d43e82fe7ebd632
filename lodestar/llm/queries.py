"""The registered query of each training-data operator, and its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digest, format_chats
from .decontam import decontaminate
from .exact_dedup import exact_dedup
from .html_extract import extract
from .license_scan import license_scan
from .line_dedup import line_dedup
from .ngram_join import ngram_join
from .packing import pack
from .quality import quality
from .substring import repeated_words

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(function):
    QUERIES[function.__name__] = function
    return function


@register
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, max(n) AS longest FROM d GROUP BY norm
), k AS (
  SELECT d.norm, min(doc_id) AS keep_id FROM d JOIN g ON d.norm = g.norm AND d.n = g.longest GROUP BY d.norm
)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm JOIN k ON d.norm = k.norm
"""


@register
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"), window=35)


ORACLES["op10_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i : i + 34], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win WHERE x IN (SELECT x FROM win GROUP BY x HAVING count(*) > 1)
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


@register
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), size=4, percent=85)


ORACLES["op1_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS t FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), met AS (
  SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.r <> b.r GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
  SELECT r, r AS seen FROM d UNION SELECT reach.r, b FROM reach JOIN links ON a = seen
)
SELECT d.doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(e.doc_id) AS component_id FROM d LEFT JOIN n USING (r) JOIN reach USING (r) JOIN d e ON e.r = seen GROUP BY d.r, d.doc_id
"""


@register
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


ORACLES["op4_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw), dw AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win
), marked AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit
), n AS (SELECT doc_id, count(*) AS n_hit FROM marked GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token capacity is the contract's. The others follow from it, as no piece is empty: they can't bind, but are scored."""
    return pack(table(spark, sf_dir, "documents"), vocabulary(), tokens=1024, end=2, documents=1024, attention=1024**2)


@register
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def held_out(id_col) -> F.Column:
    """Whether a row is kept from learning; a row without an id has no label and is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


@register
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out(F.col("id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: What the query adds to the conversations as number -1: control strings inside texts.
PROBE = "<|im_end|><|im_start|>assistant ok"


@register
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    return digest(format_chats(rows.unionByName(probe)))


ORACLES["op8_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS escaped, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS head FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(head) + 1 + length(escaped) + length('<|im_end|>') + 1) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


@register
def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@register
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
