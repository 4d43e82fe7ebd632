"""Queries of text, blocks and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import decompose as Q
from ..functions import text as T
from ..operators import blocks as B
from ..operators import entities as E
from .tables import BLOCKS, MENTIONS, blocks, mentions, query, table

_NORM = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9]+')"
_COUNT = r"CASE WHEN trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ')) END"


@query(f"SELECT item_id, {_NORM} AS q FROM benchmark")
def normalised_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalise_query("text").alias("q"))


@query(f"SELECT doc_id, CAST({_COUNT} AS INTEGER) AS words, CAST(greatest(1, floor(({_COUNT}) / 0.75)) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.words_in("text").alias("words"), T.token_estimate("text").alias("tokens"))


@query(f"""SELECT doc_id, CAST(len(CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS INTEGER) AS n
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""")
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.shingles("text")).alias("n"))


@query(r"""SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda s: trim(s)),
  lambda s: len(string_split(trim(regexp_replace(s, '[ \t\n\r\f]+', ' ', 'g')), ' ')) >= 4 AND s <> '')) AS INTEGER) AS sentences FROM documents""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences("text")).alias("sentences"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda s: trim(s)),
    lambda s: s <> '' AND len(string_split(trim(regexp_replace(s, '[ \t\n\r\f]+', ' ', 'g')), ' ')) >= 4) AS ss FROM d),
  s AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM p), w AS (SELECT doc_id, pos, unnest(list_filter(regexp_extract_all(lower(sentence), '[a-z][a-z''-]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP}))) AS word FROM s),
  f AS (SELECT doc_id, word, count(*) AS f FROM w GROUP BY 1, 2), m AS (SELECT doc_id, max(f) AS peak FROM f GROUP BY 1),
  k AS (SELECT doc_id, pos, sum(f / peak) / sqrt(count(*)) AS weight FROM w JOIN f USING (doc_id, word) JOIN m USING (doc_id) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC NULLS LAST, pos) AS nth, count(*) OVER (PARTITION BY doc_id) AS n, count(weight) OVER (PARTITION BY doc_id) AS weighed FROM (SELECT doc_id, pos, sentence, round(weight * CASE WHEN pos < 3 THEN 1.25 ELSE 1.0 END, 9) AS weight FROM s LEFT JOIN k USING (doc_id, pos))),
  j AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS said FROM r WHERE nth <= 3 AND (weight IS NOT NULL OR weighed = 0 OR n <= 3) GROUP BY 1),
  c AS (SELECT doc_id, trim(regexp_replace(coalesce(said, text), '[ \t\n\r\f]+', ' ', 'g')) AS said FROM d LEFT JOIN j USING (doc_id))
  SELECT doc_id, CASE WHEN length(said) <= 400 THEN said ELSE regexp_replace(regexp_replace(substr(said, 1, 400), ' [^ ]*$', ''), '[ ,;:|-]+$', '') || ' ...' END AS summary FROM c""")
def extractive_summary(spark, sf_dir):
    return T.extractive_summary(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]{3,}')) AS term FROM documents),
  c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE term NOT IN ('thing','things','stuff','note','notes','item','items','page','file','files','day','days','time','times','year','years','week','month','lot','bit','part','way','kind','sort','number','e.g','i.e') GROUP BY 1, 2)
  SELECT doc_id, term, n AS count, CAST(nth - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS nth FROM c) WHERE nth <= 25""")
def keyword_top(spark, sf_dir):
    return E.keywords(table(spark, sf_dir, "documents"), key="doc_id")


@query("SELECT p_partkey, trim(regexp_replace('Dr. ' || p_name || '''s', '[ \\t\\n\\r]+', ' ', 'g')) AS raw, rtrim(ltrim(trim(regexp_replace(p_name, '[ \\t\\n\\r]+', ' ', 'g')), ' .,;:'), ' .,;:') AS normalised FROM part")
def entity_normalise(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Dr. "), "p_name", F.lit("'s")).alias("raw"))
    return p.select("p_partkey", F.trim(F.regexp_replace("raw", r"[ \t\n\r]+", " ")).alias("raw"), T.normalise_entity("raw").alias("normalised"))


@query(f"WITH {BLOCKS} SELECT file_id, block_index, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY file_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM blocks")
def block_offsets(spark, sf_dir):
    return B.offsets(blocks(spark, sf_dir)).select("file_id", "block_index", F.col("char_start").cast("long").alias("char_start"))


@query(f"WITH {BLOCKS} SELECT file_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY block_index)) AS digest, CAST(sum(length(text)) AS BIGINT) AS char_count, count(*) AS block_count FROM blocks GROUP BY 1")
def document_assembly(spark, sf_dir):
    return B.assemble(blocks(spark, sf_dir)).select("file_id", F.md5("text").alias("digest"), "char_count", "block_count")


@query(f"""WITH {BLOCKS}, u AS (SELECT *, sum(length(text)) OVER (PARTITION BY file_id ORDER BY block_index) AS upto FROM blocks), f AS (SELECT *, min(CASE WHEN upto > 600 THEN block_index END) OVER (PARTITION BY file_id) AS first FROM u)
  SELECT file_id, block_index, CAST(CASE WHEN block_index = first THEN 600 - (upto - length(text)) ELSE length(text) END AS BIGINT) AS chars FROM f WHERE first IS NULL OR block_index < first OR (block_index = first AND 600 - (upto - length(text)) > 200)""")
def truncate_blocks(spark, sf_dir):
    return B.truncate(blocks(spark, sf_dir), limit=600).select("file_id", "block_index", F.length("text").cast("long").alias("chars"))


_TOKENS = "CAST(greatest(1, floor({} / 0.75)) AS BIGINT)"
_SPLIT = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(rf"""WITH RECURSIVE {BLOCKS}, b AS (SELECT *, len({_SPLIT}) AS words FROM blocks WHERE regexp_matches(text, '\S')),
  unit AS (SELECT file_id, block_index, 0 AS line, TRUE AS opens, TRUE AS ends, FALSE AS long, kind, is_tabular, text, words FROM b WHERE {_TOKENS.format("words")} <= 256 UNION ALL
    SELECT file_id, block_index, line, line = 1, line = n, TRUE, kind, is_tabular, text, len({_SPLIT}) FROM (SELECT file_id, block_index, kind, is_tabular, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, len(string_split(text, chr(10))) AS n FROM b WHERE {_TOKENS.format("words")} > 256)),
  u AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY block_index, line) AS pos FROM unit),
  walk AS (
    SELECT file_id, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(text VARCHAR, kind VARCHAR, tab BOOLEAN, block BIGINT, words BIGINT)[]) AS held, CAST([] AS STRUCT(text VARCHAR, kind VARCHAR, tab BOOLEAN, block BIGINT, words BIGINT)[]) AS lines, FALSE AS fresh,
      CAST([] AS STRUCT(text VARCHAR, kind VARCHAR, tab BOOLEAN, block BIGINT, words BIGINT)[][]) AS made, CAST([] AS STRUCT(text VARCHAR, kind VARCHAR, tab BOOLEAN, block BIGINT, words BIGINT)[][]) AS parts FROM (SELECT DISTINCT file_id FROM u)
    UNION ALL
    SELECT file_id, pos, CASE WHEN long THEN [] WHEN full_ THEN [me] ELSE list_append(held, me) END, CASE WHEN NOT long OR ends THEN [] ELSE kept END, long AND NOT ends,
      CASE WHEN len(held) > 0 AND ((long AND opens) OR (NOT long AND full_)) THEN list_append(made, held) ELSE made END || CASE WHEN cut THEN [lines] ELSE [] END || CASE WHEN long AND ends THEN [kept] ELSE [] END, parts
    FROM (SELECT *, list_append(CASE WHEN cut THEN list_filter(lines, lambda x, i: {_TOKENS.format("list_sum(list_transform(lines[i:], lambda y: y.words))")} <= 48) ELSE lines END, me) AS kept
      FROM (SELECT w.file_id, u.pos, held, lines, made, parts, long, opens, ends, struct_pack(text := u.text, kind := u.kind, tab := u.is_tabular, block := CAST(u.block_index AS BIGINT), words := CAST(u.words AS BIGINT)) AS me,
        long AND fresh AND {_TOKENS.format("(list_sum(list_transform(lines, lambda y: y.words)) + u.words)")} > 256 AS cut,
        len(held) > 0 AND coalesce(list_sum(list_transform(held, lambda y: {_TOKENS.format("y.words")})), 0) + {_TOKENS.format("u.words")} > 256 AS full_
        FROM walk w JOIN u ON u.file_id = w.file_id AND u.pos = w.pos + 1))
  ),
  done AS (SELECT file_id, CASE WHEN len(held) > 0 THEN list_append(made, held) ELSE made END AS made FROM walk QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY pos DESC) = 1),
  chunk AS (SELECT file_id, unnest(made) AS c, unnest(range(len(made))) AS i FROM done)
  SELECT file_id, CAST(i AS INTEGER) AS chunk_index, md5(CASE WHEN len(c) > 1 AND c[1].block = c[2].block THEN array_to_string(list_transform(c, lambda x: x.text), chr(10)) ELSE array_to_string(list_transform(c, lambda x: x.text), chr(10) || chr(10)) END) AS digest, list_bool_or(list_transform(c, lambda x: x.tab)) AS is_tabular,
    array_to_string(list_reverse(list_reduce(list_transform(c, lambda x: [x.kind]), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_prepend(x[1], a) END)), ',') AS block_kinds, c[1].block AS first_block FROM chunk""")
def chunk_pack(spark, sf_dir):
    return B.chunks(blocks(spark, sf_dir)).select("file_id", "chunk_index", F.md5("text").alias("digest"), "is_tabular", "block_kinds", "first_block")


@query(rf"""WITH RECURSIVE {BLOCKS}, u AS (SELECT file_id, {_TOKENS.format(f"({_COUNT})")} AS n, row_number() OVER (PARTITION BY file_id ORDER BY block_index, {_TOKENS.format(f"({_COUNT})")}) AS at FROM blocks),
  walk AS (SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS at, CAST(0 AS BIGINT) AS used, 0 AS chunks FROM u UNION ALL
    SELECT w.file_id, u.at, CASE WHEN used > 0 AND used + n > 256 THEN n ELSE used + n END, CASE WHEN used > 0 AND used + n > 256 THEN chunks + 1 ELSE greatest(chunks, 1) END FROM walk w JOIN u ON u.file_id = w.file_id AND u.at = w.at + 1)
  SELECT file_id, max(chunks) AS chunks FROM walk GROUP BY 1""")
def chunk_fold(spark, sf_dir):
    return B.chunk_starts(blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY file_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM blocks),
  m AS (SELECT DISTINCT file_id, p * 150 AS start FROM blocks, (SELECT unnest(range(0, 8)) AS p))
  SELECT m.file_id, CAST(m.start AS INTEGER) AS start, coalesce(bool_or(o.is_tabular AND o.s <= m.start AND m.start < o.s + length(o.text)), FALSE) AS in_tabular FROM m JOIN o USING (file_id) GROUP BY 1, 2""")
def offset_in_table(spark, sf_dir):
    b = B.offsets(blocks(spark, sf_dir))
    m = b.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(0), F.lit(1050), F.lit(150))).alias("start"))
    return B.in_table(m, b)


@query(f"""WITH {BLOCKS}, o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY file_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM blocks),
  m AS (SELECT DISTINCT file_id, p * 150 AS start FROM blocks, (SELECT unnest(range(0, 8)) AS p)),
  t AS (SELECT m.file_id, m.start, arg_min(array_to_string(string_split(o.text, chr(10))[1:2], ' '), block_index) AS h FROM m JOIN o ON m.file_id = o.file_id AND o.is_tabular AND o.s <= m.start AND m.start < o.s + length(o.text) GROUP BY 1, 2),
  c AS (SELECT m.file_id, m.start, block_index, string_split(o.text, chr(10))[1] AS line, row_number() OVER (PARTITION BY m.file_id, m.start ORDER BY block_index DESC) AS nth FROM m JOIN o ON m.file_id = o.file_id AND o.is_heading AND o.text <> '' AND o.s <= m.start),
  g AS (SELECT file_id, start, string_agg(line, ' ' ORDER BY block_index) AS h FROM c WHERE nth <= 3 GROUP BY 1, 2)
  SELECT m.file_id, CAST(m.start AS INTEGER) AS start, coalesce(t.h, g.h, '') AS header FROM m LEFT JOIN t USING (file_id, start) LEFT JOIN g USING (file_id, start)""")
def governing_header(spark, sf_dir):
    b = B.offsets(blocks(spark, sf_dir))
    m = b.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(0), F.lit(1050), F.lit(150))).alias("start"))
    return D.governing_header(m, b)


def _dated(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    said = F.concat(F.lit("Due "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" then "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("; exam on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(", published in "), F.date_format("o_orderdate", "yyyy"), F.lit(". Never 30-02-2024."))
    return o.select(F.col("o_orderkey").alias("file_id"), said.alias("text"), F.col("o_orderdate").cast("date").alias("mtime"))


_DATES = """dated AS (SELECT o_orderkey AS file_id, CAST(o_orderdate AS DATE) AS day FROM orders)"""


@query(f"""WITH {_DATES} SELECT file_id, day AS iso_date, 'day' AS precision, source FROM dated, (SELECT unnest(['dmy_numeric', 'iso', 'dmy_written']) AS source)
  UNION ALL SELECT file_id, make_date(year(day), 1, 1), 'year', 'year_only' FROM dated UNION ALL SELECT file_id, DATE '2024-01-01', 'year', 'year_only' FROM dated""")
def date_extract(spark, sf_dir):
    return D.date_mentions(_dated(spark, sf_dir), near="mtime").select("file_id", "iso_date", "precision", "source")


@query("""SELECT file_id, CASE WHEN d BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12 THEN try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) END AS day FROM (
  SELECT l_orderkey * 10 + l_linenumber AS file_id, CASE WHEN b > 12 AND a <= 12 THEN b ELSE a END AS d, CASE WHEN b > 12 AND a <= 12 THEN a ELSE b END AS m, 2000 + l_linenumber AS y
  FROM (SELECT *, CAST(l_partkey % 33 AS INTEGER) AS a, CAST(l_suppkey % 15 AS INTEGER) AS b FROM lineitem))""")
def date_resolve(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"), D.resolve_day((F.col("l_partkey") % 33).cast("int"), (F.col("l_suppkey") % 15).cast("int"), (F.col("l_linenumber") + 2000)).alias("day"))


@query(f"WITH {MENTIONS} SELECT file_id, start, round(CASE WHEN iso_date >= mtime THEN exp(-(iso_date - mtime) / 60.0) ELSE exp((iso_date - mtime) / 30.0) END, 5) AS signal FROM mentions")
def metadata_signal(spark, sf_dir):
    return mentions(spark, sf_dir).select("file_id", "start", F.round(D.metadata_signal(F.col("iso_date"), F.col("mtime")), 5).alias("signal"))


_THIN = "thin AS (SELECT CAST(l_shipdate AS DATE) AS iso_date, l_suppkey AS place, count(DISTINCT l_orderkey) AS files FROM lineitem GROUP BY 1, 2)"


def _recurrence(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_shipdate").cast("date").alias("iso_date"), F.col("l_suppkey").alias("place")).agg(F.countDistinct("l_orderkey").alias("files"))


@query(f"WITH {_THIN} SELECT iso_date, place, files, round(CASE WHEN files <= 1 THEN 0.5 ELSE 0.5 + 0.5 * least(1.0, (files - 1) / 3.0) END, 5) AS signal FROM thin")
def crossfile_signal(spark, sf_dir):
    return _recurrence(spark, sf_dir).select("iso_date", "place", "files", F.round(D.crossfile_signal(F.col("files")), 5).alias("signal"))


@query(f"""WITH {MENTIONS}, {_THIN}, s AS (SELECT m.*, CASE WHEN in_tabular THEN 1.0 ELSE 0.5 END AS st, CASE WHEN m.iso_date >= mtime THEN exp(-(m.iso_date - mtime) / 60.0) ELSE exp((m.iso_date - mtime) / 30.0) END AS md,
  CASE WHEN coalesce(files, 1) <= 1 THEN 0.5 ELSE 0.5 + 0.5 * least(1.0, (files - 1) / 3.0) END AS cf FROM mentions m LEFT JOIN thin ON m.iso_date = thin.iso_date AND m.place = thin.place),
  v AS (SELECT *, least(1.0, (0.40 * 0.5 + 0.25 * st + 0.20 * md + 0.15 * cf) * CASE WHEN precision = 'year' THEN 0.35 ELSE 1 END) AS score FROM s)
  SELECT file_id, iso_date, start, round(score, 5) AS score, round(score, 7) >= 0.55 AS is_meaningful FROM (SELECT *, row_number() OVER (PARTITION BY file_id, iso_date ORDER BY round(score, 9) DESC, start) AS nth FROM v) WHERE nth = 1""")
def date_verdict(spark, sf_dir):
    m = mentions(spark, sf_dir).join(_recurrence(spark, sf_dir), ["iso_date", "place"], "left")
    score = D.combine(F.lit(0.5), D.structured_signal(F.col("in_tabular")), D.metadata_signal(F.col("iso_date"), F.col("mtime")), D.crossfile_signal(F.col("files")), F.col("precision"))
    best = D.best_per_day(m.withColumn("raw", score).withColumn("score", F.round("raw", 9)))
    return best.select("file_id", "iso_date", "start", F.round("raw", 5).alias("score"), (F.round("raw", 7) >= 0.55).alias("is_meaningful"))


#: Words of the dated texts by place: due 0, its date 1-3, then 4, its date 5-7, exam 8, on 9, its date 10-12, published 13, in 14, its year 15, never 16, a false date 17-19.
_NEAR_BY = "greatest(0.0, 1 - (CASE WHEN {0} < a THEN a - 1 - {0} ELSE {0} - b - 1 END) / 12.0)"


@query(f"""WITH {_DATES}, said AS (SELECT file_id, day, length(strftime(day, '%-d %B %Y')) AS long FROM dated),
  m AS (SELECT file_id, 4 AS start, day AS iso_date, 1 AS a, 3 AS b, 'day' AS precision, day AS mtime FROM said UNION ALL SELECT file_id, 20, day, 5, 7, 'day', day FROM said UNION ALL SELECT file_id, 40, day, 10, 12, 'day', day FROM said
    UNION ALL SELECT file_id, 55 + long, make_date(year(day), 1, 1), 15, 15, 'year', day FROM said UNION ALL SELECT file_id, 73 + long, DATE '2024-01-01', 19, 19, 'year', day FROM said),
  f AS (SELECT iso_date, count(DISTINCT file_id) AS files FROM m GROUP BY 1),
  k AS (SELECT *, greatest(0.0, least(1.0, 0.5 + 0.5 * greatest({_NEAR_BY.format(0)}, {_NEAR_BY.format(8)}) - 0.5 * 0.9 * {_NEAR_BY.format(13)})) AS kw,
    CASE WHEN iso_date >= mtime THEN exp(-(iso_date - mtime) / 60.0) ELSE exp((iso_date - mtime) / 30.0) END AS md, CASE WHEN files <= 1 THEN 0.5 ELSE 0.5 + 0.5 * least(1.0, (files - 1) / 3.0) END AS cf FROM m JOIN f USING (iso_date)),
  v AS (SELECT *, greatest(0.0, least(1.0, (0.40 * kw + 0.25 * 0.5 + 0.20 * md + 0.15 * cf) * CASE WHEN precision = 'year' THEN 0.35 ELSE 1.0 END)) AS score FROM k)
  SELECT file_id, CAST(start AS INTEGER) AS start, iso_date, round(kw, 5) AS sig_keyword, round(score, 5) AS score, score >= 0.55 AS is_meaningful,
    concat_ws('; ', CASE WHEN kw > 0.5 THEN 'words of a commitment nearby' WHEN kw < 0.5 THEN 'words of a record or reference nearby' END, CASE WHEN files > 1 THEN 'in ' || files || ' files' END, CASE WHEN precision = 'year' THEN 'only a year' END) AS reason FROM v""")
def date_classify(spark, sf_dir):
    docs = _dated(spark, sf_dir)
    found = D.date_mentions(docs, near="mtime").withColumn("in_tabular", F.lit(False))
    return D.classify(found, docs).select("file_id", "start", "iso_date", F.round("sig_keyword", 5).alias("sig_keyword"), F.round("score", 5).alias("score"), "is_meaningful", "reason")


@query("""SELECT l_orderkey * 10 + l_linenumber AS mention_id, round(CASE l_linenumber % 4 WHEN 0 THEN 0.5 + 0.5 * (1.0 * (1 - (l_partkey % 14) / 12.0)) * CASE WHEN l_partkey % 14 < 12 THEN 1 ELSE 0 END
    WHEN 1 THEN 0.5 - 0.5 * (0.9 * (1 - (l_partkey % 14) / 12.0)) * CASE WHEN l_partkey % 14 < 12 THEN 1 ELSE 0 END WHEN 2 THEN 0.5 + 0.5 * 0.7 * 0.85 ELSE 0.5 END, 5) AS signal FROM lineitem""")
def keyword_signal(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    word = F.when(F.col("l_linenumber") % 4 == 0, "Deadline ").when(F.col("l_linenumber") % 4 == 1, "attendance ").otherwise("")
    before = F.concat(word, F.repeat(F.lit("xx "), (F.col("l_partkey") % 14).cast("int")))
    header = F.when(F.col("l_linenumber") % 4 == 2, "Supervisor meetings").otherwise("")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention_id"), F.round(D.keyword_signal(before, F.lit(" zz"), header), 5).alias("signal"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 0.8 WHEN 'click' THEN 1.0 ELSE 0.0 END AS cue, CASE event_type WHEN 'view' THEN 'slides' WHEN 'error' THEN 'note' ELSE '' END AS format_word FROM events""")
def query_cues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "view", "the slides I worked on").when(F.col("event_type") == "click", "what I read During exams").when(F.col("event_type") == "error", "a note on presentations").otherwise("nothing noted")
    return e.select("event_id", Q.cue_weight(text).alias("cue"), Q.format_word(text).alias("format_word"))


@query(r"SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]{2,}'), lambda w: w NOT IN ('file','files','thing','things','stuff','something','anything','document','documents','one','ones','kind','sort','bit')) AS terms FROM benchmark")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", Q.topic_terms(F.col("text")).alias("terms"))


_HEAD = "'^ {0,3}#{1,6} +'"
_BULLET = "CASE WHEN regexp_matches(x, '^[ \\t]*[-*+][ \\t]+([^-*+ \\t]|$)') THEN regexp_replace(x, '^[ \\t]*[-*+][ \\t]+', '') ELSE regexp_replace(x, '^[ \\t]*[-*+][ \\t]+([ \\t])', '\\1') END"


@query(rf"""WITH l AS (SELECT doc_id, raw, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE NOT regexp_matches(raw, '^[ \t]*[-=*_]{{3,}}[ \t]*$')),
  a AS (SELECT *, regexp_replace(regexp_replace(raw, {_HEAD}, ''), '^[ \t]*\[[ xX]\][ \t]*', '') AS x FROM l), b AS (SELECT doc_id, raw, i, regexp_replace(regexp_replace({_BULLET}, '^[ \t]*[0-9]+[.)][ \t]+', ''), '\*\*|__|\*|_|`', '', 'g') AS x FROM a),
  c AS (SELECT doc_id, raw, i, trim(CASE WHEN contains(x, '|') THEN array_to_string(list_transform(list_filter(list_transform(string_split(x, '|'), lambda y: trim(y, ' -')), lambda y: y <> ''), lambda y: CASE WHEN regexp_matches(y, '[.!?:;]$') THEN y ELSE y || '.' END), ' ') ELSE x END) AS x FROM b),
  d AS (SELECT doc_id, raw, i, CASE WHEN x <> '' AND (regexp_matches(raw, {_HEAD}) OR trim(raw) <> x) AND NOT regexp_matches(x, '[.!?:;]$') THEN x || '.' ELSE x END AS x FROM c)
  SELECT documents.doc_id, CASE WHEN any_value(text) IS NOT NULL THEN md5(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE x <> '' OR NOT contains(raw, '|')), '')) END AS digest FROM documents LEFT JOIN d USING (doc_id) GROUP BY documents.doc_id""")
def prepared_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.prepare_lines("text")).alias("digest"))


_NAME = r"[A-Z][\p{L}\p{N}_''’.-]*"
_NORMAL = "regexp_replace(trim(regexp_replace(surface, '[ \\t\\n\\r]+', ' ', 'g')), '^(Dr[.]? |Prof[.]? |Mr[.]? |Ms[.]? |Mrs[.] )', '')"


@query(rf"""WITH e AS (SELECT doc_id AS file_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:^|[^\p{{L}}\p{{N}}_])({_NAME}(?:\s+(?:of|the|and|de|von|for)\s+{_NAME}|\s+{_NAME})+)', 1)) AS surface FROM documents),
  n AS (SELECT file_id, CASE WHEN regexp_matches(lower(surface), '\b(university|institute|college|inc|ltd|corp|company|bank|agency)\b') THEN 'org' WHEN regexp_matches(lower(surface), '\b(city|street|road|river|lake|mount|state)\b') THEN 'location' ELSE 'person' END AS category,
    trim(regexp_replace(regexp_replace({_NORMAL}, '(''s|’s)$', ''), '(''s|’s)$', ''), ' .,;:') AS normalised FROM e)
  SELECT file_id, category, count(*) AS n FROM n WHERE length(normalised) >= 2 AND NOT regexp_matches(normalised, '^[0-9]+$') AND NOT (category = 'org' AND regexp_matches(normalised, '^[A-Z]{{1,5}}$')) GROUP BY 1, 2""")
def entity_recognise(spark, sf_dir):
    return E.recognise(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")).groupBy("file_id", "category").agg(F.count(F.lit(1)).alias("n"))
