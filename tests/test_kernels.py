"""Kernels and rules on hand-made cases, and properties that hold for any input."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import config, schemas
from lodestar.functions import dates as D
from lodestar.functions import decompose as Q
from lodestar.functions import text as T
from lodestar.functions import timeline as L
from lodestar.operators import blocks as B
from lodestar.operators import entities as E
from lodestar.operators import graph as G
from lodestar.operators import sessions as S
from lodestar.operators import store

TODAY = dt.date(2025, 11, 20)


@pytest.mark.parametrize(
    "said, start, end",
    [
        ("2025-11-24", "2025-11-24", "2025-11-24"), ("24-11-2025", "2025-11-24", "2025-11-24"), ("24 november 2025", "2025-11-24", "2025-11-24"), ("2025-12-01 to 2025-11-24", "2025-11-24", "2025-12-01"),
        ("November", "2025-11-01", "2025-11-30"), ("sept 2024", "2024-09-01", "2024-09-30"), ("March to April", "2026-03-01", "2026-04-30"), ("November to February", "2025-11-01", "2026-02-28"),
        ("third week of October", "2025-10-15", "2025-10-21"), ("last week of March 2026", "2026-03-25", "2026-03-31"), ("fifth week of february 2024", "2024-02-29", "2024-02-29"),
        ("last week", "2025-11-10", "2025-11-16"), ("next month", "2025-12-01", "2025-12-31"), ("this year", "2025-01-01", "2025-12-31"), ("yesterday", "2025-11-19", "2025-11-19"), ("Q1 2026", "2026-01-01", "2026-03-31"), ("2025", "2025-01-01", "2025-12-31"), ("next fortnight", "2025-12-01", "2025-12-14"),
    ],
)
def test_ranges(said, start, end):
    r = L.read_range(said, TODAY)
    assert (r.start.isoformat(), r.end.isoformat()) == (start, end)
    assert r.days == (r.end - r.start).days + 1 and r.start in r


@pytest.mark.parametrize("said", ["", "around the deadline", "30-02-2025", "fifth week of february 2025", "3000"])
def test_unreadable_ranges(said):
    with pytest.raises(L.UnreadableRange):
        L.read_range(said, TODAY)


def test_best_reading_goes_where_the_dates_are(spark):
    t = spark.createDataFrame([(1, dt.date(2024, 9, 3)), (2, dt.date(2024, 9, 9))], "file_id long, day date")
    assert L.best_reading("September", t, dt.date(2026, 8, 1)).start == dt.date(2024, 9, 1)
    assert L.best_reading("September", t.limit(0), dt.date(2026, 8, 1)).start == dt.date(2026, 9, 1)


@pytest.mark.parametrize(
    "text, found",
    [
        ("Due 24-11-2025.", [("2025-11-24", "day")]), ("11/24/2025", [("2025-11-24", "day")]), ("on 24 Nov", [("2025-11-24", "day")]), ("Nov 24, 2024", [("2024-11-24", "day")]),
        ("30 February 2025 x", [("2025-01-01", "year")]), ("published in 1999", [("1999-01-01", "year")]), ("no dates 3000", []),
    ],
)
def test_mentions(text, found):
    assert [(str(m["iso_date"]), m["precision"]) for m in D.mentions(text, TODAY)] == found


def test_mentions_do_not_overlap():
    rng = random.Random(3)
    parts = ["24 November 2025", "2025-11-24", "1-2-2024", "May 5", "2024", "x", "31 Apr", " "]
    for _ in range(200):
        text = " ".join(rng.choice(parts) for _ in range(8))
        found = D.mentions(text, TODAY)
        assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))
        assert all(text[m["start"] : m["end"]] == m["surface"] for m in found)


def test_signals_are_neutral_without_evidence(spark):
    one = spark.range(1).select(D.keyword_signal(F.lit("x"), F.lit("y"), F.lit("")), D.structured_signal(F.lit(False)), D.metadata_signal(F.lit(None).cast("date"), F.lit(None).cast("date")), D.crossfile_signal(F.lit(1)), D.keyword_signal(F.lit("no later than "), F.lit(""), F.lit("")), D.keyword_signal(F.lit(""), F.lit(""), F.lit("Catalog"))).first()
    assert list(one)[:4] == [0.5, 0.5, 0.5, 0.5]
    assert one[4] == pytest.approx(0.975) and one[5] == pytest.approx(0.5 - 0.5 * 0.42)


def test_text_kernels(spark):
    made = spark.createDataFrame([("  Dr. Ann  Lee's, ", "a/b/c", "a/x"), ("A", "", "a"), ("", "a/b", "a/b")], "s string, p string, q string")
    got = made.select(T.normalise_entity("s"), T.folder_affinity(F.col("p"), F.col("q")), T.token_estimate("s"), F.size(T.shingles("s"))).collect()
    assert got[0][0] == "Ann Lee's" or got[0][0] == "Ann Lee"
    assert [r[1] for r in got] == [0.25, 0.0, 1.0]
    assert [r[2] for r in got] == [4, 1, 1]
    lines = spark.createDataFrame([("## Head\n- item\n| a | b |\n---\nplain",)], "t string").select(T.prepare_lines("t")).first()[0]
    assert lines == "Head.\nitem.\na. b.\nplain"
    for glob, name, hit in (("*.py?", "a.pyc", True), ("~$*", "~$x", True), ("[!a]*", "abc", False), ("a.b", "axb", False)):
        assert spark.range(1).select(F.lit(name).rlike(T.glob_regex(glob))).first()[0] is hit


def test_query_reading():
    r = Q.read_query("the slides I worked on during the third week of October 2025", TODAY)
    assert r.format_word == "slides" and r.cue == 1.0 and r.range.start == dt.date(2025, 10, 15) and "slides" in r.terms


def brute_link(score, gaps, limit, threshold):
    groups = [[i] for i in range(len(score))]
    while True:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                cells = [(i, j) for i in groups[a] for j in groups[b]]
                if min(gaps[c] for c in cells) <= limit:
                    m = sum(score[c] for c in cells) / len(cells)
                    if m > threshold and (best is None or m > best[0] + 1e-12):
                        best = (m, a, b)
        if best is None:
            return {frozenset(g) for g in groups}
        groups[best[1]] += groups.pop(best[2])


def test_islands_cluster_like_the_whole():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 12))
        t = np.sort(rng.uniform(0, 100, n))
        gaps = np.abs(t[:, None] - t[None, :])
        score = rng.uniform(0, 1, (n, n))
        score = (score + score.T) / 2
        whole = brute_link(score, gaps, 12.0, 0.5)
        cut = np.cumsum(np.append(0, np.diff(t) > 12.0))
        parts = set()
        for c in np.unique(cut):
            at = np.flatnonzero(cut == c)
            label = S.link(score[np.ix_(at, at)], gaps[np.ix_(at, at)], 12.0, 0.5)
            parts |= {frozenset(at[label == k].tolist()) for k in np.unique(label)}
        assert parts == whole


def test_packed_chunks_fit():
    rng = random.Random(6)
    for _ in range(100):
        rows = [{"block_index": i, "kind": "p", "text": "\n".join(" ".join(["w"] * rng.randrange(1, 20)) for _ in range(rng.randrange(1, 30))), "is_tabular": False} for i in range(rng.randrange(1, 8))]
        for c in B.pack(rows):
            assert B.tokens_of(c["text"]) <= B.CHUNK_TOKENS + 8
    assert B.pack([{"block_index": 0, "kind": "p", "text": "  ", "is_tabular": False}]) == []


def test_incremental_equals_full(spark):
    was = spark.createDataFrame([("a", 1, "2024-01-01", "h1"), ("b", 2, "2024-01-01", "h2"), ("c", 3, "2024-01-01", "h3")], "path string, size long, mtime string, content_hash string")
    now = spark.createDataFrame([("a", 1, "2024-01-01", "h1"), ("b", 2, "2024-02-01", "h9"), ("d", 4, "2024-02-01", "h4"), ("c", 3, "2024-03-01", "h3")][:3], was.schema)
    d = {r.path: r.change for r in store.snapshot_diff(was, now).collect()}
    assert d == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "new"}
    work = lambda s: s.select("path", F.upper("content_hash").alias("made"))
    changed = now.join(spark.createDataFrame([(p,) for p, c in d.items() if c in ("new", "modified")], "path string"), "path", "left_semi")
    gone = spark.createDataFrame([(p,) for p, c in d.items() if c == "deleted"], "path string")
    step = store.forget(store.replace_for(work(was), changed, work(changed), "path"), gone, "path")
    assert sorted(step.collect()) == sorted(work(now).collect())
    touched = store.snapshot_diff(was, was.withColumn("mtime", F.lit("x"))).collect()
    assert {(r.change, r.touched) for r in touched} == {("unchanged", True)}


def test_edges_are_symmetric_and_bounded(spark):
    f = spark.createDataFrame([(i, f"r{i % 2}/f{i % 3}") for i in range(12)], "file_id long, folder string")
    pairs = G.same_folder(f).union(G.sibling_folders(f)).withColumn("type", F.lit("structural"))
    edges = {(r.src, r.dst): r.weight for r in G.both_ways(pairs).collect()}
    assert edges and all(edges[(b, a)] == w and 0 < w <= 1 for (a, b), w in edges.items())


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in G.components(pairs).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_gazetteer(spark):
    e = spark.createDataFrame([(1, "Ann Lee", "person"), (2, "Ann Lee", "person"), (3, "Ann Lee", "org"), (1, "NASA", "org"), (1, "Bo", "person")], "file_id long, normalised string, category string")
    names = E.gazetteer(e)
    assert [tuple(r) for r in names.collect()] == [("Ann Lee", "person")]
    docs = spark.createDataFrame([(9, "Then Ann Lee met Ann Lee. ann lee Annex")], "file_id long, text string")
    assert [tuple(r) for r in E.propagate(docs, names).collect()] == [(9, "Ann Lee", "person", 2)]


def test_names_late_in_a_long_text(spark):
    docs = spark.createDataFrame([(1, "x " * 150_000 + "Then Ann Lee came.")], "file_id long, text string")
    assert [(r.text, r.char_start) for r in E.recognise(docs).collect()] == [("Then Ann Lee", 300_000)]


def test_config(tmp_path):
    f = tmp_path / config.FILE_NAME
    f.write_text("[retrieval]\ntop_k = 4\n[scan]\nroot = 'x'\n")
    (tmp_path / "lodestar.local.toml").write_text("[retrieval]\ntop_k = 5\n")
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert config.load(start=deep, environ={}).retrieval.top_k == 5
    assert config.load(start=deep, environ={"LODESTAR_TOP_K": "6"}).retrieval.top_k == 6
    assert config.load(start=deep, environ={"LODESTAR_TOP_K": "6"}, overrides={"retrieval": {"top_k": 7}}).retrieval.top_k == 7
    assert config.load(start=deep, environ={}).scan.root == str(tmp_path / "x")
    for bad in ({"nothing": {}}, {"retrieval": {"nothing": 1}}, {"retrieval": {"weight_graph": 0.9}}, {"embeddings": {"chunk_overlap_tokens": 256}}, {"summaries": {"endpoint": "http://example.com"}}):
        with pytest.raises(config.ConfigError):
            config.load(environ={}, overrides=bad)
    assert sum(config.Config().retrieval.shares({"semantic", "graph"}).values()) == pytest.approx(1)


def test_snapshots_of_older_versions(spark, tmp_path):
    assert schemas.read(spark, str(tmp_path), "keywords").count() == 0
    schemas.write(spark.createDataFrame([(1, "a")], "file_id long, term string"), str(tmp_path), "keywords", 1)
    schemas.write(spark.createDataFrame([(2, "b", 3)], "file_id long, term string, count long"), str(tmp_path), "keywords", 2)
    assert [tuple(r) for r in schemas.read(spark, str(tmp_path), "keywords").collect()] == [(2, "b", 3, None)]
