"""Parts that no SQL can state, against plain versions: clusters, hashed vectors, places, providers, the corpus and its engine run."""

import collections
import datetime as dt
import http.server
import json
import random
import struct
import threading
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar import providers, schemas
from lodestar.engine import Engine
from lodestar.functions import dates as D
from lodestar.functions import decompose as Q
from lodestar.functions import text as T
from lodestar.functions import timeline as L
from lodestar.operators import blocks as B
from lodestar.operators import entities as E
from lodestar.operators import evaluation as M
from lodestar.operators import graph as G
from lodestar.operators import retrieval as R
from lodestar.operators import sessions as S
from lodestar.operators import store
from lodestar.operators import vectors as V
from lodestar.plans import graph_queries as GQ
from lodestar.sources import corpus
from lodestar.sources import extract as X

SF = "/root/testdata/sf0.001"


def clusters_by_hand(times, words, folders, gap, threshold):
    """Clusters merged one best pair at a time, every mean affinity worked out anew."""
    w = {"t": 0.4 / 0.7, "e": 0.2 / 0.7, "f": 0.1 / 0.7}

    def near(i, j):
        a, b = folders[i].split("/"), folders[j].split("/")
        shared = 0
        while shared < min(len(a), len(b)) and a[shared] == b[shared]:
            shared += 1
        folder = 1.0 if a == b else shared / (max(len(a), len(b)) + 1) if shared else 0.0
        union = words[i] | words[j]
        return w["t"] * max(0.0, 1 - abs(times[i] - times[j]) / gap) + w["e"] * (len(words[i] & words[j]) / len(union) if words[i] & words[j] else 0.0) + w["f"] * folder

    groups = [[i] for i in range(len(times))]
    while True:
        best, pair = threshold, None
        for x in range(len(groups)):
            for y in range(x + 1, len(groups)):
                cross = [(i, j) for i in groups[x] for j in groups[y]]
                mean = sum(near(i, j) for i, j in cross) / len(cross)
                if min(abs(times[i] - times[j]) for i, j in cross) <= gap and mean > best + 1e-12:
                    best, pair = mean, (x, y)
        if pair is None:
            return [(g, np.mean([near(i, j) for k, i in enumerate(g) for j in g[:k]]) if len(g) > 1 else 0.0) for g in groups]
        groups[pair[0]] = groups[pair[0]] + groups.pop(pair[1])


def test_session_clusters_and_their_descriptions(spark):
    found, rows = GQ._clusters(spark, SF)
    rows = rows.toPandas()
    want = {}
    for _, island in rows.groupby("island"):
        island = island.sort_values(["mtime", "file_id"])
        times = [t.timestamp() / 3600 for t in island.mtime]
        for members, cohesion in clusters_by_hand(times, [frozenset(e) for e in island.entities], list(island.folder), 24.0, 0.5):
            want[frozenset(int(island.file_id.iloc[i]) for i in members)] = round(float(cohesion), 5)
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r.island, r.cluster, round(r.cohesion, 5)].add(r.file_id)
    assert {frozenset(v): k[2] for k, v in got.items()} == want

    times = dict(zip(rows.file_id, rows.mtime))
    paths = {i: f"{f}/exam-{i}" for i, f in zip(rows.file_id, rows.folder)}
    order = sorted((g for g in want if len(g) >= 2), key=lambda g: (min(times[i] for i in g), min(paths[i] for i in g)))
    described = {r.session_id: r for r in GQ.session_descriptions(spark, SF).collect()}
    assert len(described) == len(order)
    for n, g in enumerate(order, 1):
        r = described[f"session:{n}"]
        assert (r["size"], r.kind, round(r.cohesion, 5)) == (len(g), "exam_prep", want[g])
        assert list(r.dates) == sorted({times[i].date() for i in g})
        folders = {paths[i].rsplit("/", 1)[0] for i in g}
        assert r.label == f"exam prep in {folders.pop() if len(folders) == 1 else 'x'} ({min(times[i] for i in g):%d %b %Y})"


def test_hashed_vectors_count_terms(spark):
    texts = ["One two two three THREE three", "", None, "--", "ümlaut 7 7 a-b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", V.hashed_terms(F.col("text"), 16).alias("v")).collect()
    for r in rows:
        counts = np.zeros(16)
        for word in __import__("re").findall("[a-z0-9]+", (texts[r.id] or "").lower()):
            counts[np.int64(np.uint64(xxhash.xxh64(word.encode(), seed=42).intdigest())) % 16] += 1
        want = counts / np.linalg.norm(counts) if counts.any() else counts
        assert r.v is None if texts[r.id] is None else np.allclose(r.v, want)


def test_similarities_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "DOC_BLOCK", 11)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 5))
    m[40:45] = m[3]  # ties
    docs = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)] + [(99, None)], "doc_id long, v array<double>")
    got = {(r.src, r.dst) for r in V.neighbours(docs, 4, 0.5).collect()}
    sims = m @ m.T
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i and sims[i, j] >= 0.5), key=lambda j: (-round(sims[i, j], 9), j))[:4]}
    assert got == want
    assert V.similarities(docs.select(F.col("doc_id").alias("query_id"), "v").where("query_id < 3"), docs).count() == 180
    with pytest.raises(Exception, match="dimension"):
        V.similarities(spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>"), docs).collect()


def test_similarities_shuffle_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "DOC_BLOCK", 16)
    m = np.random.default_rng(1).normal(size=(100, 6))
    m[20:60] = m[0]  # more ties than k in a block and over blocks
    docs = spark.createDataFrame([(i, m[i].tolist()) for i in range(100)], "doc_id long, v array<float>")
    sims = V.similarities(docs.select(F.col("doc_id").alias("query_id"), "v"), docs, 3, apart=True)
    plan = sims._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    f = m.astype(np.float32).astype(float)
    best = {(r.query_id, r.doc_id) for r in V.top_k(sims, 3).collect()}
    assert best == {(i, j) for i in range(100) for j in sorted((j for j in range(100) if j != i), key=lambda j: (-round(f[i] @ f[j], 9), j))[:3]}


def test_tables_on_the_way_go(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from lodestar.operators import cluster

    monkeypatch.setattr(cluster, "shared_folder", lambda _: str(tmp_path))
    shuffled = lambda: {p.name for p in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data")}
    was = shuffled()
    parts = lambda: cluster.settled(spark.range(50).groupBy((F.col("id") % 7).alias("k")).count(), "way").where("k > 2")
    assert cluster.settled_from(parts, "end").count() == 4
    assert [p.name.split("-")[0] for p in (tmp_path / "tables").iterdir()] == ["end"]
    assert spark.conf.get(cluster.CLEANUP) == "false"
    assert len(shuffled() - was) <= 1  # that of the count here
    GQ.ablation_grid(spark, SF).collect()
    kinds = {p.name.rpartition("-")[0] for p in (tmp_path / "tables").iterdir()} - {"end", "grid-edges"}
    assert all(k.startswith("ablation-") for k in kinds), kinds


def test_coverage_keeps_its_results_only(spark, tmp_path, monkeypatch):
    from lodestar.operators import cluster

    monkeypatch.setattr(cluster, "shared_folder", lambda _: str(tmp_path))
    assert GQ.explanation_coverage(spark, SF).count() > 0
    assert {p.name.rpartition("-")[0] for p in (tmp_path / "tables").iterdir()} == {"coverage-results"}


@pytest.mark.parametrize("of", ["same_folder", "sibling_folders"])
def test_pairs_of_a_large_folder_are_dealt_out(spark, monkeypatch, of):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"}
    monkeypatch.setattr(G, "PAIR_PIECE", 4, raising=False)
    monkeypatch.setattr(G, "PAIRS_A_TASK", 100, raising=False)
    held = [(i, "p/a" if i % 2 else "p/b") for i in range(60)] + [(60, "q/a"), (61, "q/b"), (62, "q/b"), (63, ""), (64, "")]
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = getattr(G, of)(spark.createDataFrame(held, "file_id long, folder string")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    same = lambda p, q: p == q if of == "same_folder" else p != q and p and q and p.split("/")[0] == q.split("/")[0]
    want = sorted((a, b) for a, p in held for b, q in held if a < b and same(p, q))
    assert sorted((r.a, r.b) for r in rows) == want
    assert len({r.task for r in rows}) > 4


def test_same_folder_works_nothing_out_for_a_pair(spark):
    """A pair costs its comparison only, as the pairs of a folder are so many; weights and rounding are for blocks."""
    above = GQ.same_folder_edges(spark, SF)._jdf.queryExecution().executedPlan().toString().partition("Generate")
    assert above[1] and not any(f in above[0] for f in ("round(", "split(", "least(", "Join"))
    files = [(i, f) for i, f in enumerate(["a"] * 300 + ["a/b/c"] * 2 + ["", "", None, None])] + [(7, "a")]
    got = G.same_folder(spark.createDataFrame(files, "file_id long, folder string")).collect()
    want = [(a, b, 0.6 if f == "a" else 0.8 if f else 0.5) for a, f in files for b, g in files if f is not None and f == g and a < b]
    assert sorted(map(tuple, got)) == sorted(want)


def test_sibling_pairs_take_few_bytes(spark, tmp_path):
    """The pairs of many files come in runs that a column's encoding takes in."""
    from pathlib import Path

    ids = np.random.default_rng(5).permutation(100_000)[:3_000].tolist()
    f = spark.createDataFrame([(i, f"p/{'ab'[n % 2]}") for n, i in enumerate(ids)], "file_id long, folder string")
    G.sibling_folders(f).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1_500 * 1_500
    assert sum(p.stat().st_size for p in Path(tmp_path / "out").glob("*.parquet")) < 0.6 * 1_500 * 1_500


def test_sibling_pairs_of_one_id_stay_as_in_sql(spark):
    files = [(5, "p/a"), (5, "p/b"), (3, "p/b"), (9, "p/c"), (9, "p/c"), (1, "q/a"), (2, "q/r/a"), (4, "p"), (6, ""), (8, None)]
    got = G.sibling_folders(spark.createDataFrame(files, "file_id long, folder string")).collect()
    parent = lambda f: f.rpartition("/")[0] if f else ""
    want = [(min(a, b), max(a, b), 0.25) for a, f in files for b, g in files if parent(f) and parent(f) == parent(g) and f < g]
    assert sorted(map(tuple, got)) == sorted(want) and (5, 5, 0.25) in want


def _star(spark, n):
    """Edges from file:0 to n others, from file:1 to file:2 ... and from each of these to a vertex of its own."""
    rows = [("file:0", f"file:{i}", "semantic", 1.0 - i / 1e4) for i in range(1, n + 1)] + [(f"file:{i}", f"file:{i + 10_000}", "semantic", 0.5) for i in range(1, n + 1)]
    rows += [("file:1", f"file:{i}", "semantic", 0.999 - i / 1e5) for i in range(2, n + 1)]
    return spark.createDataFrame(rows, "src string, dst string, type string, weight double")


def test_two_hop_query_has_no_cap(spark, monkeypatch):
    monkeypatch.setattr(GQ, "_edges", lambda *_: _star(spark, 300))
    monkeypatch.setattr(GQ, "_seeds", lambda *_: spark.createDataFrame([(0, "file:0")], "query_id long, node string"))
    assert GQ.two_hop_expand(spark, "").count() == 601


@pytest.mark.parametrize("cap", [1, 3, 7, 40, 61, 100])
def test_capped_hops_are_the_first_of_all(spark, cap):
    e = _star(spark, 30)
    seeds = spark.createDataFrame([(0, "file:0"), (1, "file:0"), (1, "file:1"), (2, "file:1"), (3, "file:30"), (3, "file:30")], "query_id long, node string")
    want = {}
    for r in sorted(G.two_hops(e, seeds, ["semantic"], None).collect(), key=lambda r: (r.hop, -r.weight, r.node)):
        want.setdefault(r.query_id, []).append((r.node, r.hop, r.weight))
    got = {}
    for r in G.two_hops(e, seeds, ["semantic"], cap).collect():
        got.setdefault(r.query_id, set()).add((r.node, r.hop, r.weight))
    assert got == {q: set(rows[:cap]) for q, rows in want.items()}


@pytest.mark.parametrize("several", [False, True])
def test_pairwise_scores_count_pairs(spark, monkeypatch, several):
    if not several:  # a group of 40,000 has 800 million pairs, which must not be made
        monkeypatch.setattr(S, "pairs_of", None)
    rng = random.Random(4)
    rows = lambda k: [(i, None if rng.random() < 0.1 else f"g{rng.randrange(k)}") for i in range(60)]
    t, f = rows(5), rows(7)[5:] + [(90, "g1"), (None, "g1"), (91, "g1"), (91, "g1")] + ([(7, "g2"), (7, "g3"), (8, "g3")] if several else [])
    pairs = lambda rows: {(a, b) for a, g in rows for b, h in rows if g is not None and g == h and a is not None and b is not None and a < b}
    x, y = pairs(t), pairs(f)
    frame = lambda rows: spark.createDataFrame(rows, "path long, session string")
    r = S.pairwise_scores(frame(t), frame(f)).first()
    assert (r.tp, r.fp, r.fn) == (len(x & y), len(y - x), len(x - y))
    assert r.precision == pytest.approx(len(x & y) / len(y)) and r.recall == pytest.approx(len(x & y) / len(x))
    if not several:
        big = spark.range(40_000).select(F.col("id").alias("path"), F.lit("g").alias("session"))
        assert S.pairwise_scores(big, big).first().tp == 799_980_000
        assert S.pairwise_scores(frame([]), frame([])).first().f1 == 0.0


def test_equal_vectors_alone_pair_nothing(spark, monkeypatch):
    made, keep = [], G.settled
    monkeypatch.setattr(G, "settled", lambda df, name: made.append((name, (t := keep(df, name)).count())) or t)
    texts = {i: " ".join(f"w{i * 50 + j}" for j in range(20)) for i in range(300)}
    texts |= {i: texts[i - 150] for i in range(290, 300)} | {200: texts[100] + " more", 201: None, 202: ""}
    docs = spark.createDataFrame(list(texts.items()), "file_id long, text string")
    v = spark.createDataFrame([(i, [0.0, 1.0] if i in (295, 7) else None if i == 296 else [1.0, 0.0]) for i in texts], "doc_id long, v array<double>")
    got = {(r.a, r.b, r.cosine) for r in G.duplicates(docs, v).collect()}
    assert got == {(i - 150, i, 1.0) for i in range(290, 300) if i not in (295, 296)} | {(100, 200, 1.0)}
    assert max(n for name, n in made if name.startswith("duplicate")) <= 300  # 300 equal vectors have 44,850 pairs


def test_dated_files_are_not_multiplied_by_queries(spark, monkeypatch):
    made, keep = [], R.settled
    for module in (R, G):
        monkeypatch.setattr(module, "settled", lambda df, name: made.append((name, (t := keep(df, name)).count())) or t)
    day = dt.date(2024, 2, 3)
    q = spark.createDataFrame([(i, [1.0, 0.0], day if i else None, day if i else None, 1.0) for i in range(30)], "query_id long, v array<double>, range_start date, range_end date, cue double")
    docs = spark.createDataFrame([(i, [float(np.cos(i / 500)), float(np.sin(i / 500))]) for i in range(400)], "doc_id long, v array<double>")
    line = spark.createDataFrame([(i, day, 0.5) for i in range(300)], "file_id long, day date, score double")
    members = spark.createDataFrame([(f"session:{i % 3}", i) for i in range(400)], "session_id string, file_id long")
    sessions = members.select("session_id").distinct().withColumn("cohesion", F.lit(0.4))
    edges = G.activity_edges(members, sessions).unionByName(G.both_ways(spark.createDataFrame([("file:5", "file:399", "semantic", 0.8)], "a string, b string, type string, weight double")))
    out = R.retrieve(q, docs, edges, timeline=line, members=members, seeds=2, expanded=20, top=100).collect()
    assert max(n for name, n in made if "edges" not in name) <= 620  # 29 queries by 300 files are 8,700
    first = sorted((f"file:{i}" for i in range(300)))[:20]
    assert {(r.query_id, r.file_id) for r in out if r.query_id} == {(i, int(f[5:])) for i in range(1, 30) for f in first}
    size = {s: len([i for i in range(400) if i % 3 == s]) for s in range(3)}
    assert all(r.seed and r.s_graph == 1.0 and r.timeline == 0.5 and r.s_activity == pytest.approx(min(1.0, 1.4 * (0.5 + 0.5 * 100 / size[r.file_id % 3]))) for r in out if r.query_id)
    plain = {r.file_id: r for r in out if not r.query_id}
    assert len(plain) == 18 and plain[0].seed and plain[1].seed and plain[102].s_activity == pytest.approx(min(1.0, 1.4 * (0.5 + 0.5 / size[0])))


def test_duplicates_need_both_signs(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:55] + ["x"] * 5)), (3, " ".join(words[::-1])), (4, " ".join(words)), (5, None)], "file_id long, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.43]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 0.0])], "doc_id long, v array<double>")
    assert [(r.a, r.b, round(r.cosine, 2)) for r in G.duplicates(docs, v).collect()] == [(1, 2, 0.9)]


def test_long_lists_of_shingles_are_cut(spark, monkeypatch):
    rng = random.Random(1)
    made = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(4, 30)))) for i in range(80)] + [(90, ""), (91, None)]
    docs = spark.createDataFrame(made, "file_id long, text string")
    pick = lambda: (sorted((r.a, r.b, round(r.weight, 9)) for r in G.shingle_pairs(docs, 0.25, 3)[0].collect()), sorted(map(tuple, G.shingle_pairs(docs, 0.25, 3)[1].collect())))
    want = pick()
    monkeypatch.setattr(G, "LIST_PIECE", 5)
    assert pick() == want
    sets = {}
    for i, t in made[:80]:
        w = t.split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2)))
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    reps = sorted(set(first.values()))
    assert want[1] == sorted((i, first[s]) for i, s in sets.items())
    assert want[0] == [(a, b, round(j, 9)) for a in reps for b in reps if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.25]


def test_heaviest_edge_of_each_hop(spark):
    e = spark.createDataFrame([("a", "b", "structural", 0.3), ("a", "b", "semantic", 0.9), ("b", "c", "entity", 0.4), ("a", "d", "entity", 0.2), ("d", "c", "entity", 0.9)], "src string, dst string, type string, weight double")
    r = G.shortest_paths(e, spark.createDataFrame([("a",)], "id string")).where("node = 'c'").first()
    assert (r.hops, r.path, [(s.type, s.weight) for s in r.steps]) == (2, ["a", "b", "c"], [("semantic", 0.9), ("entity", 0.4)])


def test_places_and_names_of_any_length(spark):
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join(rng.choice(["Ann", "Lee", "the", "Ann Lee"]) for _ in range(rng.randrange(1, 12)))
        said = [rng.choice(["Ann", "Lee", "Ann Lee", "Bob"]) for _ in range(rng.randrange(1, 6))]
        after = 0
        for s, at in zip(said, E.places(said, text)):
            ahead = [i for i in range(len(text)) if text.startswith(s, i)]
            assert at == next((i for i in ahead if i >= after), ahead[0] if ahead else -1)
            after = at + len(s) if at >= 0 else after
    found = spark.createDataFrame([(1, "Lee", 9), (1, "Ann", 2), (1, "Bob", 20), (2, "x", 0)], "file_id long, text string, char_start int")
    docs = spark.createDataFrame([(1, "**Ann** and _Lee_"), (2, None)], "file_id long, text string")
    assert sorted((r.file_id, r.text, r.char_start, r.char_end) for r in E.remap(found, docs).collect()) == [(1, "Ann", 2, 5), (1, "Bob", -1, -1), (1, "Lee", 13, 16), (2, "x", -1, -1)]
    long = "The Very Long Name Of One Old House"
    names = spark.createDataFrame([(long, "location")], "surface string, category string")
    assert [r.n for r in E.propagate(spark.createDataFrame([(1, f"See {long}, then {long}.")], "file_id long, text string"), names).collect()] == [2]


def test_chunk_parts_hold_all_lines():
    rng = random.Random(8)
    for _ in range(300):
        lines = [" ".join(["w"] * rng.randrange(0, 12)) for _ in range(rng.randrange(1, 20))]
        size, overlap = rng.randrange(4, 30), rng.randrange(1, 8)
        want, held, fresh = [], [], False
        for k, line in enumerate(lines):
            if fresh and B.tokens_of("\n".join(lines[i] for i in [*held, k])) > size:
                want.append("\n".join(lines[i] for i in held))
                while held and B.tokens_of("\n".join(lines[i] for i in held)) > overlap:
                    held = held[1:]
            held, fresh = [*held, k], True
        assert list(B._parts("\n".join(lines), size, overlap)) == [*want, "\n".join(lines[i] for i in held)]


def test_time_phrases(spark):
    today = dt.date(2025, 11, 20)
    read = lambda s: Q.read_query(s, today).range
    assert read("notes from the third week of October 2025, please").start == dt.date(2025, 10, 15)
    assert read("slides of March to April").end == dt.date(2026, 4, 30)
    assert read("what I did (last week)").start == dt.date(2025, 11, 10) and read("a plan") is None
    assert [r.start.year for r in L.readings("September", today)] == [2025, 2024, 2026, 2023, 2027]
    assert len(L.readings("September 2024", today)) == len(L.readings("last week", today)) == 1


def test_lookup_of_a_path(spark):
    f = spark.createDataFrame([("a/Notes.md",), ("b/notes.txt",), ("c/x.py",)], "path string")
    assert store.one_path(f, "X.PY") == "c/x.py" and store.one_path(f, "b/notes.txt") == "b/notes.txt"
    for said in ("notes", "nothing"):
        with pytest.raises(store.AmbiguousPath):
            store.one_path(f, said)


def test_iso_times(spark):
    said = ["2025-01-02T03:04:05Z", "2025-01-02 03:04:05.25", "2025-01-02", "2025-01-02T03:04:05+05:30", "", None, "soon", "2025-02-30"]
    got = [r.t for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i").select(D.parse_iso(F.col("s")).alias("t")).collect()]
    at = dt.datetime(2025, 1, 2, 3, 4, 5)
    assert got == [at, at.replace(microsecond=250_000), dt.datetime(2025, 1, 2), at, None, None, None, None]


def test_summaries(spark):
    rows = [(1, "Plan", "Red stones lie here. Red stones lie there today. Blue birds sing at night. Red stones of the river shine. It is so as it was."), (2, "", None), (3, "T", "two words"), (4, "T", "It is so. So is it not. There it was as it is.")]
    got = {r.id: r.summary for r in T.extractive_summary(spark.createDataFrame(rows, "id long, title string, body string"), "id", "body", title="title").collect()}
    assert got == {1: "Plan: Red stones lie here. Red stones lie there today. Red stones of the river shine.", 2: "", 3: "T: two words", 4: "T: So is it not. There it was as it is."}
    assert spark.range(1).select(T.clip(F.lit("a bcd, efg"), 7)).first()[0] == "a bcd ..."


def test_evaluation_output(spark, tmp_path):
    rows = spark.createDataFrame([("full", 0.5)], "configuration string, mrr double")
    M.save(rows, rows.withColumn("query_id", F.lit("q1")), str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/per_query.csv").columns == ["configuration", "mrr", "query_id"]
    assert spark.read.json(f"{tmp_path}/results.json").first().mrr == 0.5
    took = M.latency(lambda: None, 3)
    assert took["repeats"] == 3 and took["min_ms"] <= took["median_ms"] <= took["max_ms"]
    assert M.coverage(spark.createDataFrame([(True,), (False,)], "complete boolean")).first().coverage == 0.5


class Answer(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        said = json.dumps({"response": f"About {body['prompt'].split()[-1]}."}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(said)

    def log_message(self, *_):
        pass


def test_providers(tmp_path):
    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s = providers.LocalSummariser(f"http://127.0.0.1:{server.server_port}", "m", lambda t: "fallback", 5)
    assert s("a text on kites") == "About kites." and s.fallbacks == 0
    server.shutdown()
    server.server_close()
    assert s("a text") == "fallback" and s.fallbacks == 1
    with pytest.raises(ValueError):
        providers.LocalSummariser("http://192.0.2.7:1", "m", str)
    with pytest.raises(FileNotFoundError):
        providers.load_model(str(tmp_path), "no.onnx")
    (tmp_path / "m.bin").write_bytes(b"x")
    opened = []
    opener = lambda path, n: opened.append((path, n)) or object()
    assert providers.load_model(str(tmp_path), "m.bin", opener, 3) is providers.load_model(str(tmp_path), "m.bin", opener, 3) and opened == [(str(tmp_path / "m.bin"), 3)]


def test_pdf_and_image_heads():
    stream = zlib.compress(b"BT (Exam on) Tj 0 -14 Td [(24) -300 (Nov\\(ember\\))] TJ ET")
    made = b"%PDF-1.4\n1 0 obj <</Type /Pages>> endobj\n2 0 obj <</Type /Page /Contents 3 0 R>> endobj\n3 0 obj <</Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj\n4 0 obj <</Type /Page>> endobj\n"
    got = X.read(made, "a.pdf")
    assert got["ok"] and [(b["label"], b["text"]) for b in got["blocks"]] == [("page 1", "Exam on\n24 Nov(ember)")]
    assert not X.read(made + b"/Encrypt", "a.pdf")["ok"] and not X.read(b"%PDF", "a.pdf")["ok"]
    png = b"\x89PNG\r\n\x1a\n" + b"\x00" * 8 + struct.pack(">II", 30, 20)
    jpeg = b"\xff\xd8\xff\xe1\x00\x24Exif\x00\x00" + b"\x00" * 10 + b"2024:05:06 10:00:00\x00" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 4, 5) + b"\x00" * 9
    assert X.picture(png) == {"format": "png", "width": "30", "height": "20"}
    assert X.picture(jpeg[:4] + struct.pack(">H", len(jpeg) - 6 - 18) + jpeg[6:])["taken"] == "2024-05-06"
    assert X.read(png, "my_pic.png")["blocks"][0]["label"] == "name only; png 30x20" and X.picture(b"") == {}


def test_engine_over_the_made_corpus(spark, tmp_path):
    root = str(tmp_path / "made")
    truth = corpus.write(root, sessions=3, files=4, loose=2)
    assert truth["counts"]["files"] == 14 and corpus.write(root, sessions=3, files=4, loose=2) == truth
    e = Engine(spark, str(tmp_path / "data"))
    assert schemas.migrate(spark, e.data) == list(range(1, schemas.VERSION + 1)) and schemas.migrate(spark, e.data) == []
    e.index(root)
    first = e.query([q["text"] for q in truth["queries"]], dt.date(2025, 6, 1))
    hits = collections.defaultdict(list)
    for r in first.orderBy("query_id", "rank").collect():
        hits[r.query_id].append(r.path)
        assert r.complete
    for n, q in enumerate(truth["queries"]):
        if q["kind"] == "semantic":
            assert set(hits[n][:3]) <= set(q["relevant"])
    top = e.explain(1).first()
    assert any("graphs" in reason for reason in top.reasons)
    e.feedback_on(1, "reject")
    assert e.stats()["feedback"] == 1 and e.find(truth["files"][0]["path"].upper()) == truth["files"][0]["path"]
    labels = spark.createDataFrame([(f["path"], dt.date.fromisoformat(d["date"]), d["kind"]) for f in truth["files"] for d in f["dates"]], "path string, iso_date date, kind string")
    verdicts = e.table("classified_dates").join(e.table("files").select("file_id", "path"), "file_id")
    aligned = M.align(verdicts, labels)
    assert aligned.where("agrees").count() >= 0.8 * aligned.count() and M.undetected(labels, verdicts).count() == 0
    pairs = {(r.a, r.b) for r in e.table("edges").where("type = 'duplicate'").select(F.col("src").alias("a"), F.col("dst").alias("b")).collect()}
    assert len(pairs) >= 2 * len(truth["near_duplicate_pairs"])
    with pytest.raises(LookupError):
        e.feedback_on(500)
