"""Each operator against a brute-force version on small hostile tables, and on none."""

import collections
import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("lodestar.llm")
from pyspark.sql import functions as F

from lodestar.llm import chat_format, decontam, exact_dedup, html_extract, license_scan, line_dedup, ngram_join, packing, quality, queries, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, key string, n int"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def sentence(rng, n):
    return " ".join(rng.choice(["red", "green", "blue", "Stone", "river", "über", "maze,", "lamp", "kite", "oak"]) + str(rng.randrange(40)) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    near = lambda k: " ".join(w if i % 61 != k else "other" for i, w in enumerate(words))
    passage = sentence(rng, 50)
    texts = [None, "", "", " \t\n", "one", "One ", "two words", base, base, base.upper(), near(3), near(17), near(40), base + " \n", sentence(rng, 90) + " " + passage + " " + sentence(rng, 30), passage + "\n" + sentence(rng, 40), "x " * 80, "<|endoftext|> a  b\n c", ITEM + " tail", "head " + ITEM.upper() + ". " + ITEM, "short piece", "MIT License, general public license; the Apache-license", "mit\nlicense mit license", "é" * 50, sentence(rng, 4000)]
    texts += [sentence(rng, rng.randrange(1, 30)) for _ in range(15)]
    line = "this is a line of at least eight words here"
    texts += [line + "\nunique a b c d e f g h\n" + line + " two", "something else\n" + line + "\nunique a b c d e f g h"]
    out = [(i, t, "en", "s", 0, "a", 1, "k", 2) for i, t in enumerate(texts)]
    return [*out, out[7], (7, "another text under an id that is taken", None, None, None, None, None, None, None), (None, base, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(it):
    return collections.Counter(map(tuple, it))


def test_exact_dedup(docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r)
    want = []
    for text, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))[0]
        want += [(r[0], keep, len(members), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()) for r in members]
    assert counted(exact_dedup.exact_dedup(docs).collect()) == counted(want)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_survives_hash_collisions(docs, monkeypatch):
    want = counted(exact_dedup.exact_dedup(docs).collect())
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00000000000000000000000000000000"))
    assert counted(exact_dedup.exact_dedup(docs).collect()) == want


def test_ngram_join(docs, none):
    def shingle(t, k=4):
        w = (t or "").encode().translate(LOW).split()
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])

    sets = [(r[0], shingle(r[1])) for r in rows()]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[find(i)].append(a)
    want = counted((a, len(x), min(least[find(i)], default=None) if x else a) for i, (a, x) in enumerate(sets))
    assert counted(ngram_join.ngram_join(docs, size=4, percent=85).collect()) == want
    assert ngram_join.ngram_join(none).count() == 0


def reached(texts, k, percent):
    """Component of each text by comparing all pairs."""
    sets = [frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) for w in (t.split() for t in texts)]
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if label[i] != label[j] and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if c == b else c for c in label]
    return label


def test_ngram_join_finds_a_link_behind_nearer_sketches(spark):
    """One list of 19 sets holds a single link; each partner has three unlinked sets whose sketches are nearer."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    (_, _, w), *_ = ngram_join.K.hashed(ngram_join.pa.array([" ".join(words)]), ngram_join.K.BLANKS, True)
    token = dict(zip(words, (ngram_join.shingles(w, 1)[0] >> ngram_join.K.U(1)).tolist()))
    shared = min(words, key=token.get)
    rest = [x for x in words if x != shared]

    def distance(a, b):
        x, y = (ngram_join.np.frombuffer(ngram_join.parity_sketch(ngram_join.np.array([token[t] for t in s], dtype=ngram_join.K.U)), ngram_join.K.U) for s in (a, b))
        return int(ngram_join.np.bitwise_count(x ^ y).sum())

    def changed(of, n, want):
        while True:
            out = rng.sample([x for x in of if x != shared], len(of) - 1 - n) + [shared]
            out += rng.sample([x for x in rest if x not in of], n)
            if want(distance(of, out)):
                return out

    first = [shared, *rng.sample(rest, 99)]
    second = changed(first, 8, lambda d: d == 16)
    sets = [first, second, *[changed(x, 9, lambda d: d < 16) for x in (first, second) for _ in range(3)]]
    sets += [[shared, *rng.sample(rest, rng.randrange(86, 99))] for _ in range(11)]
    texts = [" ".join(x) for x in sets]
    assert reached(texts, 1, 85) == [0, 0, *range(2, 19)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 19), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs, size=1, percent=85).collect()}
    assert [got[i] for i in range(19)] == reached(texts, 1, 85)


@pytest.mark.parametrize("percent", [60, 85])
def test_ngram_join_of_hot_lists(spark, monkeypatch, percent):
    """Many sets over few words meet in long lists, which are cut into blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    rng = random.Random(percent)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(34)], rng.randrange(18, 26))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    out, links = ngram_join.ngram_join(docs, size=1, percent=percent, pairs=True)
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == reached(texts, 1, percent)
    assert links.count() >= len(texts) - len(set(got.values()))


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_light_sets_meet_when_linked(percent):
    import numpy as np

    rule = ngram_join.Rule(percent)
    rng = random.Random(percent)
    for _ in range(300):
        pool = [rng.randrange(1, 1 << 62) for _ in range(rng.randrange(1, 13))]
        a = np.unique(np.array(rng.sample(pool, rng.randrange(1, len(pool) + 1)), dtype=np.uint64))
        b = np.unique(np.array(rng.sample(pool, rng.randrange(1, len(pool) + 1)), dtype=np.uint64))
        common = len(np.intersect1d(a, b))
        linked = 100 * common >= percent * (len(a) + len(b) - common)
        for boundary in (0, 4, 8, 14):
            meet = bool(set(ngram_join._keys(a, rule, boundary).tolist()) & set(ngram_join._keys(b, rule, boundary).tolist()))
            assert meet or not linked
        assert ngram_join._near(np.frombuffer(ngram_join.parity_sketch(a), np.uint64), np.frombuffer(ngram_join.parity_sketch(b), np.uint64), len(a), len(b), rule) or not linked


def test_packing(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary())
    want = collections.Counter()
    for r in rows():
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 64 or 64
        at = [0, *range(cut, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))] += 1
    got = packing.pack(docs, queries.vocabulary(), tokens=64).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(none, queries.vocabulary()).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_capacity(score):
    rng = random.Random(1)
    counts = {n: rng.randrange(1, 40) for n in range(1, 65)}
    kinds = packing.plan_sequences(counts, 64, documents=5, attention=2600 + 64 * 64, score=score)
    used = collections.Counter()
    for times, kind in kinds:
        assert sum(kind) <= 64 and len(kind) <= 5 and sum(n * n for n in kind) <= 2600 + 64 * 64
        for n in kind:
            used[n] += times
    assert used == collections.Counter(counts)


@pytest.mark.parametrize("how", [{}, {"documents": 64, "attention": 64 * 64}, {"documents": 6}, {"attention": 64 * 64 + 300}])
@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_is_close_to_its_bound(score, how):
    """No plan can have fewer sequences than the fullest capacity asks for; ours has few more, but where the number of documents binds, as short pieces come last."""
    rng = random.Random(6)
    counts = collections.Counter(min(64, max(1, int(rng.lognormvariate(2.6, 0.9)))) for _ in range(4000))
    n = sum(times for times, _ in packing.plan_sequences(counts, 64, score=score, **how))
    total = lambda power: sum(length**power * c for length, c in counts.items())
    bound = max(-(-total(1) // 64), -(-total(0) // how.get("documents", 10**9)), -(-total(2) // how.get("attention", 10**9)))
    assert bound <= n <= bound * (1.1 if how.get("documents") == 6 else 1.01) + 1


def test_decontaminate(spark, docs, none, monkeypatch):
    items = [(1, ITEM), (2, "short piece"), (3, None), (4, "..."), (12, ITEM), (5, ITEM.replace("mu", "nu")), (6, "One"), (8, "x x x"), (9, "this is a line of"), (10, "Is a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for r in rows():
        w, hit, found = word(r[1]), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= ids
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert counted(decontam.decontaminate(docs, bench).collect()) == counted(want)
    monkeypatch.setattr(decontam, "FIRST_WORDS", 1)
    assert counted(decontam.decontaminate(docs, bench).collect()) == counted(want)
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_license_scan(docs, none):
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))
    want = []
    for r in rows():
        w = word(r[1])
        at = [(i, label) for phrase, label in license_scan.BASE.items() for k in [phrase.encode().split()] for i in range(len(w)) if w[i : i + len(k)] == k]
        want.append((r[0], len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = license_scan.license_scan(docs).collect()
    assert counted(tuple(r)[:6] for r in got) == counted(want)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got if r.base_labels)
    assert license_scan.license_scan(none).count() == 0


def test_license_notice_with_an_inserted_word(spark):
    words = license_scan.NOTICES["bsd-3-clause"].split()
    df = spark.createDataFrame([(1, " ".join([*words[:20], "inserted", *words[20:]])), (2, "redistribution and use")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert got[1].labels == "bsd-3-clause" and got[1].score > 0.8 and got[2].labels == ""


def test_license_texts_are_told_apart(spark):
    """Every notice, changed a little and among other words, gives its own label and place, twice if it stands twice."""
    rng = random.Random(9)
    made, want = [], {}
    for label, notice in license_scan.NOTICES.items():
        words = notice.split()
        changed = [w for i, w in enumerate(words) if i % 29 != 11 or len(words) < 20]
        head = sentence(rng, rng.randrange(3, 60))
        made.append((len(made), f"{head} {' '.join(changed)} {sentence(rng, 20)}"))
        want[len(made) - 1] = (label, len(re.findall("[a-z0-9ü]+", head.lower())))
    both = f"{license_scan.NOTICES['mpl']} {sentence(rng, 30)} {license_scan.NOTICES['lgpl']}"
    made += [(100, both), (100, both), (101, None), (102, ""), (103, " ".join(sentence(rng, 3) + " of the software" for _ in range(400)))]
    out, spans = license_scan.license_scan(spark.createDataFrame(made, "doc_id long, text string").repartition(3), spans=True)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(set(filter(None, r.labels.split(","))) - set(r.base_labels.split(",")))
    for i, (label, _) in want.items():
        assert got[i] == [{label} - {"apache", "gpl"}], label  # those are base labels as well
    assert got[100] == [{"mpl", "lgpl"}] * 2 and got[101] == got[102] == got[103] == [set()]
    starts = collections.defaultdict(set)
    for r in spans.collect():
        starts[r.doc_id, r.label].add(r.start)
    assert all(at in starts[i, label] for i, (label, at) in want.items())


def test_license_chains_do_not_drift(spark):
    """Grams of one notice that wander over the diagonals are no match, however near each is to the next."""
    words = license_scan.NOTICES["mpl"].split()
    text = " ".join(w for i in range(0, len(words) - 4, 2) for w in [*words[i : i + 4], "x"])
    far = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), notices={"mpl": " ".join(words)}, base={}).first()
    assert 0 < far.score < 1


def test_line_dedup(docs, none):
    from lodestar.llm.line_dedup import patience

    lines = lambda t: [tuple(x.encode().split()) for x in (t or "").split("\n")]
    own = {}
    for r in rows():
        own.setdefault((r[0] is None, r[0] or 0, r[1]), r)
    order = sorted((k for k in own if k[2]), key=lambda k: k[:2])
    held = collections.defaultdict(list)
    for k in order:
        for x in set(lines(k[2])):
            if len(x) >= 8:
                held[x].append(k)
    drop = collections.defaultdict(set)
    for x, ks in held.items():
        if len({k[:2] for k in ks}) < len(ks):
            continue  # ids that are taken twice are ordered by a hash
        for k in ks[1:]:
            drop[k] |= {j for _, j in patience(lines(ks[0][2]), lines(k[2])) if len(lines(k[2])[j]) >= 8}
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        key = (r.doc_id is None, r.doc_id or 0, r.text)
        if r.doc_id != 7:
            assert r.n_removed == len(drop[key]), r
            if r.n_removed == 0:
                assert r.kept_text == r.text
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_of_frequent_lines(spark):
    rng = random.Random(3)
    wide = "a line of more than eight words that very many documents hold"
    whole = "\n".join(sentence(rng, 10) for _ in range(4))
    made = [(i, f"{sentence(rng, 12)}\n{wide}" if i % 3 else whole) for i in range(180)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(5)).collect()}
    for i, t in made:
        lines = t.split("\n")
        assert got[i].kept_text == ("" if i % 3 == 0 and i else t if i in (0, 1) else lines[0]), i
        assert got[i].n_removed == (0 if i in (0, 1) else 1 if i % 3 else len(lines))


def test_line_dedup_of_short_lines(spark):
    verse = "One red stone\n\nby the river\n\nlies and waits\nfor the kite"
    long = "a line of at least eight words is here"
    texts = [verse, f"My own head\n{verse}\nmy own tail", verse, f"short start\n\n{long}\nshort end\nelse", f"short start\n\n{long}\nshort end\nother", f"short start\nby the river\n{long} too", "tiny", "tiny"]
    texts += [verse.replace("\n\n", "\n"), "x\ny\nx\n" + long, long + "\n" + long]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    kept = {1: "My own head\nmy own tail", 2: "", 4: "other", 7: "", 8: "", 9: "x\ny\nx"}
    assert {i: t for i, (_, t) in got.items() if i < 10} == {i: kept.get(i, t) for i, t in enumerate(texts) if i < 10}
    assert got[2][0] == 6 and got[10][0] >= 1


def test_line_dedup_aligns_lines_unique_in_neither():
    assert line_dedup.patience([1, 2, 1], [3, 1, 4, 1]) == [(0, 1), (2, 3)]


def test_rarity_does_not_change_what_line_dedup_removes(docs):
    pick = lambda **how: counted((r.doc_id, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs, **how).collect())
    assert pick(rare_share=0.0, rare_least=1) == pick()


def test_patience_is_a_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in "ab")
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        if a == b:
            assert len(pairs) == len(a)


def test_quality(spark, docs, none):
    rng = random.Random(2)
    made = [(i, sentence(rng, 60) if i % 2 else "BUY!! NOW!! " * 40, i % 2) for i in range(300)]
    df = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made if i < 200], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(df, labels).collect()}
    assert sum(got[i].predicted == y for i, _, y in made if i >= 200) >= 97
    assert quality.quality_filter(df, labels).count() == pytest.approx(150, abs=6)
    scored = quality.quality(docs, labels).collect()
    assert len(scored) == len(rows()) and all(0 <= r.score <= 1 for r in scored)
    assert all(abs(r.score - 0.5) < 0.01 for r in quality.quality(docs, labels.limit(0)).collect())
    assert quality.quality(none, labels).count() == 0


def test_isotonic_is_the_least_squares_fit():
    np, rng = quality.np, random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 25)
        raw, y = np.array(rng.sample(range(100), n), dtype=float), np.array([rng.randrange(2) for _ in range(n)], dtype=float)
        t = y[np.argsort(raw)]
        want = [max(min(t[i : k + 1].mean() for k in range(at, n)) for i in range(at + 1)) for at in range(n)]
        knots, values = quality.isotonic(raw, y)
        assert np.allclose(sorted(set(np.round(want, 9))), sorted(set(np.round(values, 9)))) and (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()


def test_ridge_is_summed_over_partitions(spark, monkeypatch):
    """The weights of the fit against one solution over all rows, and the waves against the kernel they stand for."""
    np = quality.np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, quality.STATS)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(500)], "id long, x array<float>, y double").repartition(6)
    model = quality.fit(df, quality.Tables(spark, "test"))
    fit_on = [r.id for r in df.where(F.pmod(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)), F.lit(5)) != 0).collect()]
    part = x[fit_on].astype(float)
    assert np.allclose(model.mean, part.mean(axis=0)) and np.allclose(model.scale, part.std(axis=0))
    z, d = model.waves(part), quality.WAVES + 1
    a = z.T @ z
    want = np.linalg.solve(a + quality.RIDGE * a.trace() / d * np.eye(d), z.T @ y[fit_on])
    assert np.allclose(z @ model.weight, z @ want, atol=1e-4)
    u = (part - model.mean) / model.scale
    kernel = np.exp(-((u[:60, None] - u[None, :60]) ** 2).sum(axis=2) / (2 * quality.STATS))
    assert np.abs(z[:60, :-1] @ z[:60, :-1].T - kernel).mean() < 0.06


def test_quality_of_repeated_and_empty_rows(spark):
    rng = random.Random(3)
    made = [(i % 50, sentence(rng, 30) if i % 2 else "!!! " * 30) for i in range(200)] + [(7, None), (7, None), (None, ""), (None, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2 + [(3, 0), (None, 1)], "doc_id long, quality int")
    got = [(r.doc_id, r.score, r.predicted) for r in quality.quality(spark.createDataFrame(made, "doc_id long, text string").repartition(4), labels).collect()]
    assert len(got) == len(made) and all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in got)
    assert len({s for d, s, _ in got if d is None}) == 1


def test_chat_round_trip(spark):
    probe = queries.PROBE
    made = [(1, 1, "assistant", "b\\|<\\|"), (1, 0, "us\ner<|", None), (1, 0, "a", "tie"), (2, None, None, probe), (None, 0, "assistant", probe), (2, 5, "assistant", probe), (2, 5, "assistant", probe)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    for c in (1, 2, None):
        turns = sorted(((t is not None, t, r or "", x or "") for i, t, r, x in made if i == c), key=lambda k: (k[0], k[1] or 0, k[2], k[3]))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digest(chat_format.format_chats(df.limit(0))).count() == 0


def test_template_language():
    render = chat_format.compile_template("{% for m in messages %}{% if m.role == 'a' and not m.off %}{% generation %}{{ m.text | upper }}{% endgeneration %}{% elif m.role == 'b' %}B{% else %}-{% endif %}{% endfor %}")
    assert render([{"role": "a", "text": "x"}, {"role": "b"}, {"role": "a", "off": True}]) == ("XB-", [(0, 1)])
    folded = chat_format.fold(chat_format.parse("a{{ 'b' | upper }}c{% if 'x' == 'x' %}d{% else %}e{% endif %}"))
    assert [(p.kind, p.value) for p in folded.parts] == [("text", "aBcd")]
    for bad in ("{% for %}", "{% if x %}", "{{ x | system }}", "{% import os %}", "{{ x.__class__() }}", "{{ }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.parse(bad)


def test_html_extract(spark):
    page = lambda k: f"<html><head><title>t{k}</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head {k}</h1><p>First &amp; <b>bo</b>ld {k}<p>Second<br>line {k}<ul><li>a<li>b</ul><script>var x='</p>'</script><div class='share-bar'>Share this</div></article><div class=comments><p>nice</p></div><footer>foot {k}</footer></body></html>"
    made = [(k, f"http://h.example/{k}", page(k)) for k in range(12)] + [(20, None, page(20)), (21, "not a url", None), (22, "http://h.example/x", "<p>plain <"), (0, "http://h.example/0", page(0)), (None, "http://h.example/0", "")]
    df = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got, rules = html_extract.extract(df, wrappers=True)
    rows_ = got.collect()
    assert len(rows_) == len(made)
    for r in rows_:
        if r.page_id is not None and r.page_id <= 20:
            assert r.text == f"Head {r.page_id} First & bold {r.page_id} Second line {r.page_id} a b"
        assert r.n_chars == len(r.text)
    assert "#TEXT" in rules.where("host = 'h.example'").first().rule
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_blocks_that_few_pages_vary(spark):
    made = [(k, f"http://h.example/{k}", f"<article><div class=lead>{'Real lead' if k == 33 else 'Read more'}</div><div class=same>Always</div><p>Text {k}</p></article>") for k in range(40)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(made, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {k: f"{'Real lead' if k == 33 else 'Read more'} Text {k}" for k in range(40)}


@pytest.mark.parametrize(
    "source, text",
    [
        ('<article class="post has-sidebar"><p>A b</p></article>', "A b"),
        ('<body class="no-sidebar search-page"><p>x</p></body>', "x"),
        ('<div id="social-science"><p>y</p></div>', "y"),
        ('<div class="site-footer">f</div><div id=comments-2>c</div><div class="side main-menu">m</div>z', "z"),
        ("<article><p>a<img alt=don't src=x> b</p></article>", "a b"),
        ('<article><a href="x>one</a> <p class="y">two</p></article>', "two"),
        ('<article><a href="x>one</a> two</article>', "one two"),
        ('<p title="class=nav" data-id=nav>t</p>', "t"),
        ('<article><h1>T</h1><article class="comment">bad</article>ok</article>', "T ok"),
        ('<p hidden>h</p><p hidden="until-found">u</p><p style="display: none">n</p>q', "u q"),
        ("<div>" * 5000 + "deep<nav>menu</nav> tail", "deep tail"),
        ("<b><p>" * 5000 + "x", "x"),
        ('a < b <a "', 'a < b <a "'),
    ],
)
def test_html_of_odd_pages(source, text):
    assert html_extract.read(source, None) == text
    piece = html_extract.wrapper_of(html_extract.parse(source))
    rule = html_extract.rule_of(html_extract.generalise(piece, html_extract.wrapper_of(html_extract.parse("<div>" * 700 + "x"))), 5)
    assert len(rule["shape"]) > 4


def test_html_deep_pages_of_a_host(spark):
    made = [(k, "http://deep.example/", f"{'<div>' * 5000}text {k}") for k in range(6)] + [(9, "http://deep.example/", f"<div class='content has-sidebar'><p>{'<i>' * 3000}text 9")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(made, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: f"text {k}" for k in (*range(6), 9)}


def test_html_against_pages_made_from_their_texts(spark):
    """Pages of several layouts are written around known blocks; what is read back must be those blocks."""
    rng = random.Random(4)
    made, want = [], []
    for k in range(160):
        blocks = [sentence(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 7))]
        tags = [rng.choice(["p", "h2", "blockquote", "div", "pre"]) for _ in blocks]
        body = "".join(f"<{t}>{' '.join(f'<b>{w}</b>' if rng.random() < 0.1 else w.replace(',', '&#44;') for w in x.split())}</{t}>{rng.choice(['', ' ', '<!-- p -->', '<script>1<2</script>'])}" for t, x in zip(tags, blocks))
        menu, foot = "".join(f"<li><a href=/{i}>go {i}" for i in range(rng.randrange(2, 6))), sentence(rng, 6)
        host = k % 4
        if host == 0:
            page = f"<header>top</header><nav><ul>{menu}</ul></nav><article>{body}</article><footer>{foot}</footer>"
        elif host == 1:
            page = f"<div class='wrap'><div class='menu'>{menu}</div><div class='content' id=post-{k}>{body}</div><aside>{foot}</aside></div>"
        elif host == 2:
            page = f"<main><div class='share buttons'>Share</div>{body}</main><div id=comments><p>{foot}</p></div>"
        else:
            page = f"<table><tr><td class=sidebar>{menu}<td class=text>{body}</table><form><p>{foot}<input></form>"
        made.append((k, f"https://h{host}.example/{k}", f"<!DOCTYPE html><html><head><title>{foot}</title></head><body>{page}</body></html>"))
        want.append((k, " ".join(blocks)))
    got = html_extract.extract(spark.createDataFrame(made, "page_id long, url string, html string").repartition(5)).select("page_id", "text").collect()
    assert sorted(map(tuple, got)) == want


def test_packed_wrapper_is_the_same():
    piece = html_extract.wrapper_of(html_extract.parse("<div>a<p>x</p><p>y</p><ul id=u><li>z</ul></div><i>b"))
    assert html_extract.show(html_extract.unpacked(html_extract.packed(piece))) == html_extract.show(piece)


def test_wrapper_generalises_to_optional_and_repeated():
    a, b = (html_extract.wrapper_of(html_extract.parse(s)) for s in ("<div><p>x</p><p>y</p><i>z</i></div>", "<div><p>x</p><u>w</u></div>"))
    assert html_extract.show(html_extract.generalise(a, b).kids[0]) == "<div>(<p>#TEXT</p>)+(<i>z</i>)?(<u>w</u>)?</div>"


@pytest.mark.parametrize("window, group", [(35, 1), (35, 3), (12, 2), (9, 5)])
def test_substring_with_longer_prefixes(spark, docs, monkeypatch, window, group):
    """Prefixes that more than `group` suffixes share are made longer, which changes nothing."""
    rng = random.Random(window)
    cut = sentence(rng, 300).split()
    made = [(i, " ".join(cut[rng.randrange(250) :][: rng.randrange(20, 60)] + sentence(rng, 5).split()), *[None] * 7) for i in range(100, 130)]
    table = docs.unionByName(spark.createDataFrame(made, SCHEMA)).repartition(5)
    pick = lambda: counted(tuple(r)[:4] for r in substring.repeated_words(table, window).collect())
    want = pick()
    monkeypatch.setattr(substring, "GROUP", group)
    assert pick() == want


def test_depths_are_the_longest_repeats():
    rng = random.Random(2)
    text = [[rng.randrange(3) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    flat, bounds = [x for t in text for x in t], [0]
    for t in text:
        bounds.append(bounds[-1] + len(t))
    suffixes = [t[i:] for t in text for i in range(len(t))]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [max(common(a, b) for j, b in enumerate(suffixes) if i != j) for i, a in enumerate(suffixes)]
    got = substring.depths(substring.np.array(flat, dtype=substring.np.uint64), substring.np.array(bounds))
    assert got.tolist() == want


@pytest.mark.parametrize("window", [1, 5, 35])
def test_substring(docs, none, window):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows()]
    seen = collections.Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    want = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = substring.repeated_words(docs, window, texts=True).collect()
    assert counted(tuple(r)[:4] for r in got) == counted(want)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring.repeated_words(none, window).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    texts = [sentence(rng, 60) for _ in range(40)]
    texts += ["BUY!! NOW!! " * 30] * 20 + [texts[0].replace("red", "rad", 1), ITEM + " " + sentence(rng, 50), texts[1]]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0 if "BUY" in t else 1, 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(40))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "decontaminate", "best_fit_packing"]
    none = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def plain_pipeline(spark, rows_, labels, items):
    """(id, text) of the rows that all stages keep, with every step written out over lists."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "n long, doc_id long, text string")
    kept = [tuple(r) for r in quality.quality_filter(frame.select("doc_id", "text"), labels).collect()]
    # line dedup: equal documents go but for the first; each line's later holders lose what they have in common with the first
    key = {r: (r[0] is None, r[0] or 0, spark.createDataFrame([r], "doc_id long, text string").select(F.xxhash64("doc_id", "text")).first()[0]) for r in set(kept)}
    lines = {r: line_dedup._lines(r[1] or "") for r in key}
    hashes = {r: line_dedup._hashes(p).view("int64").tolist() for r, (_, p) in lines.items()}
    first_of = {}
    for r in sorted(key, key=key.get):
        if any(lines[r][1]):
            first_of.setdefault(tuple(lines[r][1]), r)
    gone = {r for r in key if any(lines[r][1]) and first_of[tuple(lines[r][1])] != r}
    holders = collections.defaultdict(list)
    for r in sorted(set(key) - gone, key=key.get):
        if r[1]:
            for h in line_dedup._starts(line_dedup._hashes(lines[r][1]), line_dedup.word_counts(lines[r][1]), 8).tolist():
                holders[h].append(r)
    drop = collections.defaultdict(set)
    for held in holders.values():
        for later in held[1:]:
            words = line_dedup.word_counts(lines[later][1])
            for i, j in line_dedup.blocks(hashes[held[0]], hashes[later]):
                if sum(words[i:j]) >= 8:
                    drop[later] |= set(range(i, j))
    cut = lambda r: "" if r in gone else "\n".join(x for k, x in enumerate(lines[r][0]) if k not in drop[r]) if drop[r] else r[1]
    kept = [(r[0], cut(r)) for r in kept if (r not in gone and not drop[r]) or cut(r).strip()]
    # near copies: the row with the least id of each component of linked rows, and one of equal rows
    words = [(t or "").encode().translate(LOW).split() for _, t in kept]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for w in words]
    label = list(range(len(kept)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and label[i] != label[j] and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if c == b else c for c in label]
    best = {}
    for i, (d, t) in enumerate(kept):
        rank = (d is None, d or 0, spark.createDataFrame([(d, t)], "doc_id long, text string").select(F.xxhash64("doc_id", "text")).first()[0])
        if label[i] not in best or rank < best[label[i]][0]:
            best[label[i]] = (rank, i)
    kept = [r for i, r in enumerate(kept) if sets[i] is None or best[label[i]][1] == i]
    # decontamination
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))
    windows = {tuple(w[i : i + 10]) for w in map(word, items) for i in range(max(1, len(w) - 9) if w else 0)}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    return [r for r in kept if clean(word(r[1]))]


def test_pipeline_against_its_stages_written_out(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(12)
    base = [sentence(rng, 60) for _ in range(30)]
    line = "this is a shared line of well over eight words"
    made = list(enumerate(base))
    made += [(40 + i, "BUY!! NOW!! " * 30) for i in range(12)]
    made += [(60, base[0].replace("red", "rad", 1)), (61, base[1]), (62, f"{sentence(rng, 40)}\n{line}"), (63, f"{sentence(rng, 40)}\n{line}\n{sentence(rng, 20)}"), (64, ITEM + " " + sentence(rng, 50))]
    made += [(5, sentence(rng, 55)), (5, base[6]), (3, base[3]), (None, sentence(rng, 44)), (None, base[7].replace("blue", "bleu", 1)), (None, None), (70, ""), (71, " ")]
    labels = [(i, 0 if 40 <= i < 60 else 1, 0) for i, _ in made if i is not None and i not in (5, 70, 71)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in made], "doc_id long, text string, lang string, source string, n_chars long, row_key string").repartition(4)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole = Tokenizer.from_file(queries.vocabulary())
    want = collections.Counter()
    left = plain_pipeline(spark, made, spark.read.parquet(str(tmp_path / "labels.parquet")), [ITEM])
    assert 20 < len(left) < len(made) - 12
    for i, t in left:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, 0, 0, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    total = sum(n * k[3] for k, n in want.items())
    assert len({r.sequence_id for r in got}) <= -(-total // 1024) + 1
    kept = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == d.columns


def test_tables_are_deleted_and_folders_checked(spark, docs, tmp_path, monkeypatch):
    import os

    from lodestar.llm import _cluster as C

    folder = f"{C.shared_folder(spark).removeprefix('file:')}/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with C.sweeping(spark):
        out = ngram_join.ngram_join(docs, size=4, percent=85)
        made = set(os.listdir(folder)) - before
        assert len(made) == 2 and out.count() == len(rows())
    assert set(os.listdir(folder)) - before == set()

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        C.shared_folder(Session())
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, "1000000")
    C.small_batches(spark)
    assert spark.conf.get(name) == "1000000"
    spark.conf.set(name, kept)
