"""Batched hybrid retrieval: seeds, graph expansion, four signals, adaptive weights, and the arithmetic of every score.

queries: query_id, v, and optionally range_start, range_end, cue, formats (array), entities (array), query_norm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from . import vectors as V
from .cluster import settled, settled_from

WEIGHTS = {"semantic": 0.45, "graph": 0.20, "activity": 0.20, "timeline": 0.15}
ALWAYS = ("semantic", "entity", "structural", "duplicate")
FORMAT_BOOST, FORMAT_PENALTY = 1.15, 0.70
FEEDBACK_MOST = 0.15
SEEDS, EXPANDED, TOP = 10, 400, 10
#: The configurations of the ablation by the signals they use; the baseline uses none and is the flat search.
CONFIGURATIONS = {"baseline": (), "semantic_only": ("semantic",), "semantic_graph": ("semantic", "graph"), "semantic_graph_timeline": ("semantic", "graph", "timeline"), "semantic_graph_activity": ("semantic", "graph", "activity"), "full": ("semantic", "graph", "activity", "timeline")}


def allowed_types(signals: tuple[str, ...]) -> list[str]:
    return [*ALWAYS, *(["activity", "edited_before"] if "activity" in signals else []), *(["temporal"] if "timeline" in signals else [])]


def shares(signals: tuple[str, ...], dated: Column, cued: Column, weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Each signal's weight for a query: timeline needs a range, activity a cue; the rest share their part."""
    w = weights or WEIGHTS
    on = {s: F.lit(s in signals) & (dated if s == "timeline" else cued if s == "activity" else F.lit(True)) for s in w}
    part = {s: F.when(on[s], F.lit(w[s])).otherwise(0.0) for s in w}
    total = sum(part.values(), F.lit(0.0))
    return {s: F.when(total > 0, part[s] / total).otherwise(1.0 if s == "semantic" else 0.0) for s in w}


def semantic_seeds(sims: DataFrame, k: int = SEEDS) -> DataFrame:
    """(query_id, file_id): the k best files with a positive similarity."""
    return V.top_k(sims.where("sim > 0"), k).select("query_id", F.col("doc_id").alias("file_id"))


def entity_seeds(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, file_id) of files with an entity equal to a query's, or that holds one of more than three letters.

    Equal names join by name; containing ones meet over the entity's words, so the two tables are never crossed.
    """
    q = queries.select("query_id", F.explode("entities").alias("name")).select("query_id", F.lower("name").alias("q"))
    e = postings.select("file_id", F.lower("normalised").alias("e")).distinct()
    same = q.join(e, F.col("q") == F.col("e")).select("query_id", "file_id")
    gram = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substring(c, i, F.lit(4)))
    long = q.where(F.length("q") > 3).withColumn("g", F.substring("q", 1, 4))
    cells = e.where(F.length("e") > 3).withColumn("g", F.explode(F.array_distinct(gram(F.col("e")))))
    inside = long.join(cells, "g").where(F.contains("e", F.col("q"))).select("query_id", "file_id")
    return same.union(inside).distinct()


def timeline_scores(queries: DataFrame, timeline: DataFrame) -> DataFrame:
    """(query_id, file_id, timeline): the best score of a file's days inside the query's range, at most 1."""
    from ..functions.timeline import stab

    r = queries.where("range_start IS NOT NULL").select("query_id", F.col("range_start").alias("start"), F.col("range_end").alias("end"))
    return stab(timeline, r).groupBy("query_id", "file_id").agg(F.least(F.lit(1.0), F.max("score")).alias("timeline"))


def range_scores(queries: DataFrame, timeline: DataFrame) -> DataFrame:
    """(range_start, range_end, file_id, timeline): timeline_scores by range, whatever the number of queries that ask for it."""
    from ..functions.timeline import stab

    r = queries.where("range_start IS NOT NULL").select(F.col("range_start").alias("start"), F.col("range_end").alias("end")).distinct()
    return stab(timeline, r).groupBy(F.col("start").alias("range_start"), F.col("end").alias("range_end"), "file_id").agg(F.least(F.lit(1.0), F.max("score")).alias("timeline"))


def activity_scores(queries: DataFrame, members: DataFrame, seeds: DataFrame, cue_gain: float = 0.4) -> DataFrame:
    """(query_id, file_id, activity): files of sessions that hold a seed, by the share of it that is seeded."""
    seeded = seeds.join(members, "file_id").groupBy("query_id", "session_id").agg(F.countDistinct("file_id").alias("seeded"))
    s = _session_scores(queries, members, seeded, cue_gain)
    return s.join(members, "session_id").groupBy("query_id", "file_id").agg(F.max("activity").alias("activity"))


def _session_scores(queries: DataFrame, members: DataFrame, seeded: DataFrame, cue_gain: float = 0.4) -> DataFrame:
    """(query_id, session_id, activity) of sessions of which a query seeds some files (query_id, session_id, seeded)."""
    size = members.groupBy("session_id").agg(F.countDistinct("file_id").alias("size"))
    s = seeded.join(size, "session_id").join(queries.select("query_id", F.coalesce("cue", F.lit(0.0)).alias("cue")), "query_id")
    activity = F.least(F.lit(1.0), (0.5 + 0.5 * F.least(F.lit(1.0), F.col("seeded") / F.col("size"))) * (1 + cue_gain * F.col("cue")))
    return s.select("query_id", "session_id", activity.alias("activity"))


def feedback_boost(score: Column, net: Column, most: float = FEEDBACK_MOST) -> Column:
    """A score moved by at most `most`, the more the larger the net feedback; never below 0."""
    return F.greatest(F.lit(0.0), score + F.when(net.isNull(), 0.0).otherwise(most * net / (1 + F.abs(net))))


def format_factor(path: Column, formats: Column) -> Column:
    fits = F.exists(formats, lambda x: F.endswith(F.lower(path), x))
    return F.when(formats.isNull() | (F.size(formats) == 0), 1.0).when(fits, FORMAT_BOOST).otherwise(FORMAT_PENALTY)


def _of_range(dated: DataFrame, rows: DataFrame, cap: int | None) -> DataFrame:
    """(query_id, node): nodes of each query's range (range_start, range_end, node); with a cap, only the first by name, as
    vertices at hop 0 are taken by name and no more than cap of them."""
    if cap is not None:
        rows = G.first(rows, ["range_start", "range_end"], ["node"], cap)
    return dated.join(rows, ["range_start", "range_end"]).select("query_id", "node")


def _range_edges(edges: DataFrame, found: DataFrame, times: DataFrame) -> DataFrame:
    """(query_id, node, weight, via): the heaviest edge between what was found (query_id, node, range_start, range_end) and a
    file with a day in the range, and its type."""
    span = ["range_start", "range_end"]
    ends = times.select(*span, G.file_node(F.col("file_id")).alias("dst"))
    hit = found.join(edges.withColumnRenamed("src", "node"), "node").join(ends, [*span, "dst"])
    best = hit.groupBy("query_id", "node").agg(F.min(F.struct((-F.col("weight")).alias("less"), "type")).alias("e"))
    return best.select("query_id", "node", (-F.col("e.less")).alias("weight"), F.col("e.type").alias("via"))


def _seeded(members: DataFrame, seed: DataFrame, dated: DataFrame, times: DataFrame | None) -> DataFrame:
    """(query_id, session_id, seeded): files of a session that are seeds of a query: seed (query_id, file_id), and times of its range."""
    count = F.countDistinct("file_id").alias("seeded")
    if times is None:
        return seed.join(members, "file_id").groupBy("query_id", "session_id").agg(count)
    span = ["range_start", "range_end"]
    within = times.join(members, "file_id").groupBy(*span, "session_id").agg(count)
    alone = seed.join(dated, "query_id", "left").join(times, [*span, "file_id"], "left_anti")
    alone = alone.join(members, "file_id").groupBy("query_id", "session_id").agg(count)
    return dated.join(within, span).select("query_id", "session_id", "seeded").union(alone).groupBy("query_id", "session_id").agg(F.sum("seeded").alias("seeded"))


def retrieve(queries: DataFrame, docs: DataFrame, edges: DataFrame, files: DataFrame | None = None, postings: DataFrame | None = None, timeline: DataFrame | None = None, members: DataFrame | None = None, feedback: DataFrame | None = None, signals: tuple[str, ...] = tuple(WEIGHTS), seeds: int = SEEDS, expanded: int | None = EXPANDED, top: int = TOP, weights: dict | None = None, sims: DataFrame | None = None) -> DataFrame:
    """Ranked results of a batch of queries, with signals, weights and contributions as columns.

    docs: doc_id, v. edges between 'file:<id>' and 'session:<n>' nodes. files: file_id, path. postings: file_id, normalised.
    timeline: file_id, day, score. members: session_id, file_id. feedback: query_norm, file_id, net. What is absent adds nothing.
    sims: query_id, doc_id, sim of each query's best docs, `seeds` of them at least, where the caller has them already.
    """
    for name, kind in (("range_start", "date"), ("range_end", "date"), ("cue", "double"), ("formats", "array<string>"), ("entities", "array<string>"), ("query_norm", "string")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    types = allowed_types(signals)
    edges = settled(edges.where(F.col("type").isin(types)), "retrieval-edges")

    def seeded():
        near = sims if sims is not None else V.similarities(queries.select("query_id", "v"), docs.select("doc_id", "v"), seeds)
        best = semantic_seeds(near, seeds)
        return (best if postings is None else best.union(entity_seeds(queries.where("entities IS NOT NULL"), postings))).distinct()

    seed = settled_from(seeded, "retrieval-seeds")
    nodes = seed.select("query_id", G.file_node(F.col("file_id")).alias("node"))

    # Files with a day in a query's range are seeds too. They are many and the same for all queries of a range, so they are
    # kept by range; of each range only as many start as can be found.
    span = ["range_start", "range_end"]
    dated = queries.where("range_start IS NOT NULL").select("query_id", *span)
    times = settled(range_scores(queries, timeline), "retrieval-times") if timeline is not None else None
    session = lambda rows, *by: rows.join(members, "file_id").select(*by, G.session_node(F.col("session_id")).alias("node")).distinct()
    start = nodes
    if times is not None:
        start = start.union(_of_range(dated, times.select(*span, G.file_node(F.col("file_id")).alias("node")), expanded))
    if members is not None and "activity" in signals:
        start = start.union(session(seed, "query_id"))
        if times is not None:
            start = start.union(_of_range(dated, session(times, *span), expanded))
    file_id = lambda c: F.expr(f"try_cast(substring({c}, 6, 20) AS BIGINT)")
    reach = lambda: G.two_hops(edges, start, types, expanded).where(F.startswith("node", F.lit("file:")))
    found = settled_from(lambda: reach().select("query_id", file_id("node").alias("file_id"), "hop", "node"), "retrieval-found")

    # similarities of what was reached only; documents come first, as a batch of queries can mostly be sent to all tasks
    asked = queries.select("query_id", F.col("v").alias("qv"))
    asked = F.broadcast(asked) if asked.limit(V.QUERY_BLOCK + 1).count() <= V.QUERY_BLOCK else asked
    of = found.drop("node").join(docs.select(F.col("doc_id").alias("file_id"), F.col("v").alias("dv")), "file_id", "left").join(asked, "query_id")
    out = of.withColumn("sim", V.dot(F.col("qv"), F.col("dv"))).drop("qv", "dv")
    out = out.join(seed.withColumn("seed", F.lit(True)), ["query_id", "file_id"], "left").join(queries.drop("v"), "query_id")
    near = G.best_seed_edge(edges, nodes, types)
    if times is not None:
        out = out.join(times, [*span, "file_id"], "left").withColumn("seed", F.when(F.col("seed") | F.col("timeline").isNotNull(), True))
        near = near.union(_range_edges(edges, found.select("query_id", "node").join(dated, "query_id"), times))
        near = near.groupBy("query_id", "node").agg(F.min(F.struct((-F.col("weight")).alias("less"), "via")).alias("e")).select("query_id", "node", (-F.col("e.less")).alias("weight"), "e.via")
    else:
        out = out.withColumn("timeline", F.lit(0.0))
    near = near.select("query_id", file_id("node").alias("file_id"), F.col("weight").alias("near"), "via").where("file_id IS NOT NULL")
    out = out.join(near, ["query_id", "file_id"], "left")
    if members is not None:
        held = _session_scores(queries, members, _seeded(members, seed, dated, times))
        activity = found.select("query_id", "file_id").join(members, "file_id").join(held, ["query_id", "session_id"]).groupBy("query_id", "file_id").agg(F.max("activity").alias("activity"))
        out = out.join(activity, ["query_id", "file_id"], "left")
    else:
        out = out.withColumn("activity", F.lit(0.0))
    out = out.join(files.select("file_id", "path"), "file_id", "left") if files is not None else out.withColumn("path", F.lit(None).cast("string"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    signal = {
        "semantic": F.greatest(F.lit(0.0), zero("sim")),
        "graph": F.when(F.col("seed"), 1.0).otherwise(zero("near")),
        "activity": zero("activity"),
        "timeline": zero("timeline"),
    }
    share = shares(signals, F.col("range_start").isNotNull(), zero("cue") > 0, weights)
    out = out.withColumns({f"s_{k}": v for k, v in signal.items()} | {f"w_{k}": v for k, v in share.items()})
    out = out.withColumns({f"c_{k}": F.col(f"w_{k}") * F.col(f"s_{k}") for k in WEIGHTS})
    base = sum((F.col(f"c_{k}") for k in WEIGHTS), F.lit(0.0))
    out = out.withColumn("score", F.least(F.lit(1.0), base * format_factor(F.coalesce("path", F.lit("")), F.col("formats")))).where("score > 0")
    if feedback is not None:
        out = out.join(feedback.select("query_norm", "file_id", "net"), ["query_norm", "file_id"], "left").withColumn("score", feedback_boost(F.col("score"), F.col("net")))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "file_id"))).where(F.col("rank") <= top)
    return out


def details(queries: DataFrame, results: DataFrame, keywords: DataFrame, postings: DataFrame, members: DataFrame, sessions: DataFrame, timeline: DataFrame) -> DataFrame:
    """(query_id, file_id, topics, shared, session, days) of results: keywords that are a query's terms, entities that it
    names, the session with its size, and days inside its range, each in a fixed order.

    queries: query_id, terms, entities, range_start, range_end.
    """
    own = results.select("query_id", "file_id").distinct()
    listed = lambda rows, order, value, name: rows.groupBy("query_id", "file_id").agg(F.transform(F.sort_array(F.collect_set(F.struct(*order, F.col(value).cast("string").alias("said")))), lambda x: x["said"]).alias(name))
    terms = queries.select("query_id", F.explode("terms").alias("term")).distinct()
    topics = listed(own.join(keywords.select("file_id", "term", "rank"), "file_id").join(terms, ["query_id", "term"]), ["rank"], "term", "topics")
    names = queries.select("query_id", F.explode("entities").alias("name")).select("query_id", F.lower("name").alias("low")).distinct()
    shared = listed(own.join(postings.select("file_id", "normalised", F.lower("normalised").alias("low")), "file_id").join(names, ["query_id", "low"]), [], "normalised", "shared")
    held = own.join(members.select("file_id", "session_id"), "file_id").join(sessions.select("session_id", "label", "size"), "session_id")
    held = held.groupBy("query_id", "file_id").agg(F.min(F.concat("label", F.lit(", "), F.col("size").cast("string"), F.lit(" files"))).alias("session"))
    ranges = queries.where("range_start IS NOT NULL").select("query_id", "range_start", "range_end")
    days = listed(own.join(ranges, "query_id").join(timeline.select("file_id", "day"), "file_id").where("day BETWEEN range_start AND range_end"), ["day"], "day", "days")
    for part in (topics, shared, held, days):
        own = own.join(part, ["query_id", "file_id"], "left")
    return own


def explain(results: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """results with signals, weights and contributions as maps, the dominant signal, the reasons, and whether all are there.

    Reasons come in a fixed order: topic, entities, graph, session, timeline, format, feedback. With `more` (see details)
    they say which words (5), entities (5), session and days (3).
    """
    def table(prefix):
        return F.map_from_arrays(F.array(*[F.lit(k) for k in WEIGHTS]), F.array(*[F.col(f"{prefix}_{k}") for k in WEIGHTS]))

    extra = ("topics", "shared", "session", "days")
    if more is not None:
        results = results.join(more, ["query_id", "file_id"], "left")
    else:
        results = results.withColumns({k: F.lit(None).cast("string" if k == "session" else "array<string>") for k in extra})
    best = F.array_max(F.array(*[F.struct(F.col(f"c_{k}").alias("c"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(WEIGHTS)]))
    some = lambda c, n: F.when(F.size(c) > 0, F.concat(F.lit(": "), F.array_join(F.slice(c, 1, n), ", "))).otherwise("")
    moved = F.col("net") if more is not None and "net" in results.columns else F.lit(None).cast("double")
    reasons = F.array_compact(F.array(
        F.when(F.col("s_semantic") > 0, F.concat(F.lit("similar text ("), F.format_number(F.col("s_semantic"), 2), F.lit(")"), some("topics", 5))),
        F.when(F.size("shared") > 0, F.concat(F.lit("names the same"), some("shared", 5))),
        F.when(F.col("seed"), F.lit("a direct match")).when(F.col("s_graph") > 0, F.concat(F.lit("linked to a match"), F.coalesce(F.concat(F.lit(" by a "), "via", F.lit(" edge")), F.lit("")))),
        F.when(F.col("s_activity") > 0, F.concat(F.lit("from the same session"), F.coalesce(F.concat(F.lit(": "), "session"), F.lit("")))),
        F.when(F.col("s_timeline") > 0, F.concat(F.lit("has a date in range"), some("days", 3))),
        F.when(F.size(F.coalesce("formats", F.array().cast("array<string>"))) > 0, F.lit("kind of file considered")),
        F.when(moved > 0, "picked before").when(moved < 0, "rejected before"),
    ))
    out = results.withColumns({"signals": table("s"), "weights": table("w"), "contributions": table("c"), "dominant": F.when(best["c"] > 0, best["k"]), "reasons": reasons})
    return out.withColumn("complete", (F.size("reasons") > 0) & (F.size("signals") > 0) & (F.size("contributions") > 0)).drop(*extra)


def baseline(queries: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """Flat nearest neighbours, whatever their sign."""
    return V.knn(queries, docs, top)


def ablation(queries: DataFrame, docs: DataFrame, run, top: int = TOP) -> DataFrame:
    """(configuration, query_id, file_id, rank, score) of every configuration; the baseline is the flat search.

    run(signals, sims) gives the results of a set of signals; sims (query_id, doc_id, sim, rank) is the flat search's result,
    which all configurations share. Each one's results are stored and its other tables go before the next begins.
    """
    from functools import reduce

    sims = settled_from(lambda: baseline(queries.select("query_id", "v"), docs, top), "ablation-sims")
    columns = ("query_id", "file_id", "rank", "score")
    flat = sims.select("query_id", F.col("doc_id").alias("file_id"), "rank", F.col("sim").alias("score"))
    found = {name: settled_from(lambda signals=signals: run(signals, sims).select(*columns), f"ablation-{name}") if signals else flat for name, signals in CONFIGURATIONS.items()}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("configuration"), *columns) for name, rows in found.items()])
