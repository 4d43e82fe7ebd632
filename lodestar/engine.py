"""One object over a folder of stored tables: index a tree, ask it, and report on it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Config
from .functions import dates, decompose, text, timeline
from .operators import blocks, entities, graph, insights, retrieval, sessions, store, tree
from .operators import vectors as vec
from .operators.cluster import settled
from .sources import extract, files


class Engine:
    """Tables live in `data`, a new numbered snapshot for each write; the tree below `root` is only read."""

    def __init__(self, spark: SparkSession, data: str, config: Config | None = None):
        self.spark, self.data, self.config = spark, data.rstrip("/"), config or Config()

    def table(self, name: str) -> DataFrame:
        return schemas.read(self.spark, self.data, name)

    def _version(self) -> int:
        v = self.table("meta").where("key = 'version'").select(F.max(F.col("value").cast("int"))).first()[0]
        return (v or 0) + 1

    def index(self, root: str, full: bool = False, rehash: bool = False, dry_run: bool = False, now: dt.datetime | None = None) -> DataFrame:
        """Bring all tables up to date with a tree; the changes found. Only new and modified files are read again."""
        c, at = self.config, (now or dt.datetime.now()).isoformat(sep=" ", timespec="seconds")
        known = self.table("files")
        seen, diff = files.scan(self.spark, root, known.where("status = 'present'"), c.scan.max_bytes, c.scan.ignore_dirs, c.scan.ignore_globs, full, rehash)
        if dry_run:
            return diff
        v = self._version()
        rows = store.upsert_files(known.select("path", "size", "mtime", "content_hash", "status", "first_seen", "last_seen", "content_changed_at"), seen.select("path", "size", "mtime", "content_hash"), at)
        rows = store.describe_paths(rows.withColumn("file_id", F.xxhash64("path")))
        schemas.write(rows, self.data, "files", v)
        present = store.present(self.table("files"))
        self._extract(root, present, v)
        self._derive(present, v)
        schemas.write(self.spark.createDataFrame([("version", str(v)), ("root", root)], "key string, value string"), self.data, "meta", v)
        return diff

    def _extract(self, root: str, present: DataFrame, v: int) -> None:
        c, docs = self.config, self.table("documents")
        todo = store.needs_work(present, docs.select("file_id", "content_hash")).where(F.col("size") <= c.scan.max_bytes)
        raw = files.walk(self.spark, root).select("uri", "path").join(todo.select("path", "file_id", "content_hash"), "path")
        content = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/")).select(F.col("path").alias("uri"), "content").join(raw, "uri")
        made = extract.extract(content.select("path", "content"), c.extraction.max_chars_per_document).join(todo.select("path", "file_id", "content_hash"), "path")
        fresh = blocks.offsets(extract.explode_blocks(made, "file_id"))
        old = store.of_present(self.table("document_blocks"), present)
        schemas.write(schemas.conform(store.replace_for(schemas.conform(old, "document_blocks"), todo, schemas.conform(fresh, "document_blocks")), "document_blocks"), self.data, "document_blocks", v)
        whole = blocks.assemble(self.table("document_blocks"))
        heads = made.select("file_id", "path", "extractor", "ok", "error", "truncated", "content_hash").join(whole, "file_id", "left")
        schemas.write(store.replace_for(schemas.conform(store.of_present(docs, present), "documents"), todo, schemas.conform(heads, "documents")), self.data, "documents", v)

    def _derive(self, present: DataFrame, v: int) -> None:
        c = self.config
        docs = self.table("documents").where("ok").join(present.select("file_id", "mtime"), "file_id")
        parts = self.table("document_blocks")
        schemas.write(store.reconcile(entities.recognise(docs)), self.data, "entities", v)
        schemas.write(entities.keywords(docs), self.data, "keywords", v)
        schemas.write(blocks.in_table(dates.date_mentions(docs, near="mtime"), parts), self.data, "date_mentions", v)
        schemas.write(dates.best_per_day(dates.classify(self.table("date_mentions"), docs, parts, c.temporal.weights, c.temporal.threshold)), self.data, "classified_dates", v)
        pieces = blocks.chunks(parts, c.embeddings.chunk_size_tokens, c.embeddings.chunk_overlap_tokens)
        pieces = pieces.withColumn("v", vec.hashed_terms(F.col("text"), c.embeddings.dimension)).withColumn("chunk_id", F.concat_ws(":", "file_id", "chunk_index"))
        schemas.write(pieces, self.data, "chunks", v)
        pooled = vec.mean_pool(self.table("chunks"), "file_id", "v")
        own = self.table("entities").groupBy("file_id").agg(F.collect_set(F.concat_ws(":", "category", "normalised")).alias("entities"))
        rows = present.select("file_id", "mtime", "folder", "path").join(own, "file_id", "left").join(pooled, "file_id", "left")
        islands = sessions.islands(rows, "mtime", c.activity.session_gap_hours, tie="path")
        clusters = sessions.cluster(islands, c.activity.session_gap_hours, c.activity.session_link_threshold)
        members = sessions.number_sessions(clusters, present, c.activity.min_session_size)
        schemas.write(members, self.data, "session_members", v)
        schemas.write(sessions.describe(members, self.table("keywords"), self.table("entities"), self.table("classified_dates")), self.data, "sessions", v)
        schemas.write(tree.nodes(present, pieces).join(tree.file_counts(present), "node_id", "left"), self.data, "tree_nodes", v)
        self._graph(present, docs, pooled, v)

    def _graph(self, present: DataFrame, docs: DataFrame, pooled: DataFrame, v: int) -> None:
        c = self.config.graph
        node = lambda pairs, kind: graph.both_ways(pairs.select(graph.file_node(F.col("a")).alias("a"), graph.file_node(F.col("b")).alias("b"), F.lit(kind).alias("type"), "weight"))
        v_docs = pooled.withColumnRenamed("file_id", "doc_id")
        postings = self.table("entities").select(F.concat_ws(":", "category", "normalised").alias("key"), "file_id")
        n = self.table("session_members").join(present.select("file_id", "mtime"), "file_id")
        edges = store.union_all(
            node(graph.same_folder(present), "structural"), node(graph.sibling_folders(present), "structural"), node(graph.shared_entities(postings, least=c.min_shared_entities), "entity"),
            node(graph.semantic(v_docs, c.semantic_edge_threshold, c.semantic_edges_per_node), "semantic"), node(graph.duplicates(docs, v_docs, c.duplicate_candidate_similarity, c.duplicate_threshold), "duplicate"),
            graph.activity_edges(self.table("session_members"), self.table("sessions")), graph.edited_before(n), graph.date_edges(self.table("classified_dates")),
        )
        schemas.write(edges, self.data, "edges", v)
        schemas.write(present.select(graph.file_node(F.col("file_id")).alias("id"), F.lit("file").alias("kind")), self.data, "vertices", v)

    def query(self, texts: list[str], today: dt.date, signals: tuple[str, ...] = tuple(retrieval.WEIGHTS), top_k: int | None = None) -> DataFrame:
        """Ranked, explained files for each query text."""
        line = timeline.timeline(self.table("classified_dates"))
        read = [decompose.read_query(t, today, line, lambda s: [e[0] for e in entities.capitalised(s)]) for t in texts]
        rows = [(i, r.text, r.range.start if r.range else None, r.range.end if r.range else None, r.cue, list(r.formats), r.entities, r.terms) for i, r in enumerate(read)]
        q = self.spark.createDataFrame(rows, "query_id long, text string, range_start date, range_end date, cue double, formats array<string>, entities array<string>, terms array<string>")
        q = q.withColumn("v", vec.hashed_terms(F.col("text"), self.config.embeddings.dimension)).withColumn("query_norm", text.normalise_query("text"))
        docs = vec.mean_pool(self.table("chunks"), "file_id", "v").withColumnRenamed("file_id", "doc_id")
        c = self.config.retrieval
        out = retrieval.retrieve(q.drop("text", "terms"), docs, self.table("edges"), self.table("files"), self.table("entities"), line, self.table("session_members"), store.feedback_net(self.table("feedback")), signals, c.max_seed_nodes, c.max_expanded_nodes, top_k or c.top_k, c.weights)
        out = settled(out, "query-results")
        more = retrieval.details(q, out, self.table("keywords"), self.table("entities"), self.table("session_members"), self.table("sessions"), line)
        out = retrieval.explain(out, more).join(F.broadcast(self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")), "query_id")
        schemas.write(out, self.data, "last_query", schemas.newest(self.spark, self.data, "last_query") + 1)
        return self.table("last_query")

    def explain(self, rank: int, query_id: int = 0) -> DataFrame:
        """The result of that rank in the last query, with its arithmetic."""
        return self.table("last_query").where((F.col("rank") == rank) & (F.col("query_id") == query_id))

    def feedback_on(self, rank: int, event: str = "pick", weight: float = 1.0, query_id: int = 0) -> None:
        """Feedback on a result of the last query."""
        hit = self.explain(rank, query_id).select("text", "file_id").first()
        if hit is None:
            raise LookupError(f"the last query has no result of rank {rank}")
        self.feedback(hit.text, hit.file_id, event, weight)

    def find(self, said: str) -> str:
        """The one present path that has `said` in it."""
        return store.one_path(store.present(self.table("files")), said)

    def feedback(self, query: str, file_id: int, event: str = "pick", weight: float = 1.0) -> None:
        """Record a pick or a reject of a result."""
        if event not in ("pick", "reject"):
            raise ValueError("event must be 'pick' or 'reject'")
        v = self.table("feedback")
        row = self.spark.createDataFrame([(query, file_id, event, weight)], "query string, file_id long, event string, weight double").select(text.normalise_query("query").alias("query_norm"), "file_id", "event", "weight")
        n = v.count()
        schemas.write(v.unionByName(schemas.conform(row, "feedback")), self.data, "feedback", n + 1)

    def timeline(self, expression: str, today: dt.date) -> DataFrame:
        line = timeline.timeline(self.table("classified_dates"))
        return timeline.files_in_range(line, timeline.best_reading(expression, line, today)).join(self.table("files").select("file_id", "path"), "file_id").orderBy("first_day", "path")

    def duplicates(self) -> DataFrame:
        pairs = self.table("edges").where("type = 'duplicate' AND src < dst").select(*[F.substring(x, 6, 20).cast("long").alias(y) for x, y in (("src", "a"), ("dst", "b"))], "weight")
        return insights.duplicate_groups(pairs, self.table("files"))

    def projects(self, today: dt.date) -> DataFrame:
        return insights.projects(store.present(self.table("files")), self.table("classified_dates"), self.table("keywords"), today)

    def digest(self, today: dt.date) -> tuple[DataFrame, DataFrame, DataFrame]:
        f = store.present(self.table("files"))
        return insights.by_extension(f), insights.ages(f, today), insights.extremes(f)

    def tags(self) -> DataFrame:
        s = self.table("session_members").join(self.table("sessions").select("session_id", "label", "kind"), "session_id")
        return insights.suggest_tags(self.table("files"), s, self.table("entities"), self.table("classified_dates"), self.table("keywords"))

    def stats(self) -> dict[str, int]:
        names = ("files", "documents", "entities", "date_mentions", "chunks", "sessions", "edges", "tree_nodes", "feedback")
        return {r.name: r.n for r in store.counts(**{name: self.table(name) for name in names}).collect()}
