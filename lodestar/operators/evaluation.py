"""Retrieval metrics, confusion matrices and threshold sweeps."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def per_query(results: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(query_id, relevant, rr, p_at_k, r_at_k ...) of ranked results (query_id, doc_id, rank) and truth (query_id, doc_id, target).

    Precision divides by the smaller of k and the number relevant, at least 1. Reciprocal rank looks for targets.
    """
    n = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hit = results.join(truth.select("query_id", "doc_id", "target"), ["query_id", "doc_id"])
    counts = [F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks]
    h = hit.groupBy("query_id").agg(F.min(F.when(F.col("target"), F.col("rank"))).alias("target_rank"), *counts)
    out = n.join(h, "query_id", "left")
    return out.select(
        "query_id", "relevant", "target_rank", F.coalesce(1.0 / F.col("target_rank"), F.lit(0.0)).alias("rr"),
        *[(F.coalesce(f"h{k}", F.lit(0)) / F.greatest(F.lit(1), F.least(F.lit(k), "relevant"))).alias(f"p_at_{k}") for k in ks],
        *[(F.coalesce(f"h{k}", F.lit(0)) / F.greatest(F.lit(1), F.col("relevant"))).alias(f"r_at_{k}") for k in ks],
    )


def summary(outcomes: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None) -> DataFrame:
    """Means over queries: mrr, hit_at_1, p and r at each k."""
    means = [F.avg(f"{m}_at_{k}").alias(f"{m}_at_{k}") for m in "pr" for k in ks]
    return outcomes.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("queries"), F.avg("rr").alias("mrr"), F.avg((F.coalesce("target_rank", F.lit(0)) == 1).cast("int")).alias("hit_at_1"), *means)


def by_sets(outcomes: DataFrame) -> DataFrame:
    """mrr by kind, by difficulty and overall, in one pass."""
    return outcomes.groupingSets([["kind"], ["difficulty"], []], "kind", "difficulty").agg(F.count(F.lit(1)).alias("queries"), F.avg("rr").alias("mrr"))


def compare(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Differences of b from a by kind (configuration, kind, mrr)."""
    x = metrics.where(F.col("configuration") == a).select("kind", F.col("mrr").alias("before"))
    y = metrics.where(F.col("configuration") == b).select("kind", F.col("mrr").alias("after"))
    d = F.col("after") - F.col("before")
    return x.join(y, "kind").select("kind", "before", "after", d.alias("change"), F.when(d > 1e-9, "improved").when(d < -1e-9, "degraded").otherwise("same").alias("mark"))


def confusion(rows: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of boolean columns."""
    c = rows.groupBy(*(by or [])).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def sweep(rows: DataFrame, truth: str, score: str, low: int = 20, high: int = 85, step: int = 5) -> DataFrame:
    """Confusion at thresholds low..high (hundredths): rows are counted by the highest threshold they reach, then accumulated."""
    at = rows.select(F.col(truth).alias("t"), F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))).alias("threshold"), F.col(score).alias("s"))
    return confusion(at, F.col("t"), F.col("s") >= F.col("threshold") / 100.0, ["threshold"])


def align(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """verdicts (path, iso_date, is_meaningful, ...) that have a label (path, iso_date, kind), with it and whether they agree."""
    return verdicts.join(labels.select("path", "iso_date", "kind").distinct(), ["path", "iso_date"]).withColumn("agrees", F.col("is_meaningful") == (F.col("kind") == "meaningful"))


def undetected(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Labels (path, iso_date, kind) on which there is no verdict."""
    return labels.join(verdicts.select("path", "iso_date"), ["path", "iso_date"], "left_anti")


def coverage(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Results, and the share of them whose explanation is complete (1 without results)."""
    return results.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("results"), F.coalesce(F.avg(F.col("complete").cast("int")), F.lit(1.0)).alias("coverage"))


def latency(run: Callable[[], object], repeats: int = 5) -> dict[str, float]:
    """Milliseconds of some runs: median, least and most."""
    took = []
    for _ in range(max(1, repeats)):
        began = time.perf_counter()
        run()
        took.append((time.perf_counter() - began) * 1000)
    return {"median_ms": statistics.median(took), "min_ms": min(took), "max_ms": max(took), "repeats": len(took)}


def save(summary_rows: DataFrame, outcomes: DataFrame, folder: str) -> None:
    """results.json, results.csv and per_query.csv below a folder, each written by as many tasks as it has parts."""
    for name, kind, rows in (("results.json", "json", summary_rows), ("results.csv", "csv", summary_rows), ("per_query.csv", "csv", outcomes)):
        rows.write.mode("overwrite").option("header", kind == "csv").format(kind).save(f"{folder.rstrip('/')}/{name}")
