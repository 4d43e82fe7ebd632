"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of the whole text are standardised and mapped to random cosine features, which approximate a Gaussian
kernel. Each partition sums its share of the normal equations; the driver adds them and solves for the ridge
weights. Scores of labelled rows held back from the fit are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _kernels as K
from ._cluster import Tables

#: Labelled rows that the fit takes at most, chosen by a hash of the id. Scoring takes every row.
FIT_ROWS = 200_000
#: Random cosine features.
WAVES = 256
#: Partitions that sum normal equations at most.
SUMMERS = 16
RIDGE = 1e-4

_CLASSES = 12
_CLASS = np.full(256, 9, dtype=np.int64)  # other symbols
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 10
for _at, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"|"), 3):
    _CLASS[list(_chars)] = _at
#: Number of statistics.
STATS = _CLASSES - 1 + 15


def _statistics(data: np.ndarray, w: K.Words, at: np.ndarray) -> np.ndarray:
    """One row of statistics per document of a slice."""
    docs = len(w.counts)
    size = np.diff(at)
    of_byte = np.repeat(np.arange(docs), size)
    share = np.bincount(of_byte * _CLASSES + _CLASS[data], minlength=docs * _CLASSES).reshape(docs, _CLASSES)[:, : _CLASSES - 1]
    n = w.counts
    n1 = np.maximum(n, 1)
    length = (w.ends - w.starts).astype(float)
    of_word = np.repeat(np.arange(docs), n)
    total = lambda x: np.bincount(of_word, weights=x, minlength=docs)
    mean = total(length) / n1
    first, last = _CLASS[w.data[w.starts]], _CLASS[w.data[w.ends - 1]] if len(n) else _CLASS[:0]
    follows = np.zeros(len(w.hashes))
    follows[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of_word[1:] == of_word[:-1])
    distinct, top, pairs = np.zeros(docs), np.zeros(docs), np.zeros(docs)
    grams, whole = w.grams(2)
    for d in range(docs):
        a, b = w.bounds[d], w.bounds[d + 1]
        if b > a:
            _, c = np.unique(w.hashes[a:b], return_counts=True)
            distinct[d], top[d] = len(c) / (b - a), c.max() / (b - a)
        if b > a + 1:
            pairs[d] = len(np.unique(grams[a : b - 1])) / (b - a - 1)
    line = share[:, 4] + 1.0
    odd = (_CLASS[w.data[w.ends - 1]] == 9) | (_CLASS[w.data[w.ends - 1]] == 7) if len(w.hashes) else np.zeros(0, bool)
    own = np.stack(
        [
            np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(total(length**2) / n1 - mean**2, 0)), distinct, distinct * np.log1p(n), top, pairs, total(follows) / n1,
            total((first == 0).astype(float)) / n1, total((last == 5).astype(float)) / n1, total((last == 6).astype(float)) / n1, total(odd.astype(float)) / n1, np.log1p(n / line), total((length == 1).astype(float)) / n1,
        ],
        axis=1,
    )
    return np.concatenate([share / np.maximum(size, 1)[:, None], own], axis=1)


def _measured(batches):
    for batch in batches:
        ids, text = batch.columns
        for i, j, raw, at in K.slices(text):
            w = K.word_hashes(raw, at, K.BLANKS, False)
            base = int(at[0])
            x = _statistics(raw[base : int(at[-1])], w, at - base)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), K.list_array(x.astype(np.float32).ravel(), np.arange(0, (j - i + 1) * STATS, STATS), pa.float32())], names=["id", "x"])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every text; null counts as empty. Neither ids nor other columns enter x."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_measured, f"id {docs.schema[id_col].dataType.simpleString()}, x array<float>")


@dataclass
class Model:
    """score(x) is the calibrated chance of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    wave: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def waves(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.wave + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.waves(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        # a small slope keeps the order of raw scores inside a calibrated step
        return np.clip(np.interp(r, self.knots, self.values) * 0.999 + 0.001 / (1 + np.exp(-np.clip(r, -30, 30))), 0.0, 1.0)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing fit of y on raw, by pooling adjacent violators."""
    if not len(raw):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # [sum of y, n, sum of raw]
    for r, t in zip(raw[order], y[order]):
        blocks.append([float(t), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _moments(batches):
    n, s, q = 0, np.zeros(STATS), np.zeros(STATS)
    for batch in batches:
        x = _matrix(batch.column("x"))
        n, s, q = n + len(x), s + x.sum(axis=0), q + (x**2).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], s, q])])], names=["m"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, STATS)


def _equations(model: Model):
    def run(batches):
        d = WAVES + 1
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            z, y = model.waves(_matrix(batch.column("x"))), np.asarray(batch.column("y"), dtype=float)
            a += z.T @ z
            b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), b])])], names=["m"])

    return run


def fit(labelled: DataFrame, tables: Tables, seed: int = 7) -> Model:
    """A model of labelled rows (id, x, y); a fifth of them, by a hash of the id, is held back to calibrate. Without rows the score is one half."""
    labelled = labelled.select("id", "x", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)).alias("h"))
    labelled = tables("labelled", labelled)
    total = labelled.count()
    if total > FIT_ROWS:
        labelled = labelled.where(F.col("h") < int((1 << 40) * FIT_ROWS / total))
    held = F.pmod("h", F.lit(5)) == 0
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(STATS), np.ones(STATS), rng.normal(size=(STATS, WAVES)) * np.sqrt(1.0 / STATS), rng.uniform(0, 2 * np.pi, WAVES), np.zeros(WAVES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    part = labelled.where(~held).coalesce(SUMMERS)
    m = sum((np.array(r.m) for r in part.mapInArrow(_moments, "m array<double>").collect()), np.zeros(2 * STATS + 1))
    if m[0] == 0:
        return model
    model.mean = m[1 : STATS + 1] / m[0]
    model.scale = np.maximum(np.sqrt(np.maximum(m[STATS + 1 :] / m[0] - model.mean**2, 0)), 1e-6)
    d = WAVES + 1
    m = sum((np.array(r.m) for r in part.mapInArrow(_equations(model), "m array<double>").collect()), np.zeros(d * d + d))
    a, b = m[: d * d].reshape(d, d), m[d * d :]
    model.weight = np.linalg.solve(a + RIDGE * max(a.trace() / d, 1e-9) * np.eye(d), b)
    rows = labelled.where(held).select("x", "y").coalesce(SUMMERS).toPandas()  # at most a fifth of FIT_ROWS
    if len(rows):
        raw = model.raw(np.stack(rows.x.to_numpy()).astype(float))
        model.knots, model.values = isotonic(raw, rows.y.to_numpy(dtype=float))
    return model


def quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, keep_at: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= keep_at).

    Labels are learnt from rows of docs whose id has a non-null label and for which `learn` (over the column `id`)
    holds. An id with several labels gives its largest. Null and empty texts get a score like any other. Null ids
    and repeated rows are scored each; other columns are ignored; without labels every score is one half. An empty
    table gives an empty result. Only ids, statistics and labels are shuffled, never texts.
    """
    tables = Tables(docs.sparkSession, "quality")
    measured = tables("statistics", statistics(docs, id_col, text_col))
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).where("y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    rows = measured if learn is None else measured.where(learn)
    model = fit(rows.join(known, "id"), tables)
    tables.only("statistics")

    def scored(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s), pa.array((s >= keep_at).astype(np.int32))], names=["id", "score", "predicted"])

    out = measured.mapInArrow(scored, f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, labels: DataFrame, keep_at: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows of docs, all columns, that score at least keep_at under a model of all labelled rows. Defined like quality."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).where("y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    tables = Tables(docs.sparkSession, "quality")
    model = fit(statistics(docs, id_col, text_col).join(known, "id"), tables)
    tables.only()

    def kept(batches):
        for batch in batches:
            text = batch.column(text_col)
            for i, j, raw, at in K.slices(text):
                base = int(at[0])
                x = _statistics(raw[base : int(at[-1])], K.word_hashes(raw, at, K.BLANKS, False), at - base).astype(np.float32).astype(float)
                yield batch.slice(i, j - i).filter(pa.array(model.score(x) >= keep_at))

    return docs.mapInArrow(kept, docs.schema)
