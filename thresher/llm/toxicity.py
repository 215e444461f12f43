"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its lower-cased characters, each present or
absent. For each feature the log ratio of its smoothed shares among toxic and other texts
scales the feature, and a logistic regression with a lasso penalty is fitted on the scaled
features until the duality gap is small: coordinate descent over a working set, which grows
by whatever feature still breaks the optimality conditions among all. The fit runs in one
task over a bounded sample of labelled rows: at most max_rows, whose hashed ids are least,
and at most max_chars characters in all. The weights have a fixed size. Scores cover whole
texts.

Defined results: a null text is empty and scores the classifier's intercept; with no usable
labels, or labels of one kind only, every score is the smoothed share of toxic labels;
labels that are null, or whose document is absent, are ignored; of rows with one id the
fit takes the least text; texts of more than max_chars characters aren't learned from; a
null id counts as held in; repeated rows get equal results; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, schema_of, slices, table

ORDERS, BITS = (3, 4, 5), 19
SIZE = 1 << BITS
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
#: Texts are hashed in slices of so many bytes.
SLICE_BYTES = 1 << 20


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row index and hashed feature of every character n-gram of every text, repeats included."""
    raw = [f" {t or ''} ".lower().encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
    if not len(raw):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    code = np.frombuffer(b"".join(raw), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    rows, features = [], []
    mixed = code
    for n in range(2, max(ORDERS) + 1):
        mixed = mixed[:-1] * _STEP + code[n - 1 :]
        if n in ORDERS:
            inside = row[: len(mixed)] == row[n - 1 :]
            hashed = ((mixed + np.uint64(n)) * _MIX) >> np.uint64(64 - BITS)
            rows.append(row[: len(mixed)][inside])
            features.append(hashed[inside].astype(np.int32))
    return np.concatenate(rows), np.concatenate(features)


def present(text: str | None) -> np.ndarray:
    """The different features of a text, ascending."""
    return np.unique(grams([text])[1])


@dataclass
class Weights:
    """A weight for each hashed feature, and the intercept."""

    weight: np.ndarray
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, feature = grams(texts)
        used = np.flatnonzero(self.weight[feature])
        found = np.unique(row[used].astype(np.int64) << BITS | feature[used])
        sums = np.bincount(found >> BITS, weights=self.weight[found & (SIZE - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept, -30, 30)))


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _loss(margin: np.ndarray, labels: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(labels > 0, -margin, margin)).sum())


class _Fit:
    """Lasso logistic regression over present features scaled by their ratios."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, penalty: float):
        self.rows, self.labels, self.ratio, self.penalty = rows, labels, ratio, penalty
        toxic, n = float(labels.sum()), len(labels)
        self.weight, self.intercept = np.zeros(SIZE), math.log(toxic / (n - toxic))
        self.margin = np.full(n, self.intercept)

    def gradient(self) -> np.ndarray:
        out = np.zeros(SIZE)
        for features, error in zip(self.rows, (_chance(self.margin) - self.labels).tolist(), strict=True):
            out[features] += error
        return out * self.ratio

    def gap(self, gradient: np.ndarray) -> float:
        """How far the loss can be from its least, by the dual point that the errors give."""
        shrink = min(1.0, self.penalty / max(1e-300, float(np.abs(gradient).max())))
        dual = np.clip(shrink * np.abs(_chance(self.margin) - self.labels), 1e-15, 1 - 1e-15)
        bound = -(dual * np.log(dual) + (1 - dual) * np.log1p(-dual)).sum()
        return _loss(self.margin, self.labels) + self.penalty * float(np.abs(self.weight).sum()) - float(bound)

    def working_set(self, gradient: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(self.weight)
        missing = np.flatnonzero((np.abs(gradient) > self.penalty) & (self.weight == 0))
        worst = missing[np.argsort(-np.abs(gradient[missing]), kind="stable")[: max(1000, len(used))]]
        return np.sort(np.concatenate([used, worst]))

    def _columns(self, working: np.ndarray) -> list[np.ndarray]:
        """The rows that hold each feature of the working set."""
        place = np.full(SIZE, -1, dtype=np.int32)
        place[working] = np.arange(len(working))
        at = [p[p >= 0] for p in (place[r] for r in self.rows)]
        row = np.repeat(np.arange(len(at)), [len(p) for p in at])
        col = np.concatenate(at)
        row = row[np.argsort(col, kind="stable")]
        return np.split(row, np.cumsum(np.bincount(col, minlength=len(working)))[:-1])

    def _move_intercept(self) -> None:
        for _ in range(2):
            p = _chance(self.margin)
            step = float((self.labels - p).sum()) / max(1e-9, float((p * (1 - p)).sum()))
            step = max(-1.0, min(1.0, step))
            self.intercept += step
            self.margin += step

    def _move(self, feature: int, rows: np.ndarray) -> float:
        """One step of a weight along its upper-bounded curve; how far it went, in units of the loss."""
        x, margin = float(self.ratio[feature]), self.margin[rows]
        p = _chance(margin)
        curve = x * x * max(1.5 * float((p * (1 - p)).sum()), 0.02 * len(rows))
        old = float(self.weight[feature])
        aim = old - x * float((p - self.labels[rows]).sum()) / curve
        new = math.copysign(max(abs(aim) - self.penalty / curve, 0.0), aim)
        step = max(-2.0, min(2.0, new - old))
        if step:
            self.weight[feature] = old + step
            self.margin[rows] = margin + x * step
        return abs(step) * math.sqrt(curve)

    def descend(self, working: np.ndarray, close: float) -> None:
        """Coordinate descent over the working set until no step is larger than close."""
        columns = self._columns(working)
        every = list(zip(working.tolist(), columns, strict=True))
        active = every
        while True:
            self._move_intercept()
            largest = max((self._move(f, rows) for f, rows in active), default=0.0)
            if largest >= close:
                active = [(f, rows) for f, rows in every if self.weight[f]] or every
            elif active is every:
                return
            else:
                active = every


def fit(rows: list[np.ndarray], labels: np.ndarray, lasso: float = 2e-4, tolerance: float = 2e-3, least: int = 3) -> Weights:
    """rows: the different features of each text. Ends when the duality gap is tolerance times the loss of no features.

    Features of fewer than least texts take no part.
    """
    toxic, n = float(labels.sum()), len(labels)
    if toxic in (0.0, float(n)):
        share = (toxic + 0.5) / (n + 10)
        return Weights(np.zeros(SIZE, dtype=np.float32), math.log(share / (1 - share)))
    counts = np.zeros((2, SIZE))
    for features, label in zip(rows, labels.astype(int).tolist(), strict=True):
        counts[label, features] += 1
    ratio = np.log((counts[1] + 1) / (toxic + 2)) - np.log((counts[0] + 1) / (n - toxic + 2))
    ratio[counts.sum(axis=0) < least] = 0
    model = _Fit([r[ratio[r] != 0] for r in rows], labels, ratio, lasso * n)
    first, close = _loss(model.margin, labels), 0.05
    while True:
        gradient = model.gradient()
        if model.gap(gradient) <= tolerance * first:
            return Weights((model.weight * ratio).astype(np.float32), model.intercept)
        model.descend(model.working_set(gradient), close)
        close = max(1e-7, close / 4)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _chosen(docs: DataFrame, usable: DataFrame, max_rows: int, max_chars: int) -> DataFrame:
    """id and label of the labelled documents to learn from: those whose hashed ids are least."""
    sizes = docs.groupBy("id").agg(F.min(F.length("text")).alias("chars")).where(F.col("chars") <= max_chars)
    drawn = usable.join(sizes, "id").withColumn("order", F.xxhash64("id")).orderBy("order", "id", "label").limit(max_rows)
    so_far = Window.orderBy("order", "id", "label").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # max_rows small rows
    return drawn.withColumn("total", F.sum("chars").over(so_far)).where(F.col("total") <= max_chars).select("id", "label")


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 12_000,
    max_chars: int = 40_000_000,
) -> Weights:
    """Learns from at most max_rows labels that aren't held out, and at most max_chars characters of their texts."""
    usable = labels.where(column(label_col).isNotNull() & column(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.select(column(id_col).alias("id"), (column(label_col) > 0).cast("double").alias("label"))
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    chosen = _chosen(texts, usable, max_rows, max_chars)
    least = texts.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    sample = least.join(F.broadcast(chosen), "id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks = [], []
        for batch in batches:
            rows += [present(t.as_py()) for t in batch.column(0)]
            marks += batch.column(1).to_pylist()
        found = fit(rows, np.array(marks, dtype=np.float64))
        weights = pa.array([found.weight.tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([weights, pa.array([found.intercept])], names=["weight", "intercept"])

    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "label")  # the order of arrival may differ
    got = one.mapInArrow(run, "weight binary, intercept double").first()
    if got is None:
        return fit([], np.zeros(0))
    return Weights(np.frombuffer(got["weight"], dtype=np.float32), got["intercept"])


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and score."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.weight, weights.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Weights(*shared.value)
        for whole in batches:
            for at, n in slices(whole.column(1), SLICE_BYTES):
                batch = whole.slice(at, n)
                scores = pa.array(model.score(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["id", "score"])

    ready = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return ready.mapInArrow(run, schema_of(ready, ["id"], "score double")).withColumnRenamed("id", id_col)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
