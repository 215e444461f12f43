"""Quality classifier with hierarchical empirical Bayes over sites.

Document evidence: a naive Bayes ratio over binned text statistics, counted over all
labelled rows and calibrated by a logistic fit on a histogram of its values. Site evidence:
sums of document probabilities by host and by path. A host's rate is shrunk towards the
global rate, a path's towards its host's, each by a prior strength that the spread between
sites gives (method of moments); so sparse sites stay near their parent. A document's
log odds are its own plus its path's distance from the global rate, where its own
probability is left out of its host's and path's rates: no evidence counts twice.

Only counts over fixed bins, a fixed histogram and a few sums reach the driver.

Defined results: a null text is empty; null host or path columns form a group of their own;
no labels: document evidence is 0 and the rate 0.5; null labels are ignored; a document
with several labels counts once for each; repeated rows get equal results; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, table
from .quality_rules import text_stats

BINS = 12


def _binned() -> dict[str, Column]:
    """Statistics in BINS steps each."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    logs = lambda x: F.floor(F.log2(1 + x))
    share = lambda x: F.floor(F.log2(1 + 1000 * x))
    raw = {
        "words": logs(F.col("n_words")),
        "word_length": F.floor(chars / words),
        "symbols": share(F.col("n_symbols") / words),
        "repeats": share(F.col("n_repeat_words") / words),
        "dup_lines": share(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "upper": share(F.col("n_upper") / chars),
        "digits": share(F.col("n_digits") / chars),
        "variety": F.floor(BINS * F.col("n_distinct_words") / words),
        "line_words": logs(words / F.greatest(F.col("n_lines"), F.lit(1))),
    }
    return {k: F.least(F.greatest(v, F.lit(0)), F.lit(BINS - 1)).cast("int") for k, v in raw.items()}


FEATURES = ("words", "word_length", "symbols", "repeats", "dup_lines", "upper", "digits", "variety", "line_words")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _fit_ratios(labelled: DataFrame) -> tuple[dict[str, list[float]], int, int]:
    """log P(bin | good) - log P(bin | bad) of every bin, and the labels of each kind."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES)))
    counted = labelled.select("label", pairs.alias("x")).groupBy("x.feature", "x.bin", "label").count().collect()
    table_ = {f: np.ones((2, BINS)) for f in FEATURES}
    for r in counted:
        table_[r["feature"]][r["label"], r["bin"]] += r["count"]
    first = table_[FEATURES[0]].sum(axis=1) - BINS
    ratios = {f: (np.log(t[1] / t[1].sum()) - np.log(t[0] / t[0].sum())).tolist() for f, t in table_.items()}
    return ratios, int(first[0]), int(first[1])


def _calibrate(histogram: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of labels on values, with a weak prior at slope 1."""
    if not histogram:
        return 1.0, 0.0
    x, y, n = (np.array(c, dtype=np.float64) for c in zip(*histogram, strict=True))
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.5 * (w - [1.0, 0.0])
        curve = design.T @ (design * (n * p * (1 - p))[:, None]) + 0.5 * np.eye(2)
        w = w + np.clip(np.linalg.solve(curve, gradient), -1, 1)
    return max(0.05, float(w[0])), float(w[1])


def _strength(sites: DataFrame, mean: Column, parent: Column) -> float:
    """How many documents a site's prior weighs, from the spread of site rates around their parents."""
    r = sites.where("n > 0").agg(
        F.sum(F.col("n") * (mean - parent) ** 2).alias("between"),
        F.sum(parent * (1 - parent)).alias("noise"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("whole"),
        F.sum("n").alias("n"),
    ).first()
    if not r["n"]:
        return 1.0
    spread = max(1e-6, (r["between"] - r["noise"]) / r["n"])
    return min(1e6, max(1.0, r["whole"] / r["n"] / spread - 1))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    host_cols: Sequence[str] = ("source",),
    path_cols: Sequence[str] = ("source", "lang"),
    threshold: float = 0.5,
) -> DataFrame:
    """doc_id, doc_score, host_rate, path_rate (both as the other documents give them), score and kept."""
    tagged = docs.select(
        F.struct(column(id_col).alias("id"), F.xxhash64(*map(column, host_cols)).alias("host"), F.xxhash64(*map(column, [*host_cols, *path_cols])).alias("path")).alias("key"),
        column(text_col).alias("text"),
    )
    stats = text_stats(tagged, "key").select("doc_id.id", "doc_id.host", "doc_id.path", *(v.alias(f"bin_{k}") for k, v in _binned().items()))
    stats = cut(stats, "classifier-bins")
    marks = labels.where(column(label_col).isin(0, 1)).select(column(id_col).alias("id"), column(label_col).cast("int").alias("label"))
    labelled = cut(stats.join(marks, "id"), "classifier-labelled")

    ratios, bad, good = _fit_ratios(labelled)
    value = F.lit(math.log((good + 1) / (bad + 1)))
    for f in FEATURES:
        value = value + F.element_at(F.array(*map(F.lit, ratios[f])), F.col(f"bin_{f}") + 1)
    binned = F.round(F.greatest(F.least(value, F.lit(40)), F.lit(-40)), 1)
    histogram = labelled.groupBy(binned.alias("x"), "label").count().collect()
    slope, intercept = _calibrate([(float(r["x"]), r["label"], r["count"]) for r in histogram])
    odds = F.greatest(F.least(slope * value + intercept, F.lit(12.0)), F.lit(-12.0))
    scored = stats.select("id", "host", "path", odds.alias("odds")).withColumn("doc_score", 1 / (1 + F.exp(-F.col("odds"))))

    paths = cut(scored.groupBy("host", "path").agg(F.sum("doc_score").alias("good"), F.count("*").alias("n")), "paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("n")), "hosts")
    whole = hosts.agg(F.sum("host_good").alias("good"), F.sum("n").alias("n")).first()
    rate = ((whole["good"] or 0.0) + 1) / ((whole["n"] or 0) + 2)
    of_host = _strength(hosts, F.col("host_good") / F.col("n"), F.lit(rate))
    hosts = hosts.select("host", "host_good", F.col("n").alias("host_n"))
    sites = cut(paths.join(hosts, "host"), "sites")
    of_path = _strength(sites, F.col("good") / F.col("n"), (F.col("host_good") + of_host * rate) / (F.col("host_n") + of_host))
    # The sites' sums without the document itself.
    judged = scored.join(sites, ["host", "path"])
    judged = judged.withColumn("host_rate", (F.col("host_good") - F.col("doc_score") + of_host * rate) / (F.col("host_n") - 1 + of_host))
    judged = judged.withColumn("path_rate", (F.col("good") - F.col("doc_score") + of_path * F.col("host_rate")) / (F.col("n") - 1 + of_path))
    posterior = 1 / (1 + F.exp(-(F.col("odds") + _logit(F.col("path_rate")) - F.lit(math.log(rate / (1 - rate))))))
    found = judged.select(F.col("id").alias(id_col), "doc_score", "host_rate", "path_rate", posterior.alias("score"))
    return found.withColumn("kept", F.col("score") >= threshold)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
