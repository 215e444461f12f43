"""Quality rules by weak supervision.

Each rule looks at a few statistics of a document and votes good (1), bad (-1) or abstains
(0). The rules' accuracies come from expectation-maximisation over the counts of all vote
patterns in the corpus, and a document's verdict is its posterior probability of being
good. A document fails outright only by the base rule.

Only vote patterns with their counts reach the driver: at most 3 ** len(RULES) rows,
whatever the corpus.

Defined results: a null text has no words, and so fails the base rule; an empty table gives
an empty result; repeated rows get equal results; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, column, cut, table

WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_letters", "n_symbol_runs", "n_distinct_words")


def _covered(starts: Column) -> Column:
    """Words covered by windows at these ascending starts."""
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
    step = lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(p - a["last"], F.lit(WINDOW))).alias("sum"))
    return F.aggregate(starts, zero, step, lambda a: a["sum"])


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS, all long, over whole texts."""
    text = F.coalesce(column(text_col), F.lit(""))
    word_list = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    base = docs.select(column(id_col).alias("doc_id"), text.alias("text"), word_list.alias("words"))

    # A hash of each window of 8 words; most documents have no two alike.
    windows = F.when(
        F.size("words") > WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = base.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^0-9]+", "")).alias("n_digits"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).alias("n_letters"),
        F.regexp_count("text", F.lit("[#*$%&|<>]+")).alias("n_symbol_runs"),
        F.size(F.array_distinct("words")).alias("n_distinct_words"),
        lines.alias("lines"),
        windows.alias("windows"),
    )
    # Equal neighbours in hash order are the repeated windows.
    marked = hashed.withColumn(
        "sorted",
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ),
    ).drop("windows")
    same = lambda x, i: F.coalesce(F.get("sorted", i)["h"] == x["h"], F.lit(False))
    starts = F.array_sort(
        F.transform(F.filter("sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"])
    )
    found = marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.col("sorted").isNull(), F.lit(0)).otherwise(_covered(starts)).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), "n_upper", "n_digits", "n_letters", "n_symbol_runs", "n_distinct_words",
    )
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The rules over the columns STATS; between the two bounds a rule abstains."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda c, of: F.col(c) / of
    mean = chars / words
    return {
        "length": _vote(words < 20, words >= 50),
        "symbols": _vote(share("n_symbols", words) > 0.1, share("n_symbols", words) < 0.02),
        "symbol_runs": _vote(share("n_symbol_runs", words) > 0.1, share("n_symbol_runs", words) < 0.02),
        "letters": _vote(share("n_letters", chars) < 0.85, share("n_letters", chars) > 0.92),
        "repeats": _vote(share("n_repeat_words", words) > 0.3, share("n_repeat_words", words) < 0.05),
        "dup_lines": _vote(share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))) > 0.3, F.col("n_dup_lines") == 0),
        "shouting": _vote(share("n_upper", chars) > 0.4, share("n_upper", chars) < 0.15),
        "digits": _vote(share("n_digits", chars) > 0.3, share("n_digits", chars) < 0.1),
        "word_length": _vote((mean < 2) | (mean > 14), (mean >= 3) & (mean <= 9)),
        "variety": _vote((words >= 50) & (share("n_distinct_words", F.least(words, F.lit(1000))) < 0.1), share("n_distinct_words", words) > 0.25),
    }


RULES = ("length", "symbols", "symbol_runs", "letters", "repeats", "dup_lines", "shouting", "digits", "word_length", "variety")


@dataclass(frozen=True)
class LabelModel:
    """log P(vote | good) - log P(vote | bad) for bad and good votes of each rule, and the prior's log odds."""

    prior: float
    weights: dict[str, tuple[float, float]]

    def posterior(self) -> Column:
        odds = F.lit(self.prior)
        for rule, (bad, good) in self.weights.items():
            odds = odds + F.when(F.col(rule) < 0, bad).when(F.col(rule) > 0, good).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rules: tuple[str, ...] = RULES, rounds: int = 60) -> LabelModel:
    """EM over vote patterns (one row each, in -1, 0, 1) with their counts.

    A bad document is one that some rules find bad; most rules find it good all the same. A
    good one hardly ever gets a bad vote. EM starts there, and pseudo-votes (a thousandth of
    the corpus) keep rules that hardly ever vote near that start. Abstaining says nothing. No patterns:
    the priors.
    """
    total = max(1.0, float(counts.sum()))
    pseudo = 0.001 * total + 1
    bad_vote, good_vote = (patterns < 0).astype(float), (patterns > 0).astype(float)
    # false_alarm and hit: the chance of a bad vote, given any, in good and in bad documents
    start = 0.003, 0.3
    false_alarm, hit, prior = np.full(len(rules), start[0]), np.full(len(rules), start[1]), 0.8
    for _ in range(rounds if len(patterns) else 0):
        odds = np.log(prior / (1 - prior)) + bad_vote @ np.log(false_alarm / hit) + good_vote @ np.log((1 - false_alarm) / (1 - hit))
        good = counts / (1 + np.exp(-np.clip(odds, -50, 50)))
        false_alarm, hit = (
            (w @ bad_vote + pseudo * s) / (w @ (bad_vote + good_vote) + pseudo) for w, s in ((good, start[0]), (counts - good, start[1]))
        )
        prior = (good.sum() + 0.8 * pseudo) / (total + pseudo)
    weights = zip(np.log(false_alarm / hit), np.log((1 - false_alarm) / (1 - hit)), strict=True)
    return LabelModel(float(np.log(prior / (1 - prior))), {r: (float(b), float(g)) for r, (b, g) in zip(rules, weights, strict=True)})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, STATS, a vote per rule, base_failed, quality (posterior) and kept."""
    stats = cut(text_stats(docs, id_col, text_col), "rule-stats")
    voted = stats.select("*", *(v.cast("int").alias(f"vote_{k}") for k, v in votes().items()))
    columns = [f"vote_{r}" for r in RULES]
    # What fails outright tells nothing of the others, so the model is fitted without it.
    seen = voted.where(~base_failed()).groupBy(*columns).count().collect()
    patterns = np.array([[r[c] for c in columns] for r in seen], dtype=np.int64).reshape(len(seen), len(columns))
    model = fit_label_model(patterns, np.array([r["count"] for r in seen], dtype=np.float64))
    model = LabelModel(model.prior, {f"vote_{k}": w for k, w in model.weights.items()})
    judged = voted.select("*", base_failed().alias("base_failed"), model.posterior().alias("quality"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
