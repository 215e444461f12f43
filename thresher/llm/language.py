"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is its letters in lower case, with one blank wherever others stand between. Its
n-grams of one to four such characters are hashed to rows of an embedding table; their mean
goes through a linear softmax. Table and softmax are trained together in numpy by stochastic
gradient descent, on pieces of many lengths of the sampled texts, so short texts are known as
well as long ones. The pieces of texts that took no part in the descent then set a
temperature, so that the score is the chance of being right, and the least score from which
on at most `risk` of them are wrong; what scores less is not accepted.

The fit runs in one task over a bounded sample: about per_language different texts of each
of the most_languages most frequent languages, at most max_rows texts and max_chars
characters in all, those whose hashes are least. Counts are of all texts. The weights have a
fixed size. Scores cover whole texts, in blocks of bounded size.

Defined results: a text that is null or has no letter is `und` with score 0 and not
accepted, as is every text where nothing could be learned; labels that are null aren't
learned from; with one label only, it is predicted everywhere with score 1; of texts labelled
in several ways each way is learned; ties go to the language that comes first by its code
points; a null id counts as held in; repeated rows get equal results; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fraction_of, schema_of, slices, table
from .toxicity import held_out

ORDERS, BITS, WIDTH = 4, 17, 16
SIZE = 1 << BITS
UNKNOWN = "und"
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_BLANK = 32
#: Code points in a block; a longer text is taken block by block.
BLOCK = 1 << 19


class _Letters:
    """Code points as lower-case letters, or blanks; filled in as they are met."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, dtype=bool)
        self.letter = np.zeros(0x110000, dtype=bool)
        self.lower = np.full(0x110000, _BLANK, dtype=np.uint32)

    def look_up(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for c in np.unique(code[~self.known[code]]).tolist():
            one = chr(c)
            self.known[c], self.letter[c] = True, one.isalpha()
            if one.isalpha():
                low = one.lower()
                self.lower[c] = ord(low) if len(low) == 1 else c
        return self.lower[code], self.letter[code]


_LETTERS = _Letters()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _squeezed(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without blanks that follow a blank of the same text."""
    again = np.zeros(len(code), dtype=bool)
    again[1:] = (code[1:] == _BLANK) & (code[:-1] == _BLANK) & (row[1:] == row[:-1])
    return code[~again], row[~again]


def _grams(code: np.ndarray, row: np.ndarray, earlier: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, text and hashed feature of every n-gram that ends behind the first `earlier` characters."""
    mixed = wide = code.astype(np.uint64)
    for n in range(1, ORDERS + 1):
        if n > 1:
            mixed = mixed[:-1] * _STEP + wide[n - 1 :]
        inside = row[: len(mixed)] == row[n - 1 :]
        inside[: max(0, earlier - n + 1)] = False
        if n == 1:
            inside &= code != _BLANK
        yield row[: len(mixed)][inside], (((mixed[inside] + np.uint64(n)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Characters, their texts, how many were in the block before, and which texts have letters there.

    Short texts share a block; a long one is a run of blocks, each behind the last characters of the one before.
    """
    held: list[tuple[int, str]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        code = _codes("".join(f" {t} " for _, t in held))
        row = np.repeat(np.array([k for k, _ in held], dtype=np.int32), [len(t) + 2 for _, t in held])
        low, letter = _LETTERS.look_up(code)
        return *_squeezed(low, row), 0, np.unique(row[letter])

    for k, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= BLOCK:
            held.append((k, text))
            size += len(text)
            if size > BLOCK:
                yield joined()
                held, size = [], 0
            continue
        tail = np.array([_BLANK], dtype=np.uint32)
        for at in range(0, len(text) + 1, BLOCK):
            low, letter = _LETTERS.look_up(_codes(text[at : at + BLOCK] + (" " if at + BLOCK > len(text) else "")))
            code, row = _squeezed(np.concatenate([tail, low]), np.full(len(tail) + len(low), k, dtype=np.int32))
            yield code, row, len(tail), np.array([k] if letter.any() else [], dtype=np.int32)
            tail = code[-(ORDERS - 1) :]
    if held:
        yield joined()


@dataclass
class Model:
    """What a feature adds to the logits, or to the hidden mean where that is narrower; the softmax; the calibration."""

    languages: list[str]
    features: np.ndarray
    softmax: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the logits, and whether it has a letter."""
        sums, counts, lettered = np.zeros((len(texts), self.features.shape[1])), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for code, row, earlier, found in _blocks(texts):
            lettered[found] = True
            for of, feature in _grams(code, row, earlier):
                if not len(of):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                np.add.at(sums, of[starts], np.add.reduceat(self.features[feature], starts, axis=0, dtype=np.float64))
                np.add.at(counts, of[starts], np.diff(np.append(starts, len(of))))
        mean = sums / np.maximum(counts, 1)[:, None]
        return (mean if self.softmax is None else mean @ self.softmax) + self.bias, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the score is high enough."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        logits, lettered = self.logits(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
        return [self.languages[b] if known else UNKNOWN for b, known in zip(best.tolist(), lettered.tolist(), strict=True)], score, lettered & (score >= self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pieces(text: str, draw: np.random.Generator, lengths: tuple[int, ...] = (16, 32, 64, 128, 256, 512, 1024)) -> list[str]:
    """The text as consecutive pieces of drawn lengths."""
    found, at = [], 0
    while at < len(text):
        n = lengths[int(draw.integers(len(lengths)))]
        found.append(text[at : at + n])
        at += n
    return found


def _examples(texts: list[str], labels: list[int], draw: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """The features of each piece that has a letter, and its label."""
    features, marks = [], []
    for text, label in zip(texts, labels, strict=True):
        pieces = _pieces(text, draw)
        by_piece: list[list[np.ndarray]] = [[] for _ in pieces]
        for code, row, earlier, _ in _blocks(pieces):
            for of, feature in _grams(code, row, earlier):
                edges = np.flatnonzero(of[1:] != of[:-1]) + 1
                for k, part in zip(of[np.concatenate([[0], edges])].tolist() if len(of) else [], np.split(feature, edges), strict=False):
                    by_piece[k].append(part)
        kept = [np.concatenate(p) for p in by_piece if p]
        features += kept
        marks += [label] * len(kept)
    return features, np.array(marks, dtype=np.int64)


def _mean(examples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different features, and the share that each has in each example."""
    found, sizes = np.concatenate(examples), [len(e) for e in examples]
    place = np.zeros(SIZE, dtype=np.int32)
    place[found] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used))
    at, row = place[found], np.repeat(np.arange(len(examples)), sizes)
    share = np.bincount(row * len(used) + at, minlength=len(examples) * len(used)).reshape(len(examples), len(used)).astype(np.float32)
    return used, share / np.array(sizes, dtype=np.float32)[:, None]


def descend(examples: list[np.ndarray], labels: np.ndarray, languages: int, draw: np.random.Generator, epochs: int = 4, rate: float = 0.5, batch: int = 32):
    """Embeddings, softmax and bias by stochastic gradient descent; the rate falls to nothing."""
    embedding = draw.uniform(-1 / WIDTH, 1 / WIDTH, (SIZE, WIDTH)).astype(np.float32)
    softmax, bias = np.zeros((WIDTH, languages), dtype=np.float32), np.zeros(languages, dtype=np.float32)
    steps, done = max(1, epochs * math.ceil(len(examples) / batch)), 0
    for _ in range(epochs):
        order = draw.permutation(len(examples))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            used, share = _mean([examples[i] for i in some.tolist()])
            hidden = share @ embedding[used]
            error = _softmax(hidden @ softmax + bias)
            error[np.arange(len(some)), labels[some]] -= 1
            now = np.float32(rate * (1 - done / steps))
            back = error @ softmax.T
            softmax -= now * (hidden.T @ error)
            bias -= now * error.mean(axis=0)
            embedding[used] -= now * (share.T @ back)
            done += 1
    return embedding, softmax, bias


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section over its logarithm."""
    loss = lambda t: -np.log(np.maximum(_softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    low, high, golden = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def threshold(scores: np.ndarray, right: np.ndarray, risk: float) -> float:
    """The least score from which on at most `risk` are wrong, one more wrong one counted in; above 1 if there is none."""
    order = np.argsort(-scores, kind="stable")
    wrong = (np.cumsum(~right[order]) + 1) / (np.arange(len(order)) + 1)
    last = np.flatnonzero(np.append(scores[order][1:] != scores[order][:-1], True) & (wrong <= risk)) if len(order) else []
    return float(scores[order][last[-1]]) if len(last) else 2.0


def fit(texts: list[str], labels: list[str], risk: float = 0.01, seed: int = 11, calibrate: int = 5) -> Model:
    """Every `calibrate`-th text sets temperature and threshold, the others are learned from."""
    languages = sorted(set(labels))
    draw, place = np.random.default_rng(seed), {lang: k for k, lang in enumerate(languages)}
    marks = [place[lang] for lang in labels]
    if len(languages) < 2:
        return Model(languages, np.zeros((SIZE, len(languages)), dtype=np.float32), None, np.zeros(len(languages), dtype=np.float32), 1.0, 0.0)
    kept = [k for k in range(len(texts)) if k % calibrate]
    examples, known = _examples([texts[k] for k in kept], [marks[k] for k in kept], draw)
    embedding, softmax, bias = descend(examples, known, len(languages), draw)
    narrow = len(languages) <= WIDTH
    model = Model(languages, embedding @ softmax if narrow else embedding, None if narrow else softmax, bias, 1.0, 0.0)
    held = [(p, marks[k]) for k in range(0, len(texts), calibrate) for p in [*_pieces(texts[k], draw), texts[k]]]
    logits, lettered = model.logits([p for p, _ in held])
    logits, truth = logits[lettered], np.array([m for _, m in held], dtype=np.int64)[lettered]
    if len(truth):
        model.temperature = _temperature(logits, truth)
        p = _softmax(logits / model.temperature)
        model.threshold = threshold(p.max(axis=1), p.argmax(axis=1) == truth, risk)
    return model


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    most_languages: int = 256,
    max_rows: int = 8_000,
    max_chars: int = 6_000_000,
    risk: float = 0.01,
) -> Model:
    """Learns from documents that have a label and aren't held out; see the module for the bounds of the sample."""
    usable = docs.where(~held_out(id_col)).select(column(lang_col).cast("string").alias("lang"), column(text_col).alias("text"))
    usable = usable.where("lang is not null and text is not null").withColumn("hash", F.xxhash64("text"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("hash", 0.05).alias("n"), F.count("*").alias("rows"))
    frequent = counts.orderBy(F.desc("rows"), "lang").limit(most_languages)
    # Languages take turns: place is the expected rank among the different texts of the language.
    placed = usable.join(F.broadcast(frequent), "lang").withColumn("place", fraction_of(F.xxhash64("hash")) * F.col("n"))
    chosen = placed.where((F.col("place") < per_language) & (F.length("text") <= max_chars)).select("lang", "text", "place").distinct()
    sample = chosen.orderBy("place", "lang", "text").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                one = text.as_py()
                size += len(one)
                if size <= max_chars:
                    texts.append(one)
                    labels.append(lang.as_py())
        m = fit(texts, labels, risk)
        parts = [m.features.astype("<f4").tobytes(), m.softmax.astype("<f4").tobytes() if m.softmax is not None else None, m.bias.astype("<f4").tobytes()]
        columns = [pa.array([m.languages], pa.list_(pa.string())), *(pa.array([p], pa.binary()) for p in parts), pa.array([m.temperature]), pa.array([m.threshold])]
        yield pa.RecordBatch.from_arrays(columns, names=["languages", "features", "softmax", "bias", "temperature", "threshold"])

    one = sample.repartition(1).sortWithinPartitions("place", "lang", "text").select("lang", "text")
    got = one.mapInArrow(run, "languages array<string>, features binary, softmax binary, bias binary, temperature double, threshold double").first()
    if got is None:
        return fit([], [], risk)
    read = lambda x, n: np.frombuffer(x, dtype="<f4").reshape(n)
    n = len(got["languages"])
    return Model(got["languages"], read(got["features"], (SIZE, -1)), read(got["softmax"], (WIDTH, n)) if got["softmax"] is not None else None, read(got["bias"], n), got["temperature"], got["threshold"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, lang_pred, score, and accepted: whether the score is sure enough."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for at, n in slices(whole.column(1), BLOCK):
                batch = whole.slice(at, n)
                found, score, sure = known.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score), pa.array(sure)], names=["id", "lang_pred", "score", "accepted"])

    ready = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return ready.mapInArrow(run, schema_of(ready, ["id"], "lang_pred string, score double, accepted boolean")).withColumnRenamed("id", id_col)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
