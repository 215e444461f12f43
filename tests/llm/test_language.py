"""Language identification: features against plain Python, the descent against its gradient, held-out accuracy, odd inputs."""

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thresher.llm import language

SOUNDS = {"aa": "the and ing ould ight wh ere".split(), "bb": "der die sch ung ein ich tz".split(), "cc": "él ción los que ñ ando ll".split()}


def _text(lang: str, seed: int, words: int) -> str:
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) + r.choice(["", ",", ".", " 7"]) for _ in range(words))


def _plain(text: str) -> tuple[Counter, bool]:
    """Every n-gram of a text by its hashed feature, one character after another."""
    seq = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text) + " "
    while "  " in seq:
        seq = seq.replace("  ", " ")
    out, mask = Counter(), (1 << 64) - 1
    for n in range(1, language.ORDERS + 1):
        for k in range(len(seq) - n + 1):
            gram, mixed = seq[k : k + n], 0
            for c in gram:
                mixed = (mixed * 0x100000001B3 + ord(c)) & mask
            if gram != " ":
                out[(((mixed + n) * 0x9E3779B97F4A7C15) & mask) >> (64 - language.BITS)] += 1
    return out, any(c.isalpha() for c in text)


@pytest.mark.parametrize("block", [7, 1 << 19])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abAÉßİ中 \n\t.1😀ǅª")), max_size=40)), max_size=6))
def test_features(block, texts):
    """Blocks of any size give the n-grams of the whole texts."""
    before, language.BLOCK = language.BLOCK, block
    try:
        found, lettered = [Counter() for _ in texts], set()
        for code, row, earlier, seen in language._blocks(texts):
            lettered |= set(seen.tolist())
            for of, feature in language._grams(code, row, earlier):
                for k, f in zip(of.tolist(), feature.tolist(), strict=True):
                    found[k][f] += 1
    finally:
        language.BLOCK = before
    want = [_plain(t) if t else (Counter(), False) for t in texts]
    assert found == [w for w, _ in want] and lettered == {k for k, (_, w) in enumerate(want) if w}


def test_descent_follows_the_gradient():
    """One small step from a fixed start moves the parameters by the numerical gradient of the batch's loss."""
    draw = np.random.default_rng(0)
    examples, labels = [draw.integers(0, 50, 9).astype(np.int32) for _ in range(6)], np.array([0, 1, 2, 0, 1, 2])
    start, *_ = language.descend(examples, labels, 3, np.random.default_rng(5), epochs=1, rate=0.0, batch=6)
    two = [language.descend(examples, labels, 3, np.random.default_rng(5), epochs=2, rate=r, batch=6) for r in (1e-2, 0.0)]
    assert np.array_equal(two[1][0], start)
    # With a softmax of zeros all classes are equally likely, which the first step's softmax shows.
    mean = np.stack([start[e].mean(axis=0) for e in examples])
    error = np.full((6, 3), 1 / 3)
    error[np.arange(6), labels] -= 1
    one = language.descend(examples, labels, 3, np.random.default_rng(5), epochs=1, rate=1e-2, batch=6)
    assert np.allclose(one[1], -1e-2 * mean.T @ error, atol=1e-6) and np.array_equal(one[0], start)
    loss = lambda e, w, b: -np.log(language._softmax(np.stack([e[x].mean(axis=0) for x in examples]) @ w + b)[np.arange(6), labels]).sum()
    assert loss(*two[0]) < loss(*one) < loss(start, np.zeros((16, 3)), np.zeros(3))


def test_threshold_and_temperature():
    scores, right = np.array([0.99, 0.98, 0.97, 0.9, 0.9, 0.5]), np.array([True, True, True, True, False, False])
    assert language.threshold(scores, right, 0.34) == 0.97 and language.threshold(scores, right, 0.4) == 0.9 and language.threshold(scores, right, 0.01) == 2.0
    assert language.threshold(np.zeros(0), np.zeros(0, dtype=bool), 0.1) == 2.0
    r = np.random.default_rng(3)
    truth = r.integers(0, 3, 4000)
    z = r.normal(size=(4000, 3))
    z[np.arange(4000), truth] += 1.5
    t = language._temperature(5 * z, truth)
    p = language._softmax(5 * z / t)
    assert abs(p.max(axis=1).mean() - (p.argmax(axis=1) == truth).mean()) < 0.03


def test_training_and_odd_rows(spark, docs_of):
    from pyspark.sql import functions as F

    rows, langs = [], {}
    for k in range(360):
        lang = ("aa", "bb", "cc")[k % 3]
        rows.append((k, _text(lang, k, 3 + k % 60)))
        langs[k] = lang
    odd = [(1000, None), (1001, ""), (1002, "123 456 …"), (1003, "É"), (None, _text("cc", 1, 40)), (1, rows[1][1]), (1004, _text("aa", 5, 120_000)), (1005, "😀" * 3000)]
    marks = F.create_map(*[F.lit(x) for pair in langs.items() for x in pair])
    docs = docs_of([*rows, *odd]).withColumn("lang", marks[F.col("doc_id")]).withColumn("hash", F.lit(1)).withColumn("place", F.lit("x"))
    model = language.train(docs, per_language=100)
    found = language.identify(docs, model).collect()
    assert model.languages == ["aa", "bb", "cc"] and len(found) == len(rows) + len(odd)
    held = [r for r in found if r["doc_id"] in langs and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["score"] <= 1
    assert all(by_id[k][0]["lang_pred"] == "und" and by_id[k][0]["score"] == 0 and not by_id[k][0]["accepted"] for k in (1000, 1001, 1002, 1005))
    assert by_id[1003][0]["lang_pred"] in langs.values() and by_id[None][0]["lang_pred"] == "cc" and by_id[1004][0]["lang_pred"] == "aa"
    assert by_id[1][0] == by_id[1][1]
    assert language.identify(docs_of([]), model).count() == 0


def test_few_labels(spark, docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([(k, f"word{k} text") for k in range(20)] + [(90, None)])
    for lang, want in ((F.lit(None).cast("string"), "und"), (F.lit("xx"), "xx")):
        made = docs.withColumn("lang", lang)
        found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(made, language.train(made)).collect()}
        assert found[90] == ("und", 0.0) and {found[k] for k in range(20)} == {(want, 1.0 if want == "xx" else 0.0)}


def test_wide_softmax():
    """More languages than the embedding is wide: the hidden mean goes through the softmax; results are those of the narrow form."""
    langs = [f"l{k:02d}" for k in range(20)]
    texts = [f"{chr(97 + k)}{chr(98 + k % 20)} " * (3 + j) for j in range(12) for k in range(20)]
    model = language.fit(texts, langs * 12, calibrate=6)
    assert model.softmax is not None and model.features.shape[1] == language.WIDTH
    flat = language.Model(model.languages, model.features @ model.softmax, None, model.bias, model.temperature, model.threshold)
    assert np.allclose(model.predict(texts)[1], flat.predict(texts)[1], atol=1e-4)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data here")
def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = language.op11_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) >= 0.98 * len(held)
    sure = [r for r in held if r["accepted"]]
    assert len(sure) > 0.9 * len(held) and sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in sure) >= 0.99 * len(sure)
