"""What the operators learn and count, recomputed in plain Python, and odd inputs."""

import collections
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from thresher.llm import bpe, packing, quality_classifier, quality_rules, secrets, sharding, simhash, toxicity, warc
from thresher.llm.common import cut, shared_dir


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()) for _ in range(n))


def test_toxicity_fit_is_the_least_loss():
    """The converged fit against plain proximal gradient descent on the same scaled features."""
    r = random.Random(4)
    texts = [_prose(k, 12) + (" " + r.choice(["vile", "nasty"]) if k % 4 == 0 else "") + (" vile" if k % 17 == 0 else "") for k in range(120)]
    labels = np.array([float(k % 4 == 0) for k in range(120)])
    rows = [toxicity.present(t) for t in texts]
    found = toxicity.fit(rows, labels, lasso=2e-3, tolerance=1e-6)

    used = sorted({f for row in rows for f in row.tolist()})
    x = np.array([[f in row for f in used] for row in map(set, (row.tolist() for row in rows))], dtype=float)
    with_, without = x[labels > 0].sum(axis=0), x[labels == 0].sum(axis=0)
    ratio = np.log((with_ + 1) / (labels.sum() + 2)) - np.log((without + 1) / ((1 - labels).sum() + 2))
    ratio[x.sum(axis=0) < 3] = 0
    z, w, b = x * ratio, np.zeros(len(used)), 0.0
    step = 4 * len(labels) / np.linalg.norm(np.column_stack([z, np.ones(len(labels))]), 2) ** 2
    for _ in range(30_000):
        error = 1 / (1 + np.exp(-(z @ w + b))) - labels
        w = w - step * (z.T @ error) / len(labels)
        w, b = np.sign(w) * np.maximum(np.abs(w) - step * 2e-3, 0), b - step * error.mean()
    loss = lambda m, weights: np.logaddexp(0, np.where(labels > 0, -m, m)).mean() + 2e-3 * np.abs(weights).sum()
    scaled = found.weight[used].astype(float) / np.where(ratio == 0, 1, ratio)
    ours, plain = loss(x @ found.weight[used] + found.intercept, scaled), loss(z @ w + b, w)
    assert abs(ours - plain) < 1e-4
    assert np.allclose(found.score(texts), 1 / (1 + np.exp(-(z @ w + b))), atol=0.02)


def test_toxicity_odd_rows(spark, docs_of):
    rows = [(k, _prose(k, 20) + (" vile" if k % 3 == 0 else "")) for k in range(90)] * 2 + [(500, "x" * 3000), (None, None)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(0, 1), (500, 0), (900, 1), (None, 1)], "doc_id long, toxic int")
    docs = docs_of(rows)
    few = toxicity.score(docs, toxicity.train(docs, labels, max_chars=2500)).collect()
    whole = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    for found in (few, whole):
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    by_id = collections.defaultdict(set)
    for r in whole:
        by_id[r["doc_id"]].add(r["score"])
    assert all(len(s) == 1 for s in by_id.values())
    assert toxicity.score(docs_of([]), toxicity.train(docs_of([]), labels)).count() == 0


def test_grams_are_of_characters():
    row, feature = toxicity.grams(["日本語", "ÉTÉ", "été"])
    assert (row == 0).sum() == 3 + 2 + 1 and sorted(feature[row == 1]) == sorted(feature[row == 2])


def _fingerprint(text):
    """From the definition, bit by bit."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    joined = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in joined]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_definition(docs_of):
    texts = ["", None, " \t", "One", "one two THREE", "Éa Bé cé DÉ eé", "a\x1cb c d e f", "a\xa0b c d e f"] + [_prose(k, k) for k in range(3, 60)]
    found = simhash.fingerprints(docs_of(list(enumerate(texts)))).collect()
    assert {r["id"]: r["w0"] % 2**64 for r in found} == {k: _fingerprint(t) for k, t in enumerate(texts)}


def test_label_model_by_plain_em():
    rng = np.random.default_rng(1)
    patterns = np.unique(rng.integers(-1, 2, (40, 4)), axis=0)
    counts = rng.integers(1, 60, len(patterns)).astype(float)
    found = quality_rules.fit_label_model(patterns, counts, rules=("a", "b", "c", "d"))
    total = counts.sum()
    pseudo, prior = 0.001 * total + 1, 0.8
    alarm, hit = [0.003] * 4, [0.3] * 4
    for _ in range(60):
        good = []
        for row, n in zip(patterns.tolist(), counts, strict=True):
            p, q = prior, 1 - prior
            for k, vote in enumerate(row):
                if vote:
                    p *= alarm[k] if vote < 0 else 1 - alarm[k]
                    q *= hit[k] if vote < 0 else 1 - hit[k]
            good.append(n * p / (p + q))
        for k in range(4):
            bad_votes, votes = patterns[:, k] < 0, patterns[:, k] != 0
            g, b = np.array(good), counts - np.array(good)
            alarm[k] = (g[bad_votes].sum() + pseudo * 0.003) / (g[votes].sum() + pseudo)
            hit[k] = (b[bad_votes].sum() + pseudo * 0.3) / (b[votes].sum() + pseudo)
        prior = (sum(good) + 0.8 * pseudo) / (total + pseudo)
    assert math.isclose(found.prior, math.log(prior / (1 - prior)), rel_tol=1e-9)
    for k, rule in enumerate("abcd"):
        assert np.allclose(found.weights[rule], (math.log(alarm[k] / hit[k]), math.log((1 - alarm[k]) / (1 - hit[k]))))


def test_posterior_follows_the_weights(docs_of):
    rows = [(k, _prose(k, 60) if k % 5 else " ".join(w + "###" for w in _prose(k, 60).split())) for k in range(100)] + [(0, _prose(0, 60)), (None, None)]
    found = quality_rules.judge(docs_of(rows)).collect()
    patterns = collections.Counter(tuple(r[f"vote_{k}"] for k in quality_rules.RULES) for r in found if not r["base_failed"])
    model = quality_rules.fit_label_model(np.array(list(patterns)), np.array(list(patterns.values()), dtype=float))
    for r in found:
        odds = model.prior + sum((model.weights[k][0] if r[f"vote_{k}"] < 0 else model.weights[k][1]) for k in quality_rules.RULES if r[f"vote_{k}"])
        assert math.isclose(r["quality"], 1 / (1 + math.exp(-odds)), rel_tol=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    assert len(found) == len(rows)


def test_site_rates_leave_the_document_out(spark):
    r = random.Random(3)
    rows = []
    for k in range(300):
        bad = r.random() < (0.1, 0.5, 0.9)[k % 3]
        rows.append((k, " ".join(w + ("$$" if bad else "") for w in _prose(k, 40).split()), ("a", "b", None)[k % 3], "en" if k % 2 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int("$$" not in t)) for k, t, _, _ in rows[::2]] + [(0, 0), (0, 1), (2, None)], "doc_id long, quality int")
    found = {x["doc_id"]: x for x in quality_classifier.classify(docs, labels).collect()}
    score = {k: found[k]["doc_score"] for k in found}
    host, path = collections.defaultdict(list), collections.defaultdict(list)
    for k, _, source, lang in rows:
        host[source].append(k)
        path[source, lang].append(k)
    rate = (sum(score.values()) + 1) / (len(score) + 2)

    def strength(sites, parent):
        between = sum(len(ids) * (sum(score[k] for k in ids) / len(ids) - parent(s)) ** 2 for s, ids in sites.items())
        noise = sum(parent(s) * (1 - parent(s)) for s in sites)
        whole = sum(len(ids) * parent(s) * (1 - parent(s)) for s, ids in sites.items())
        n = sum(map(len, sites.values()))
        return min(1e6, max(1.0, whole / n / max(1e-6, (between - noise) / n) - 1))

    total = lambda ids: sum(score[k] for k in ids)
    of_host = strength(host, lambda s: rate)
    of_path = strength(path, lambda s: (total(host[s[0]]) + of_host * rate) / (len(host[s[0]]) + of_host))
    for k, _, source, lang in rows:
        h = (total(host[source]) - score[k] + of_host * rate) / (len(host[source]) - 1 + of_host)
        p = (total(path[source, lang]) - score[k] + of_path * h) / (len(path[source, lang]) - 1 + of_path)
        odds = math.log(score[k] / (1 - score[k])) + math.log(p / (1 - p)) - math.log(rate / (1 - rate))
        assert math.isclose(found[k]["host_rate"], h, rel_tol=1e-6) and math.isclose(found[k]["path_rate"], p, rel_tol=1e-6)
        assert math.isclose(found[k]["score"], 1 / (1 + math.exp(-odds)), rel_tol=1e-5)


def test_ownership_decides(spark):
    r = random.Random(9)
    values = ["".join(r.choice("abcdef0123456789") for _ in range(32)) for _ in range(6)]
    rows, held = [], collections.defaultdict(set)
    for k in range(200):
        v = r.randrange(6)
        owner, repo = f"o{r.randrange(1 + v)}", f"r{r.randrange(1 + 2 * (v % 3))}"
        held[values[v]].add((owner, repo))
        rows.append((k, f"see {values[v]} here", owner, repo))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("uid", F.monotonically_increasing_id())
    found = secrets.scan(docs).where("kind = 2").collect()
    assert len(found) == 200
    for x in found:
        pairs = held[rows[x["id"]][1][4:36]]
        assert (x["n_owners"], x["n_repos"]) == (len({o for o, _ in pairs}), len(pairs))
        assert x["live"] == (len({o for o, _ in pairs}) <= secrets.MAX_OWNERS and len(pairs) <= secrets.MAX_REPOS)


def test_empty_tables(spark, docs_of, tmp_path):
    empty = docs_of([])
    assert secrets.redact(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write(cut(warc.chunked(pages, "page_id", "url", "html"), "chunks"), f"{shared_dir(spark)}/warc-none")
    assert warc.read(archives).count() == 0
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(k if k % 7 else None, _prose(k, 60), "en", f"s{k % 3}", 1, f"u{k}", k, "r") for k in range(60)] + [(5, _prose(5, 60), "en", "s0", 1, "again", 5, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _uid string, `a.b` long, row string")
    spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        assert {(r["_uid"], r["a.b"], r["row"]) for r in found.collect()} <= {(x[5], x[6], x[7]) for x in rows}, name
    assert corpus_pipeline.packing(spark, docs, "").agg(F.countDistinct("sequence_id")).first()[0] >= 1


@pytest.mark.parametrize("name", ["ids", "text", "score", "id", "a.b"])
def test_ids_of_any_name(docs_of, name):
    docs = docs_of([(1, "hello there"), (None, None)]).select(F.col("doc_id").alias(name), F.col("text").alias("body"))
    for found in (
        bpe.encode(docs, id_col=name, text_col="body"),
        toxicity.score(docs, toxicity.Weights(np.zeros(toxicity.SIZE, dtype=np.float32), 0.0), id_col=name, text_col="body"),
        simhash.near_duplicates(docs, id_col=name, text_col="body"),
        packing.pack(docs, id_col=name, text_col="body"),
        quality_rules.judge(docs, id_col=name, text_col="body"),
        sharding.shuffle_into_shards(docs, 2, id_col=name, text_col="body"),
    ):
        assert len(found.collect()) >= 2


def test_shards_are_uniform(spark, docs_of):
    """Over several seeds all groups of rows are evenly spread over the shards."""
    docs = docs_of([(k, "t") for k in range(480)])
    seen = collections.Counter()
    for seed in range(8):
        for r in sharding.shuffle_into_shards(docs, 4, parts=5, seed=seed).collect():
            seen[r["doc_id"] % 6, r["shard"]] += 1
    expected = 8 * 480 / 24
    assert sum((seen[a, b] - expected) ** 2 / expected for a in range(6) for b in range(4)) < 50  # 15 degrees of freedom, p < 1e-5


def test_packing_ids_are_the_librarys(docs_of):
    """Pieces encoded apart give the ids of whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    tokenizer.encode_special_tokens = True
    r = random.Random(2)
    rows = [(k, "".join(r.choice("ab cé'sre\n\t  1²!<|endoftext|>日") for _ in range(80))) for k in range(200)] + [(900, "y" * 20_000), (901, "<|endoftext|> x")]
    ids = collections.defaultdict(bytes)
    for x in sorted(packing.pack(docs_of(rows)).collect(), key=lambda x: x["start"]):
        ids[x["doc_id"]] += bytes(x["ids"])
    for k, t in rows:
        assert ids[k] == np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
