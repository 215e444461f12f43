"""Operators over whole corpora against brute force."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thresher.llm import approximate_neighbours, graph, quality_classifier, simhash, toxicity, warc
from thresher.llm.common import cut, shared_dir


def _components(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(50, k) for k in range(51, 80)] + [(r.randrange(90, 140), r.randrange(90, 140)) for _ in range(40)]
    root = _components(140, links)
    found = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found.get(k, k) == root[k] for k in range(140))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cover", [simhash.EXACT, simhash.WIDE])
def test_codes_are_perfect(cover):
    points = np.random.default_rng(0).integers(0, 1 << cover.length, 500)
    row, home = simhash.anchors(points, cover, cover.radius)
    assert row.tolist() == list(range(500))
    near = set(zip(*(x.tolist() for x in simhash.anchors(points, cover, cover.radius + cover.slack)), strict=True))
    for k in range(cover.length):
        _, moved = simhash.anchors(points ^ (1 << k), cover, cover.radius)
        assert all((i, a) in near for i, a in enumerate(moved.tolist()))


def test_simhash_against_brute_force(docs_of, prose):
    rows = []
    for k in range(120):
        words = prose(k, 80).split()
        rows.append((k, " ".join(words)))
        if k % 3 == 0:
            words[k % 80] = "changed"
            rows.append((1000 + k, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one TWO"), (0, rows[0][1]), (None, rows[5][1])]
    found = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(found) == len(rows)
    prints = sorted({simhash.fingerprint(t)[0] for _, t in rows})
    at = {f: k for k, f in enumerate(prints)}
    u = np.array(prints, dtype=np.int64).view(np.uint64)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4), strict=True)]
    root = _components(len(prints), links)
    least = {}
    for i, t in rows:
        if i is not None:
            k = root[at[simhash.fingerprint(t)[0]]]
            least[k] = min(least.get(k, i), i)
    texts = dict(rows)
    assert len(set(least.values())) < len(prints)
    for r in found:
        assert r["w0"] == simhash.fingerprint(texts[r["doc_id"]])[0] and r["component_id"] == least[root[at[r["w0"]]]]
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_crowded_anchors_are_split(spark):
    base = 0x0F0F_1234_5678_9ABC
    points = [base ^ (1 << k) for k in range(60)] + [base]
    made = spark.createDataFrame([(p if p < 2**63 else p - 2**64,) for p in points], "w0 long").withColumn("node", F.col("w0"))
    found = graph.components(simhash.link(made, chunk=4)).collect()
    assert {r["root"] for r in found} == {min(r["root"] for r in found)} and len(found) == 60


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.standard_normal((900, 16))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(x)]
    rows += [(1000, None, ""), (1020, [0.0] * 16, ""), (1040, [float("nan")] * 16, ""), (1060, [1.0] * 5, ""), (None, x[0].tolist(), ""), (1080, [None] * 16, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = {}
    for r in approximate_neighbours.search(table, F.col("id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y, hits = x.astype(np.float64), 0
    assert sorted(found) == list(range(0, 900, 20))
    for q, got in found.items():
        scores = (y * y[q]).sum(axis=1)
        scores[q] = -np.inf
        true = np.lexsort((np.arange(900), -scores))[:20].tolist()
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(s - scores[v]) < 1e-12 for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        hits += len(set(true) & {v for _, v, _ in got})
    assert hits >= 0.9 * 20 * len(found)
    few = approximate_neighbours.search(table.where("vec_id < 3"), F.col("id") == 0, k=20).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert approximate_neighbours.search(table.limit(0), F.col("id") == 0).count() == 0


def test_warc_round_trip(spark):
    big = "".join(random.Random(k).choice("abcdé<>") for k in range(300_000))
    rows = [(1, "http://a/", big), (2, "http://b/\r\nx", big), (3, None, "s" * 999), (4, "http://d/", "s" * 999), (5, "u", None), (None, "u", "é" * 600), (7, "u", "é" * 600), (7, "u", "é" * 600), (8, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("chunk", F.lit("clash"))
    chunks = cut(warc.chunked(pages, "page_id", "url", "html", chunk=1000), "chunks")
    archives = warc.write(chunks, f"{shared_dir(spark)}/warc-test")
    found = warc.read(archives, chunk=4096).collect()
    whole = {}
    for r in sorted(found, key=lambda r: r["chunk_no"]):
        whole.setdefault((r["record_id"], r["record_type"], r["refers_to"]), b"")
        if r["record_type"] == "response":
            whole[r["record_id"], r["record_type"], r["refers_to"]] += bytes(r["chunk"])
        so_far = whole[r["record_id"], r["record_type"], r["refers_to"]]
        assert r["bytes_so_far"] == len(so_far) and r["digest_so_far"] == hashlib.sha1(so_far).hexdigest()
    kinds = sorted((str(i), t, str(to)) for (i, t, to) in whole)
    assert kinds == sorted([
        ("1", "revisit", "2"), ("2", "response", "None"), ("3", "response", "None"), ("4", "response", "None"), ("5", "response", "None"), ("None", "revisit", "7"), ("7", "response", "None"),
        ("7", "revisit", "7"), ("8", "response", "None"),
    ])
    assert whole["2", "response", None] == big.encode()
    path = archives.first()["path"].removeprefix("file://")
    assert gzip.open(path).read(8) == b"WARC/1.1"


def _labelled(prose, n=400):
    rows, marks = [], []
    for k in range(n):
        words = prose(k, 30 + k % 300).split()
        if k % 5 == 0:
            for w in ("idiot", "moronic"):
                words.insert(k % len(words), w)
        rows.append((k, " ".join(words)))
        marks.append((k, int(k % 10 != 3), int(k % 5 == 0)))
    return rows, marks


def test_toxicity_on_held_out_rows(spark, docs_of, prose):
    rows, marks = _labelled(prose)
    docs = docs_of([*rows, (9000, None), (9001, ""), (None, "you idiot moronic")])
    labels = spark.createDataFrame([*marks, (1, None, None)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).withColumn("held_out", toxicity.held_out()).collect()
    truth = {k: t for k, _, t in marks}
    held = [r for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50
    right = sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held)
    assert right >= 0.95 * len(held)
    assert len(scored) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in scored)
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).select("score").distinct().collect()
    assert len(none) == 1 and none[0]["score"] < 0.3


def test_grams_are_whole_and_apart():
    row, feature = toxicity.grams(["abc", None, "ABC"])
    assert sorted(feature[row == 0].tolist()) == sorted(feature[row == 2].tolist())
    assert (row == 1).sum() == 0 and (row == 0).sum() == 3 + 2 + 1


def test_quality_classifier(spark, docs_of, prose):
    rows = [(k, prose(k, 60) if k % 4 else " ".join(w + "$$$" for w in prose(k, 60).split())) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(0, 400, 3)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality_classifier.classify(docs_of([*rows, (900, None)]), labels).collect()}
    assert sum(found[k]["kept"] == bool(k % 4) for k in range(400)) >= 396
    assert all(0 < r["path_rate"] < 1 and 0 <= r["score"] <= 1 for r in found.values()) and len(found) == 401
    unlabelled = quality_classifier.classify(docs_of(rows[:5]), labels.limit(0)).collect()
    assert [r["kept"] for r in unlabelled] == [True] * 5
    assert quality_classifier.classify(docs_of([]), labels).count() == 0


def test_repeated_rows_take_no_neighbours_place(spark):
    rng = np.random.default_rng(8)
    x = (10 + 0.1 * rng.standard_normal((60, 8))).astype(np.float32)
    x[1] = x[0] * np.float32(1.5)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1, x[1].tolist())] * 40 + [(2, x[3].tolist())] * 30
    rows += [(4, (x[0] * np.float32(1.2 + 0.01 * k)).tolist()) for k in range(30)]
    best = {}
    for i, v in rows:
        score = float((np.array(v, dtype=np.float32).astype(np.float64) * x[0].astype(np.float64)).sum())
        best[i] = max(score, best.get(i, -np.inf))
    del best[0]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = approximate_neighbours.search(table, F.col("id") == 0, k=20).collect()
    assert len(found) == 20 and len({r["vec_id"] for r in found}) == 20
    assert all(abs(r["score"] - best[r["vec_id"]]) < 1e-9 for r in found) and {1, 4} <= {r["vec_id"] for r in found}


def test_sparse_queries_get_all_their_rows(spark):
    """Tight clusters satisfy the sampled queries with few buckets; others lie far from all of them."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    x = centres[rng.integers(0, 6, 3000)] + 0.01 * rng.standard_normal((3000, 16))
    x[::300] = rng.standard_normal((10, 16))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    found = approximate_neighbours.search(table, F.col("id") % 20 == 0, k=20).groupBy("query_id").count().collect()
    assert len(found) == 150 and {r["count"] for r in found} == {20}
