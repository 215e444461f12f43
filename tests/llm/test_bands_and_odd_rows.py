"""Bands of near-duplicates, the grid of crowded anchors, and odd rows of other operators."""

import numpy as np
from pyspark.sql import functions as F

from thresher.llm import approximate_neighbours, quality_classifier, simhash
from thresher.llm.blocks import grid_of


def test_bands_follow_the_similarity():
    """Sets of a similarity s share a band with chance s squared; a set of millions takes the same path as a small one."""
    r = np.random.default_rng(2)
    for s in (0.0, 0.5, 0.8, 1.0):
        shared = []
        for _ in range(150):
            n = 400
            both = round(2 * n * s / (1 + s))
            x = r.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n - both :])
            shared.append(np.mean(np.array(simhash.bands(a, 16)) == np.array(simhash.bands(b, 16))))
        assert abs(np.mean(shared) - s * s) < 0.03
    large = np.unique(r.integers(0, 2**63, 200_000, dtype=np.uint64))
    assert simhash.bands(large, 16) == simhash.bands(large.copy(), 16) and simhash.bands(large[:0], 16) == []


def test_every_pair_of_a_key_meets_in_one_cell(spark):
    """Keys of one row, of one side, and crowded ones."""
    r = np.random.default_rng(4)
    rows = [(int(k), int(s), int(n)) for k, s, n in zip(r.choice([1, 1, 1, 2, 3], 300), r.integers(0, 2, 300), range(300), strict=True)] + [(4, 0, 900), (5, 1, 901), (6, 0, 902), (6, 1, 902)]
    table = spark.createDataFrame(rows, "key long, side int, node long")
    cells = {}
    for x in grid_of(table, "key", "side", "node", 20).collect():
        cells.setdefault((x["key"], x["cell"]), ([], []))[x["side"]].append(x["node"])
    assert all(len(a) <= 60 and len(b) <= 60 for a, b in cells.values())
    met = [(k, a, b) for (k, _), (left, right) in cells.items() for a in left for b in right]
    want = [(k, a, b) for k, s, a in rows for q, t, b in rows if k == q and s == 0 and t == 1 and k < 4]
    assert sorted(met) == sorted(want)


def test_one_id_with_many_vectors(spark):
    """The best of an id's vectors counts once, and the others' places stay."""
    r = np.random.default_rng(6)
    rows = [(k, r.normal(size=8).tolist()) for k in range(60)] + [(7, (3 * r.normal(size=8)).tolist()) for _ in range(80)]
    found = approximate_neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=20).collect()
    query, best = rows[0][1], {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -np.inf), float(np.dot(query, v)))
    want = sorted(best, key=lambda i: (-best[i], i))[:20]
    got = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])]
    assert len(got) == 20 and len(set(got) & set(want)) >= 18 and all(abs(r["score"] - best[r["vec_id"]]) < 1e-9 for r in found)


def test_quality_of_null_ids(spark, docs_of, prose):
    rows = [(k, prose(k)) for k in range(40)] + [(None, prose(3)), (None, prose(4)), (None, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1)], "doc_id long, quality int")
    found = quality_classifier.classify(docs_of(rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
