"""The pipeline's stages, each on its own input, against what plain Python says."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from thresher.llm import packing, simhash


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, docs_of, prose):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(k, prose(k, 90)) for k in range(300)]
    rows += [(1000 + k, prose(k, 90)) for k in range(20)]  # copies
    for k in range(20, 40):  # near copies: one word of ninety
        words = prose(k, 90).split()
        words[50] = "different"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000 + k, prose(5000 + k, 60) + " you idiot moronic fool") for k in range(60)]
    rows += [(3000 + k, " ".join(w + "***" for w in prose(6000 + k, 90).split())) for k in range(30)]
    rows += [(4000, "token = abcdefgh12345 " + prose(7000, 90)), (4001, None), (4002, "")]
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(folder / "documents.parquet"))
    marks = [(i, 1, int(2000 <= i < 3000)) for i, _ in rows if i < 3000]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        docs = corpus_pipeline.cut(docs, "test")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = set(range(300))
    assert clean <= set(seen["quality_rules"]) and not any(3000 <= i < 4000 or i > 4000 for i in seen["quality_rules"])
    assert clean <= set(seen["toxicity"]) and sum(2000 <= i < 3000 for i in seen["toxicity"]) <= 2
    kept = set(seen["simhash_near_dedup"])
    assert all((k in kept) != (1000 + k in kept) for k in range(40)) and set(range(40, 300)) <= kept
    assert set(seen["secret_scans"]) == kept
    assert seen["secret_scans"][4000]["text"].startswith("[REDACTED] ") and seen["secret_scans"][4000]["n_chars"] == len(seen["secret_scans"][4000]["text"])
    assert all(seen["secret_scans"][i]["text"] == seen["simhash_near_dedup"][i]["text"] for i in kept - {4000})

    packed = corpus_pipeline.packing(spark, docs, tables).collect()
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    by_doc = {}
    for r in sorted(packed, key=lambda r: r["start"]):
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], b"") + bytes(r["ids"])
    for i, r in seen["secret_scans"].items():
        assert by_doc[i] == np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4").tobytes()


def test_run_is_the_stages(spark, tables):
    assert "pipeline" in __spark_entry__.queries() and sum(n.startswith("op") for n in __spark_entry__.queries()) == 13
    found = corpus_pipeline.run(spark, tables)
    assert found.agg(F.countDistinct("doc_id")).first()[0] >= 300


def _set(text, size=5):
    words = text.lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def test_near_dedup_decides_by_sets(spark, docs_of, prose):
    """Pairs on either side of a similarity of 0.8, a chain across chunks, and texts that differ in repeats only."""
    rows = []
    for k in range(120):
        words = prose(9000 + k, 103 + k).split()
        rows.append((k, " ".join(words)))
        # Words changed at the end: 0.65 to 0.79 of the even ones, 0.8 to 0.9 of the odd ones.
        n = len(words) - 4
        share = 0.65 + 0.14 * k / 120 if k % 2 == 0 else 0.8 + 0.1 * k / 120
        changed = int(n * (1 - share) / (1 + share)) if k % 2 else -int(-n * (1 - share) // (1 + share))
        rows.append((1000 + k, " ".join(words[: len(words) - changed] + [f"x{k}y{j}" for j in range(changed)])))
    rows += [(2000, rows[1][1] + (" again and again once more" * 30)), (2001, rows[1][1] + " again and again once more" * 3)]
    docs = docs_of(rows).repartition(1).sortWithinPartitions("doc_id")
    sets = {i: _set(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    want = {i for i, r in root.items() if i == r}
    found = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").select("doc_id").collect()}
    assert {2 * k + 1000 for k in range(60)} <= want and not {2 * k + 1001 for k in range(60)} & want
    assert found == want
    few = simhash.alike(docs, "doc_id", chunk=40).where("node = root").select("node").collect()
    assert {r["node"] for r in few} == found


def test_near_dedup_finds_pairs_at_the_bound(spark, docs_of, prose):
    """300 lone pairs of a similarity of just 0.8, half of them with one phrase said over and over on one side."""
    rows = []
    for k in range(300):
        words = prose(20_000 + k, 94).split()
        phrase = [f"r{j}" for j in range(6)]
        head, tail = words, [f"t{k}a{j}" for j in range(10)]
        rows.append((k, " ".join(head + phrase + tail)))
        rows.append((1000 + k, " ".join(head + phrase * (1 + 30 * (k % 2)) + [f"t{k}b{j}" for j in range(10)])))
    sets = {i: _set(t) for i, t in rows}
    assert all(0.8 <= len(sets[k] & sets[1000 + k]) / len(sets[k] | sets[1000 + k]) < 0.83 for k in range(300))
    found = simhash.alike(docs_of(rows), "doc_id").collect()
    assert len(found) == 600 and sum(r["node"] != r["root"] for r in found) == 300
