"""The Merkle manifest and fill-in-middle texts against plain Python and their SQL, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from thresher.llm import fill_in_middle, merkle
from thresher.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group string, digest string, at long, total long, presented string, output string, form string, n long"
ODD = [None, "", "\n", "\n\n\n", "a", "é\n中", "x\r\ny\n", "no end\nlast", "a <P> b\nc", "<S>", "q<M>", "nul\x00in\nside", "<P\n>", "😀 z\n", "w\n" * 5000]


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _table(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars); further columns have names that the operators use."""
    return spark.createDataFrame([(*r, "g", "d", 1, 2, "p", "o", "f", 3) for r in rows], SCHEMA)


# --- Merkle manifest ----------------------------------------------------------------------


def _leaf(row, text):
    i, _, lang, source, n = row
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def _merged(level):
    """Root of the digests; for each leaf its siblings, level by level, as (left, right)."""
    paths, places = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for leaf, p in enumerate(places):
            paths[leaf].append(("".join(runs[p // 16][: p % 16]), "".join(runs[p // 16][p % 16 + 1 :])))
        level, places = [_sha("".join(r)) for r in runs], [p // 16 for p in places]
    return level[0], paths


def _manifest(rows):
    groups = {}
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None else None
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), _leaf(r, r[1]), _leaf(r, low) if tampered else _leaf(r, r[1]), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = _merged([x[1] for x in groups[s]])
    root, tops = _merged([trees[s][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for (_, leaf, shown, i), path in zip(groups[s], trees[s][1], strict=True):
            whole, node = path + tops[k], shown
            for a, b in whole:
                node = _sha(a + node + b)
            out[(i, leaf, trees[s][0], root, _sha("".join(a + b for a, b in whole)), node, node == root)] += 1
    return out


def _made(spark, rows):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle.manifest(_table(spark, rows), tampered=tampered, changes={"text": lowered})
    return Counter(tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("size", [1, 2, 16, 17, 256, 257, 4097])
def test_manifest_of_one_hot_source(spark, size):
    """Sizes around full runs and blocks, beside small sources, null and equal names that differ in case."""
    r = random.Random(size)
    rows = [(k, f"Text {k} {r.random()}", "en", "hot", k) for k in range(size)]
    rows += [(10_000 + k, f"É {k}", None, s, None) for k, s in enumerate(["b", "B", "é", "", None, None, "a"])]
    r.shuffle(rows)
    assert _made(spark, rows) == _manifest(rows)


def test_manifest_of_many_sources_and_odd_rows(spark):
    rows = [(k, t, None if k % 3 else "de", f"s{k}", k) for k, t in enumerate(ODD)] + [(k, f"T{k}", "fr", f"many{k}", 1) for k in range(300)]
    rows += [(None, "null id", "en", "s1", 1), (None, "Null id", "en", "s1", 1), (5, "Tie", "en", "s1", 1), (5, "tie", "en", "s1", 1)] + [(5, "same", None, "s2", 2)] * 20
    assert _made(spark, rows) == _manifest(rows)
    assert _made(spark, []) == Counter()


def test_manifest_of_a_lone_leaf(spark):
    found = _made(spark, [(1, "x", "en", "s", 1)])
    ((_, leaf, subroot, root, proof, folded, verified),) = found
    assert leaf == subroot == root == folded and verified and proof == _sha("")


def test_traversal_is_the_plain_tree():
    for n in (1, 2, 15, 16, 17, 100, 255, 256):
        nodes, paths = [_sha(str(k)) for k in range(n)], [[] for _ in range(n)]
        root = merkle.traverse(nodes, merkle.height(n), 0, n, paths)
        assert (root, [list(zip(p[::2], p[1::2], strict=True)) for p in paths]) == _merged(nodes)
        assert all(merkle.fold(x, p) == root for x, p in zip(nodes, paths, strict=True))


# --- fill-in-middle -----------------------------------------------------------------------


def _middle(i, text):
    t = text or ""
    lines, h = re.findall(r"[^\n]*\n|[^\n]+", t), _sha(f"7:{'' if i is None else i}")
    n, r = len(lines), [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if t == "" or any(m in t for m in ("<P>", "<S>", "<M>")):
        return (i, n, "plain", None, None, t, t)
    a, b = sorted((r[0] % (n + 1), r[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if r[3] % 100 < 50 else "psm"
    return (i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", t)


def test_middle(spark, prose):
    rows = [(k, ODD[k % len(ODD)], "en", "s", 1) for k in range(200)] + [(1000 + k, "\n".join(prose(k * 10 + j, 8) for j in range(k % 9)), "en", "s", 1) for k in range(200)]
    rows += [(None, "null\nid", "en", "s", 1), (7, "again\nand again", "en", "s", 1), (7, "again\nand again", "en", "s", 1), (9000, ("lang " * 40 + "\n") * 25_000, "en", "s", 1), (9001, "z" * 5_000_000, "en", "s", 1)]
    found = fill_in_middle.restore(fill_in_middle.fill_in_middle(_table(spark, rows)))
    assert Counter(map(tuple, found.collect())) == Counter(_middle(r[0], r[1]) for r in rows)
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(_table(spark, []))).count() == 0


def test_middle_shares_and_marks(spark, prose):
    rows = [(k, prose(k) + "\n" + prose(k + 1) + "\n", "en", "s", 1) for k in range(400)]
    made = fill_in_middle.restore(fill_in_middle.fill_in_middle(_table(spark, rows), marks=("{{p}}", "[s]", "<M>"), share=60, spm=20), marks=("{{p}}", "[s]", "<M>")).collect()
    forms = Counter(r["form"] for r in made)
    assert {r["doc_id"]: r["restored"] for r in made} == {r[0]: r[1] for r in rows} and 110 < forms["plain"] < 210 and forms["spm"] < forms["psm"] / 2
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "a", "b"), ("aa", "b", "c")):
        with pytest.raises(ValueError, match="marks"):
            fill_in_middle.fill_in_middle(_table(spark, rows), marks=bad)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_fill_in_middle"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert Counter(map(tuple, found)) == Counter(cursor.fetchall())
