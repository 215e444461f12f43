"""SimHash near-duplicates by anchor-point covering.

A fingerprint's bits fall into parts. The anchors of a part are the words of a perfect
code: every point has one anchor within the covering radius, its home. A fingerprint is
stored at its home and copied to every anchor within the radius plus the differences that a
part may have; whatever is near it is met at the near one's home. Per anchor the stored and
the copied fingerprints are compared; links become components.

Two codes cover two uses. EXACT finds every pair of 64-bit fingerprints within 4 (or 5)
bits: of three parts one differs in at most 1 bit; Golay code of length 23, radius 3.

WIDE is for sets of shingles with a similarity of 0.8 or more, whose 256-bit fingerprints
differ in 15 % of their bits. Anchors alone would meet a fixed share of all pairs, so each of
its 16 parts, of 7 bits with the Hamming code, stands beside a band, a hash of the least two
of two random orders of the set, which alike sets share: rows meet at an anchor of an equal
band. Texts that share no band with another, as unrelated texts do, are left out before any
copy is made. Of pairs at 0.8 a part finds 46 %, all parts but 1 in 19,000.

Fingerprints only estimate a similarity, so alike() takes what meets as candidates. Their
components are blocks: within a block the sets of shingles themselves are compared, and what
is linked, and named by components of its own, are pairs whose sets are similar enough. As
unrelated texts share no band, a block is a family of texts that are alike in part, and
doesn't grow by chance as the corpus does. A large block is a grid of bounded cells.

Equal fingerprints (EXACT) or sets (WIDE) are one point, so copies are never compared. A
crowded anchor is a grid of bounded cells. For components cells return spanning stars of what
they link, not all pairs, and a task hands on a spanning forest of what its cells return.

Defined results: a null text has no words and so the fingerprint zero, which links like any
other; a null id never names a component; repeated rows are separate rows with equal
results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import grid_of, links_of, spread
from .common import column, cut, drop_cut, schema_of, slices, table
from .graph import components, star_edges


@dataclass(frozen=True)
class Cover:
    """words: 64-bit words of a fingerprint; parts: (word, first bit, bits); generator: of the cyclic code; slack: differences in a part; compared: words that distances are of."""

    words: int
    parts: tuple[tuple[int, int, int], ...]
    generator: int
    length: int
    radius: int
    slack: int
    compared: int = 1


#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the [23, 12] Golay code, x^3 + x + 1 the [7, 4] Hamming code.
EXACT = Cover(1, ((0, 0, 22), (0, 22, 21), (0, 43, 21)), 0b110001110101, 23, 3, 1)
WIDE = Cover(4, tuple((w, b, 7) for w in range(4) for b in (0, 7, 14, 21)), 0b1011, 7, 1, 1, 4)
#: Random orders of a set whose least elements make a band.
ORDERS = 2


def shingles(text: str | None, size: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles, with repeats; a shorter text is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype=np.uint64, count=n)


def fingerprint(text: str | None, size: int = 4, seed: int = 42, words: int = 1) -> list[int]:
    """Majority of the bits of the hashes of all word shingles; signed."""
    return majority(shingles(text, size, seed), words)


def majority(hashes: np.ndarray, words: int) -> list[int]:
    """Majority of the bits of the hashes; further words take the bits of the mixed hashes."""
    n, out = len(hashes), []
    if not n:
        return [0] * words
    for _ in range(words):
        set_bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big", signed=True))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, words: int = 1) -> DataFrame:
    """id and the words w0, ... of the fingerprint, longs."""
    names = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in slices(whole.column(1)):
                batch = whole.slice(at, n)
                values = [fingerprint(t.as_py(), size, words=words) for t in batch.column(1)]
                columns = [pa.array([v[k] for v in values], pa.int64()) for k in range(words)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    ready = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return ready.mapInArrow(run, schema_of(ready, ["id"], ", ".join(f"{n} bigint" for n in names)))


@cache
def _syndromes(cover: Cover) -> np.ndarray:
    """What remains of each single bit, divided by the generator polynomial."""
    degree, out = cover.generator.bit_length() - 1, []
    for k in range(cover.length):
        x = 1 << k
        for j in range(k, degree - 1, -1):
            if x >> j & 1:
                x ^= cover.generator << (j - degree)
        out.append(x)
    return np.array(out, dtype=np.int64)


@cache
def _patterns(cover: Cover, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of at most `most` bits, ordered by syndrome, then weight; where each syndrome starts."""
    found = [(0, 0, 0)]
    single = _syndromes(cover).tolist()
    for w in range(1, most + 1):
        for bits in combinations(range(cover.length), w):
            s = e = 0
            for k in bits:
                s, e = s ^ single[k], e | 1 << k
            found.append((s, w, e))
    found.sort()
    syndrome = np.array([f[0] for f in found])
    return np.array([f[2] for f in found], dtype=np.int64), np.searchsorted(syndrome, np.arange(2 ** (cover.generator.bit_length() - 1) + 1))


def anchors(points: np.ndarray, cover: Cover, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row index and anchor of every anchor within `most` bits of each point, nearest first."""
    patterns, starts = _patterns(cover, most)
    s = np.zeros(len(points), dtype=np.int64)
    for k, one in enumerate(_syndromes(cover).tolist()):
        s ^= np.where(points >> k & 1, one, 0)
    n = starts[s + 1] - starts[s]
    row = np.repeat(np.arange(len(points)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, points[row] ^ patterns[starts[s][row] + within]


def _replicas(cover: Cover):
    """Rows key, side, node and the compared words: side 0 at the home anchors, side 1 at every anchor near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(cover.words)]
            for number, (word, shift, width) in enumerate(cover.parts):
                point = (words[word].view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
                for side, most in ((0, cover.radius), (1, cover.radius + cover.slack)):
                    row, anchor = anchors(point, cover, most)
                    columns = [pa.array(number << cover.length | anchor), pa.array(np.full(len(row), side, dtype=np.int32))]
                    columns += [batch.column(0).take(pa.array(row)), *(pa.array(w[row]) for w in words[: cover.compared])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "side", "node", *batch.schema.names[1 : 1 + cover.compared]])

    return run


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links (row, column) that connect what the true cells of the matrix connect.

    In each round every row and every column takes one link to another component, so rounds
    grow with the logarithm of the number of rows.
    """
    n, m = near.shape
    a = b = np.zeros(0, dtype=np.int64)
    label = np.arange(n + m)
    while True:
        apart = near & (label[:n, None] != label[None, n:])
        rows, columns = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
        if not len(rows):
            return a, b - n
        a = np.concatenate([a, rows, apart[:, columns].argmax(axis=0)])
        b = np.concatenate([b, n + apart[rows].argmax(axis=1), n + columns])
        label = star_edges(n + m, a, b)


def _compare(words: list[str], distance: int, least: float | None = None, rows_at_once: int = 256):
    """Links of nodes within the distance, and, given least, of sizes that a similarity of least allows."""

    def run(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        nodes, at = np.unique(group["node"], return_index=True)
        number = np.searchsorted(nodes, group["node"])
        bits = [group[w][at].view(np.uint64) for w in words]
        size = group["size"][at] if least is not None else None
        left, right = (np.unique(number[group["side"] == s]) for s in (0, 1))
        a = b = np.zeros(0, dtype=np.int64)
        for k in range(0, len(left), rows_at_once):
            some = left[k : k + rows_at_once]
            differ = sum(np.bitwise_count(x[some][:, None] ^ x[right][None, :]).astype(np.int16) for x in bits)
            near = differ <= distance
            if least is not None:
                x, y = size[some][:, None], size[right][None, :]
                near &= np.minimum(x, y) >= least * np.maximum(x, y)
            i, j = _forest(near) if np.count_nonzero(near) > 4 * sum(near.shape) else np.nonzero(near)
            a, b = np.concatenate([a, some[i]]), np.concatenate([b, right[j]])
            if len(a) > 4 * len(nodes):  # many more links than a spanning star needs
                a, b = np.arange(len(nodes)), star_edges(len(nodes), a, b)
        root = star_edges(len(nodes), a, b)
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        if not len(tied):
            return None
        return pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], names=["a", "b"])

    return run


def link(points: DataFrame, distance: int = 4, cover: Cover = EXACT, chunk: int = 4096) -> DataFrame:
    """Links a-b that connect the nodes of points (node, w0, ...), distinct fingerprints, within the distance."""
    if cover is EXACT and distance >= len(cover.parts) * (cover.slack + 1):
        raise ValueError("the code doesn't reach all pairs at this distance")
    words = [f"w{k}" for k in range(cover.compared)]
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "key bigint, side int, node bigint, " + ", ".join(f"{w} bigint" for w in words)
    rows = points.select("node", *(f"w{k}" for k in range(cover.words))).mapInArrow(_replicas(cover), schema)
    cells = spread(rows, "key", "side", "node", chunk)
    return links_of(cells, "cell", ["side", "node", *words], _compare(words, distance), parts)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4, cover: Cover = EXACT
) -> DataFrame:
    """The id column, the fingerprint's words w0, ..., and component_id, the least id that links reach."""
    words = [f"w{k}" for k in range(cover.words)]
    prints = cut(fingerprints(docs, id_col, text_col, size, cover.words), "fingerprints")
    # Nodes need an order of their own, as ids may be null: of one word the word itself, else a number.
    node = F.col("w0") if cover.words == 1 else F.monotonically_increasing_id()
    points = cut(prints.groupBy(*words).agg(F.min("id").alias("least")).select(node.alias("node"), *words, "least"), "points")
    roots = components(link(points, distance, cover)).withColumnRenamed("node", "tied")
    rooted = points.join(roots, points["node"] == roots["tied"], "left").select(*words, "least", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted, "rooted")
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    labels = cut(rooted.join(named, "root").select(*words, "component_id"), "labels")
    return prints.join(labels, words).select(F.col("id").alias(id_col), *words, "component_id")


def bands(hashes: np.ndarray, parts: int, orders: int = ORDERS) -> list[int]:
    """For each part a hash of the least elements of its random orders of the set; signed. Sets of a similarity s share a band with chance s^orders."""
    if not len(hashes):
        return []
    salts = (np.arange(1, parts * orders + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[:, None]
    least = np.full(parts * orders, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 1 << 16):
        mixed = (hashes[None, k : k + (1 << 16)] ^ salts) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=1))
    least = least.reshape(parts, orders)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)]


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int, cover: Cover) -> DataFrame:
    """The id as node, hi and lo, which name the set of different shingles, the words w0, ... of its fingerprint, its bands and its size."""
    names = ["hi", "lo", *(f"w{k}" for k in range(cover.words))]

    def one(text: str | None) -> tuple[list[int], list[int], int]:
        hashes = np.unique(shingles(text, size))
        name = xxhash.xxh3_128_digest(hashes.tobytes())
        return [*(int.from_bytes(name[k : k + 8], "big", signed=True) for k in (0, 8)), *majority(hashes, cover.words)], bands(hashes, len(cover.parts)), len(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in slices(whole.column(1)):
                batch = whole.slice(at, n)
                values = [one(t.as_py()) for t in batch.column(1)]
                columns = [pa.array([v[0][k] for v in values], pa.int64()) for k in range(len(names))]
                columns += [pa.array([v[1] for v in values], pa.list_(pa.int64())), pa.array([v[2] for v in values], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", *names, "bands", "size"])

    schema = "node bigint, " + ", ".join(f"{n} bigint" for n in names) + ", bands array<bigint>, size bigint"
    return docs.select(column(id_col).alias("node"), column(text_col).alias("text")).mapInArrow(run, schema)


def _with_sets(size: int):
    """The text, last of the columns, as its sorted set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in slices(whole.column(whole.num_columns - 1)):
                batch = whole.slice(at, n)
                found = [np.unique(shingles(t.as_py(), size)).view(np.int64) for t in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "hashes"])

    return run


def _at_anchors(cover: Cover):
    """Rows key, side and the node's columns for rows part, band, node, w0, ... : side 0 at the part's home anchor, side 1 at every anchor near enough, each of that band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, band = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for number, (word, shift, width) in enumerate(cover.parts):
                at = np.flatnonzero(part == number)
                if not len(at):
                    continue
                words = batch.column(batch.schema.get_field_index(f"w{word}")).to_numpy(zero_copy_only=False)[at].view(np.uint64)
                point = (words >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
                for side, most in ((0, cover.radius), (1, cover.radius + cover.slack)):
                    row, anchor = anchors(point, cover, most)
                    mixed = band[at[row]].view(np.uint64) ^ ((anchor.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                    taken = batch.take(pa.array(at[row])).columns[2:]
                    yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(np.full(len(row), side, dtype=np.int32)), *taken], names=["key", "side", *batch.schema.names[2:]])

    return run


def _verify(words: list[str], distance: int, least: float, elements_at_once: int = 4_000_000):
    """Links that connect the nodes of a cell whose sets' Jaccard similarity is least or more; of a cell of two chunks only pairs across.

    Pairs further apart than the distance are none, as a similarity of least differs in far fewer bits.
    """

    def run(group: dict) -> pa.RecordBatch | None:
        values, lengths = group["hashes"]
        bits = [group[w].view(np.uint64) for w in words]
        chunk, starts, n = group["own"], np.cumsum(lengths) - lengths, len(lengths)
        across = (chunk != chunk[0]).any()
        known, ids = np.unique(values, return_inverse=True)
        marked, label = np.zeros(len(known), dtype=bool), np.arange(n)
        for i in range(n - 1):
            other = np.arange(i + 1, n)
            fits = (label[other] != label[i]) & (np.minimum(lengths[other], lengths[i]) >= least * np.maximum(lengths[other], lengths[i]))
            fits &= sum(np.bitwise_count(x[other] ^ x[i]).astype(np.int16) for x in bits) <= distance
            other = other[fits & ((chunk[other] != chunk[i]) | ~across)]
            if not len(other):
                continue
            marked[ids[starts[i] : starts[i] + lengths[i]]] = True
            ends = np.cumsum(lengths[other])
            cuts = np.searchsorted(ends, np.arange(0, ends[-1], elements_at_once), side="left").tolist()
            for a, b in zip(cuts, [*cuts[1:], len(other)], strict=True):
                some = other[a:b]
                if not len(some):
                    continue
                m = lengths[some]
                first = np.cumsum(m) - m
                at = np.repeat(starts[some] - first, m) + np.arange(m.sum())
                both = np.add.reduceat(marked[ids[at]], first, dtype=np.int64)
                near = some[both / (m + lengths[i] - both) >= least]
                label[np.isin(label, label[near])] = label[i]
            marked[ids[starts[i] : starts[i] + lengths[i]]] = False
        # Labels are places in the cell, so every tied node has one link to the node that its label names.
        tied = np.flatnonzero(label != np.arange(n))
        if not len(tied):
            return None
        return pa.RecordBatch.from_arrays([pa.array(group["node"][tied]), pa.array(group["node"][label[tied]])], names=["a", "b"])

    return run


def candidates(sets: DataFrame, distance: int, least: float, cover: Cover, chunk: int) -> DataFrame:
    """Links a-b that connect the nodes of sets (node, bands, size, w0, ...) that meet at an anchor of an equal band, near enough and of fitting sizes."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = [f"w{k}" for k in range(cover.words)]
    banded = sets.select("node", F.posexplode("bands").alias("part", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    met = cut(banded.join(shared, "band", "left_semi"), "met")
    points = cut(met.join(sets.select("node", "size", *words), "node").select("part", "band", "node", "size", *words), "points")
    drop_cut(met)
    rows = points.mapInArrow(_at_anchors(cover), "key bigint, side int, node bigint, size bigint, " + ", ".join(f"{w} bigint" for w in words))
    cells = grid_of(rows, "key", "side", "node", chunk)
    found = cut(links_of(cells, "cell", ["side", "node", "size", *words], _compare(words, distance, least), parts), "candidates")
    drop_cut(points)
    return found


def alike(
    docs: DataFrame, id_col: str, text_col: str = "text", size: int = 5, least: float = 0.8, distance: int = 62, cover: Cover = WIDE, chunk: int = 512
) -> DataFrame:
    """node, the id of each text, and root, the least id that equal sets of shingles and pairs of the similarity `least` or more lead to.

    The ids are longs, neither null nor repeated. Bands, cover and distance choose the
    candidates; what is linked is decided by the sets. At a similarity of 0.8 the 256 bits
    differ in 38, give or take 6. Texts are read again for candidates alone, which are told
    by their ids before anything heavier moves.
    """
    words = [f"w{k}" for k in range(cover.words)]
    raw = cut(_sketches(docs, id_col, text_col, size, cover), "sketches")
    sets = cut(raw.groupBy("hi", "lo").agg(F.min(F.struct("node", *words, "bands", "size")).alias("s")).select("hi", "lo", "s.*"), "sets")
    links = candidates(sets, distance, least, cover, 8 * chunk)
    blocks = cut(components(links), "blocks")
    whole = blocks.union(blocks.select(F.col("root").alias("node"), "root").distinct())
    sizes = whole.groupBy("root").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    members = cut(whole.join(sizes, "root").join(sets.select("node", *words), "node"), "members")
    wanted = cut(members.select("node"), "wanted")
    texts = docs.select(column(id_col).alias("node"), column(text_col).alias("text")).join(wanted, "node", "left_semi")
    shingled = texts.mapInArrow(_with_sets(size), "node bigint, hashes array<bigint>").join(members, "node")
    own = shingled.withColumn("own", F.pmod(F.xxhash64("node"), "chunks"))
    grid = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cells = grid.withColumn("cell", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    verified = cut(links_of(cells, "cell", ["node", "own", *words, "hashes"], _verify(words, distance + 16, least), parts), "verified")
    tied = components(verified).select(F.col("node").alias("first"), F.col("root").alias("to"))
    named = cut(sets.select("hi", "lo", F.col("node").alias("first")).join(tied, "first", "left").select("hi", "lo", F.coalesce("to", "first").alias("root")), "named")
    found = cut(raw.select("node", "hi", "lo").join(named, ["hi", "lo"]).select("node", "root"), "alike")
    for old in (raw, sets, links, blocks, members, wanted, verified, named):
        drop_cut(old)
    return found


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")
