"""Approximate neighbours by multiprobe p-stable hashing.

Vectors get one more component that makes all lengths equal, so the largest inner product
is the least Euclidean distance. Each table cuts a number of Gaussian projections, which
grows with the table's size, into intervals; the tuple of intervals is a bucket. For a
query the probability that a neighbour falls into a bucket follows from the distances of
its projections to the interval bounds, and buckets are visited in that order. How many are
visited is fitted: a bounded sample of queries is compared with all vectors, and enough
buckets are taken that the wanted share of their true neighbours is met. Candidates of all
tables are merged and ranked by their exact product.

Only a query and a vector that lies in a bucket which the query visits are multiplied.
Buckets fall into groups and groups into grids of bounded cells, so that a query's vector
travels once for the buckets of a cell; pairs are never rows. Equal vectors are one vector
with its k + 1 least different ids: no result can need more. A query whose buckets hold too
few vectors goes on to all the others: it is compared with every vector, in blocks.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without an id; rows with a query's own id
are not its candidates; of an id's several vectors the best counts; with fewer candidates
than k all are returned; equal scores go by smaller id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import each_group, spread
from .common import column, cut, table

#: Projections are cut into two intervals; at most 2 ** MOST_PROJECTIONS buckets are put in a query's order.
TABLES, INTERVALS, MOST_PROJECTIONS = 8, 2, 14
#: Vectors that a bucket holds on average, components that a side of a cell holds, groups of a table's buckets.
IN_BUCKET, CELL_COMPONENTS, GROUPS = 8, 1 << 22, 4
_erf = np.vectorize(math.erf, otypes=[float])


@dataclass
class Index:
    """Projections and interval bounds of all tables, how neighbours scatter, and how many buckets are visited."""

    axes: np.ndarray  # table, projection, component
    bounds: np.ndarray  # table, projection
    length2: float  # the squared length that vectors are brought to
    groups: int = GROUPS  # of a table's buckets, by their first digits
    follow: float = 0.0  # a neighbour's projection is about follow * the query's ...
    scatter: float = 1.0  # ... give or take scatter
    visited: int = 1

    @property
    def buckets(self) -> int:
        return INTERVALS ** self.axes.shape[1]

    def project(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        """table, row, projection"""
        rest = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(0, self.length2 - (x * x).sum(axis=1)))
        return np.einsum("tpd,nd->tnp", self.axes, np.column_stack([x, rest]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """table, row: the bucket of each vector"""
        above = self.project(x, False) > self.bounds[:, None]
        return above @ (INTERVALS ** np.arange(self.axes.shape[1] - 1, -1, -1))

    def chances(self, queries: np.ndarray, t: int) -> np.ndarray:
        """query, bucket of table t: log probability that a neighbour lies there"""
        z = (self.bounds[t] - self.project(queries, True)[t] * self.follow) / self.scatter
        below = np.clip(0.5 * (1 + _erf(z / math.sqrt(2))), 1e-12, 1 - 1e-12)
        out = np.zeros((len(queries), 1))
        for low in below.T:
            out = np.stack([out + np.log(low)[:, None], out + np.log1p(-low)[:, None]], axis=2).reshape(len(queries), -1)
        return out

    def group(self, codes: np.ndarray) -> np.ndarray:
        return codes // max(1, self.buckets // self.groups)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    x = column(vector_col)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = vectors.where(column(id_col).isNotNull() & x.isNotNull() & F.forall(x, fine) & F.exists(x, lambda c: c != 0))
    sizes = good.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 0
    return good.where(F.size(x) == size).select(column(id_col).cast("long").alias("id"), x.alias("vector")), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best and of what may tie with them; -inf is none."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k][:, None]
        return np.nonzero((scores >= least - 1e-9 * (1 + np.abs(least))) & (scores > -np.inf))
    return np.nonzero(scores > -np.inf)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of pairs of rows, each summed in the same order."""
    return (a * b).sum(axis=1)


def _true_neighbours(distinct: DataFrame, queries: np.ndarray, size: int, k: int) -> list:
    """Rows query, vector: the k nearest other vectors of each sampled query, among all."""
    fixed = distinct.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), size)
            scores = fixed.value @ x.T
            itself = (fixed.value[:, None, 0] == x[None, :, 0]) & (fixed.value[:, None, -1] == x[None, :, -1])
            row, column = _best(np.where(itself, -np.inf, scores), k)
            picked = batch.column(0).take(pa.array(column))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(scores[row, column]), picked], names=["query", "score", "vector"])

    kind = distinct.schema["vector"].dataType.simpleString()
    found = distinct.select("vector").mapInArrow(run, f"query bigint, score double, vector {kind}")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("rank") <= k)
    return ranked.select("query", "vector").collect()  # k rows for each sampled query


def _index(n: int, size: int, length2: float, rng: np.random.Generator) -> Index:
    """Projections for n vectors: buckets of IN_BUCKET on average, as long as a query can order them."""
    projections = min(MOST_PROJECTIONS, max(3, math.floor(math.log2(max(1, n))) - IN_BUCKET.bit_length() + 1))
    # Axes of one table at right angles tell more than independent ones.
    square = [np.linalg.qr(rng.standard_normal((size + 1, size + 1)))[0][:, : min(projections, size + 1)].T for _ in range(TABLES)]
    more = [rng.standard_normal((projections - len(a), size + 1)) / math.sqrt(size + 1) for a in square]
    axes = np.stack([np.concatenate(pair) for pair in zip(square, more, strict=True)])
    return Index(axes, np.zeros(axes.shape[:2]), length2, visited=INTERVALS**projections)


def fit(distinct: DataFrame, asking: DataFrame, size: int, k: int, recall: float = 0.97, sample: int = 2000, probes: int = 64, seed: int = 5) -> Index:
    """Bounds from a sample of vectors; visited buckets from probes queries against all vectors."""
    rng = np.random.default_rng(seed)
    whole = distinct.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top"), F.count("*").alias("n")).first()
    index = _index(whole["n"], size, float(whole["top"] or 1.0), rng)
    drawn = distinct.orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    if not drawn:
        return index
    p = index.project(np.array([r["vector"] for r in drawn], dtype=np.float64), False)
    index.bounds = p.mean(axis=1) + rng.uniform(-0.1, 0.1, index.bounds.shape) * p.std(axis=1)
    asked = asking.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(probes).collect()
    if not asked:
        return index
    queries = np.array([r["vector"] for r in asked], dtype=np.float64)
    pairs = _true_neighbours(distinct, queries, size, k)
    if not pairs:
        return index
    of = np.array([r["query"] for r in pairs])
    near = np.array([r["vector"] for r in pairs], dtype=np.float64)
    q, n = index.project(queries, True)[:, of].ravel(), index.project(near, False).ravel()
    index.follow = float((q * n).sum() / max(1e-12, (q * q).sum()))
    index.scatter = max(1e-6, float((n - index.follow * q).std()))
    codes = index.codes(near)
    rank = np.stack([_rank(index.chances(queries, t)[of], codes[t]) for t in range(TABLES)])
    index.visited = int(np.quantile(rank.min(axis=0), recall, method="higher"))
    return index


def _rank(chances: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """As how manieth each row visits its bucket."""
    return (chances >= chances[np.arange(len(codes)), codes][:, None]).sum(axis=1)


_ROWS = ["key", "side", "codes", "ids", "vector"]


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _base_rows(index: Index, size: int):
    """Each vector once for each table, under the group of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            for t, codes in enumerate(index.codes(_matrix(batch.column(1), size))):
                key, side = pa.array(t * index.groups + index.group(codes)), pa.array(np.zeros(n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([key, side, _lists(codes, np.arange(n + 1)), batch.column(0), batch.column(1)], names=_ROWS)

    return run


def _query_rows(index: Index, size: int, rows_at_once: int = 512):
    """Each query once for each group that has buckets for it to visit, with those buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(k, rows_at_once)
                x = _matrix(batch.column(1), size)
                for t in range(TABLES):
                    chances = index.chances(x, t)
                    seen = np.sort(np.argpartition(-chances, index.visited - 1, axis=1)[:, : index.visited], axis=1)
                    codes = seen.ravel()
                    place = np.repeat(np.arange(len(x)), index.visited) * index.groups + index.group(codes)
                    starts = np.flatnonzero(np.diff(place, prepend=-1))
                    row, group = place[starts] // index.groups, place[starts] % index.groups
                    at, side = pa.array(row), pa.array(np.ones(len(row), dtype=np.int32))
                    lists = _lists(codes, np.append(starts, len(codes)))
                    columns = [pa.array(t * index.groups + group), side, lists, batch.column(0).take(at), batch.column(1).take(at)]
                    yield pa.RecordBatch.from_arrays(columns, names=_ROWS)

    return run


def _leaders(row: np.ndarray, column_: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's `most` best, and what may tie with the last of them."""
    order = np.lexsort((-score, row))
    row, column_, score = row[order], column_[order], score[order]
    last = np.searchsorted(row, row) + most - 1
    inside = last < np.searchsorted(row, row, side="right")
    least = np.where(inside, score[np.minimum(last, len(score) - 1)], -np.inf)
    kept = score >= least - 1e-9 * (1 + np.abs(least, where=inside, out=np.zeros(len(least))))
    return row[kept], column_[kept], score[kept]


def _visits(group: dict, base: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bucket of the cell: the queries that visit it and the vectors in it, as places in asked and base."""
    values, lengths = group["codes"]
    starts = np.cumsum(lengths) - lengths
    code = values[starts[base]]
    order = np.argsort(code, kind="stable")
    found, first = np.unique(code[order], return_index=True)
    vectors = np.split(order, first[1:])
    n = lengths[asked]
    visit = values[np.repeat(starts[asked] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    who = np.repeat(np.arange(len(asked)), n)[np.argsort(visit, kind="stable")]
    visit = np.sort(visit)
    bounds = np.searchsorted(visit, found), np.searchsorted(visit, found, side="right")
    for some, a, b in zip(vectors, *(x.tolist() for x in bounds), strict=True):
        if b > a:
            yield who[a:b], some


def _cell(size: int, k: int, per_id: int = 1, pairs_at_once: int = 1_000_000, pairs_held: int = 4_000_000):
    """Each query's k best ids of a cell; an id has at most per_id vectors, so that many times k + 1 vectors hold them."""
    most = (k + 1) * per_id

    def run(group: dict) -> pa.RecordBatch | None:
        base, asked = np.flatnonzero(group["side"] == 0), np.flatnonzero(group["side"] == 1)
        if not len(base) or not len(asked):
            return None
        x = group["vector"][0].astype(np.float64).reshape(-1, size)
        vectors, queries = x[base], x[asked]
        held: list[tuple[np.ndarray, ...]] = []
        n_held, room = 0, pairs_held
        for who, some in _visits(group, base, asked):
            step = max(1, pairs_at_once // len(some))
            for a in range(0, len(who), step):
                scores = queries[who[a : a + step]] @ vectors[some].T
                row, col = _best(scores, most)
                held.append((who[a : a + step][row], some[col], scores[row, col]))
                n_held += len(row)
                if n_held > room:
                    held = [_leaders(*map(np.concatenate, zip(*held, strict=True)), most)]
                    n_held = len(held[0][0])
                    room = max(pairs_held, 2 * n_held)  # ties may leave more
        if not held:
            return None
        row, col, _ = _leaders(*map(np.concatenate, zip(*held, strict=True)), most)
        return _by_id(group, queries, vectors, base[col], asked[row], row, col, k)

    return run


def _by_id(group: dict, queries, vectors, base: np.ndarray, asked: np.ndarray, row: np.ndarray, col: np.ndarray, k: int) -> pa.RecordBatch:
    """Pairs of a query and a vector as the k best ids of each query, with exact scores."""
    ids, n_ids = group["ids"]
    starts = np.cumsum(n_ids) - n_ids
    exact = _exact(queries[row], vectors[col])
    n = n_ids[base]
    pair = np.repeat(np.arange(len(row)), n)
    vec = ids[np.repeat(starts[base] - (np.cumsum(n) - n), n) + np.arange(len(pair))]
    query = ids[starts[asked[pair]]]
    other = vec != query
    row, query, vec, score = row[pair][other], query[other], vec[other], exact[pair][other]
    # An id with several vectors counts once, with its best.
    by_id = np.lexsort((-score, vec, row))
    again = np.zeros(len(row), dtype=bool)
    again[by_id[1:]] = (row[by_id[1:]] == row[by_id[:-1]]) & (vec[by_id[1:]] == vec[by_id[:-1]])
    row, query, vec, score = row[~again], query[~again], vec[~again], score[~again]
    best = np.lexsort((vec, -score, row))
    row, query, vec, score = row[best], query[best], vec[best], score[best]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.RecordBatch.from_arrays([pa.array(query[kept]), pa.array(vec[kept]), pa.array(score[kept])], names=["query_id", "vec_id", "score"])


def _compared(rows: DataFrame, size: int, k: int, per_id: int) -> DataFrame:
    """query_id, rank, vec_id, score over rows of both sides."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = spread(rows, "key", "side", "ids", max(256, CELL_COMPONENTS // size))
    found = each_group(cells, "cell", ["side", "codes", "ids", "vector"], _cell(size, k, per_id), "query_id bigint, vec_id bigint, score double", parts)
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query row.

    is_query is a condition on the column id.
    """
    usable, size = _usable(vectors, id_col, vector_col)
    usable = cut(usable.distinct(), "vectors")
    if not size:
        return usable.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    # Few rows of a vector that very many share leave their task: the limit works before the exchange.
    least = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    distinct = cut(
        usable.withColumn("nth", least).where(F.col("nth") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct-vectors"
    )
    per_id = usable.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    asking = usable.where(is_query)
    index = fit(distinct, asking, size, k)
    kind = vectors.schema[vector_col].dataType.simpleString()
    schema = f"key bigint, side int, codes array<int>, ids array<bigint>, vector {kind}"
    base = distinct.select("ids", "vector").mapInArrow(_base_rows(index, size), schema)
    asked = asking.select(F.array("id").alias("ids"), "vector")
    ranked = cut(_compared(base.unionByName(asked.mapInArrow(_query_rows(index, size), schema)), size, k, per_id), "ranked")
    full = ranked.where(F.col("rank") == k).select("query_id")
    short = asking.join(full, asking["id"] == full["query_id"], "left_anti")
    if short.isEmpty():
        return ranked
    # One key, whose chunks are the blocks; all of it counts as one bucket that every query visits.
    block = lambda rows, side: rows.select(
        F.lit(0).cast("long").alias("key"), F.lit(side).alias("side"), F.array(F.lit(0)).alias("codes"), "ids", "vector"
    )
    rest = _compared(block(distinct, 0).unionByName(block(short.select(F.array("id").alias("ids"), "vector"), 1)), size, k, per_id)
    return ranked.join(full, "query_id", "left_semi").select(*rest.columns).unionByName(rest)


def op2_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
