"""Uniform sharding by a hypergeometric communication matrix.

The rows lie in parts. For every part the driver draws how many of its rows go to each
shard: a multivariate hypergeometric draw, part after part, from what the shards still
have room for. Rows are permuted within their part and dealt by those counts, then
permuted again within their shard. Together this is a uniform random permutation of all
rows cut into shards whose sizes are exact and differ by one at most.

Only counts pass through the driver (parts x shards numbers). Rows never do.

Defined results: a null text has no bytes (size 16, crc32 of no bytes: 0); equal and
repeated rows are separate rows; null ids are kept; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, fraction_of, table

#: numpy's exact sampler takes populations below this.
_NUMPY_LIMIT = 10**9


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; any population size."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good < _NUMPY_LIMIT and bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    lo, hi = max(0, n - bad), min(n, good)
    mean = n * (good / total)
    sd = math.sqrt(max(1.0, mean * (bad / total) * ((total - n) / max(1, total - 1))))
    a, b = max(lo, int(mean - 14 * sd)), min(hi, int(mean + 14 * sd) + 1)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return a + int(rng.choice(len(p), p=p / p.sum()))


def communication_matrix(part_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts of rows from each part to each shard; columns differ by one at most in sum."""
    rng = np.random.default_rng(seed)
    total = sum(part_rows)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for rows in part_rows:
        row, left, rest = [], rows, sum(room)
        for j in range(shards):
            rest -= room[j]
            x = draw_hypergeometric(rng, room[j], rest, left)
            row.append(x)
            left -= x
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int = 128,
    rows_per_block: int = 500_000,
    seed: int = 17,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: each shard a uniform sample in uniform order.

    parts: rows of the communication matrix; more of them for more data (each is sorted by
    one task, spilling as needed). rows_per_block: rows of a shard that one task orders.
    """
    spark = docs.sparkSession
    raw = F.coalesce(column(text_col), F.lit("")).cast("binary")
    narrow = cut(
        docs.select(
            column(id_col).alias("doc_id"),
            (F.octet_length(raw).cast("long") + 16).alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "shard-rows",
    )
    placed = narrow.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(parts)).cast("int"))

    counted = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    matrix = communication_matrix([counted.get(p, 0) for p in range(parts)], shards, seed)
    ends = json.dumps(np.cumsum(np.array(matrix, dtype=np.int64), axis=1).tolist())
    deal = spark.range(parts).select(
        F.col("id").cast("int").alias("part"),
        F.element_at(F.from_json(F.lit(ends), "array<array<bigint>>"), (F.col("id") + 1).cast("int")).alias("ends"),
    )

    # Local permutation, then the matrix deals the permuted rows.
    local = Window.partitionBy("part").orderBy(F.xxhash64("uid", F.lit(seed + 1)), "uid")
    dealt = (
        placed.withColumn("rank", F.row_number().over(local) - 1)
        .join(deal, "part")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
        .select("doc_id", "size", "text_crc32", "uid", "shard")
    )
    # Second permutation: blocks are ranges of a random key, so block order is key order.
    blocks = max(1, math.ceil(sum(counted.values()) / shards / rows_per_block))
    key = F.xxhash64("uid", F.lit(seed + 2))
    dealt = cut(
        dealt.withColumn("key", key).withColumn("block", F.floor(fraction_of(F.col("key")) * blocks).cast("int")),
        "shard-dealt",
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "block").count()
        .select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "block").orderBy(F.shiftrightunsigned("key", 11), "key", "uid")
    return (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
