"""Merkle manifest of a dataset: a root over all rows, and a proof for each.

Every row is a leaf. The leaves of a group (a source) stand in order, 16 nodes in a row
become one until one is left, and the groups' subroots become the root in the same way. Leaves
are hashed in the JVM where they are read; texts never move. Leaves are range-partitioned and
numbered by prefix sums over one row for each group and partition, so a group of any size is
dealt over all tasks.

An aligned block of 16^2 nodes is one subtree. A task goes over it recursively, in postorder:
the digest of a subtree is returned, and while the recursion unwinds the siblings are
appended to every leaf that the subtree holds. First only block roots are kept; they are the
leaves of the next, 256 times smaller, distributed traversal. Then the traversals are run
again from the top, each block together with the path of its own root, which travels once a
block and not once a leaf. Only the last one hashes the whole proofs, where they stand.

Defined results: a null is written `-`, an empty text `0:`; a group that is null comes first
and is a group like any other; within a group null ids come first and rows of one id are
ordered by their leaves; equal rows are leaves of their own with equal digests and proofs of
their own; a lone leaf is its group's subroot and a lone group's subroot the root; an empty
table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, drop_cut, schema_of, table

FAN, HEIGHT = 16, 2
BLOCK = FAN**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(nodes: int) -> int:
    """Levels over so many nodes, within a block."""
    level = 0
    while FAN**level < min(nodes, BLOCK):
        level += 1
    return level


def traverse(nodes: Sequence[str], level: int, first: int, stop: int, paths: list[list[str]] | None = None) -> str:
    """The digest of the subtree of that level over nodes[first:stop]; paths get what stands left and right of each node, level by level."""
    if level == 0:
        return nodes[first]
    step = FAN ** (level - 1)
    spans = [(a, min(a + step, stop)) for a in range(first, stop, step)]
    below = [traverse(nodes, level - 1, a, b, paths) for a, b in spans]
    if paths is not None:
        for k, (a, b) in enumerate(spans):
            left, right = "".join(below[:k]), "".join(below[k + 1 :])
            for leaf in range(a, b):
                paths[leaf] += (left, right)
    return digest("".join(below))


def fold(node: str, path: Sequence[str]) -> str:
    """The root that a node and its path of left and right siblings give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        node = digest(left + node + right)
    return node


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with at, the place within the group from 0, and total, the group's size. The group isn't null."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "tie"]
    # The tie breaker is written down first: a task that runs again deals its rows as before.
    staged = cut(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-rows")
    dealt = staged.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    dealt = cut(dealt.withColumn("mark", F.monotonically_increasing_id()).withColumn("part", F.shiftright("mark", 33)), "merkle-dealt")
    drop_cut(staged)
    runs = dealt.groupBy(group, "part").agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    whole, earlier = Window.partitionBy(group), Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = runs.select(group, "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("base"), F.sum("n").over(whole).alias("total"))
    return dealt.join(bases, [group, "part"]).withColumn("at", F.col("mark") + F.col("base")).drop("part", "mark", "base")


def _blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.expr(f"at div {BLOCK}")).groupBy("group", "block")


def _in_order(block: pa.Table) -> tuple[pa.Table, list[str], int]:
    block = block.take(pc.sort_indices(block, sort_keys=[("at", "ascending")]))
    return block, block.column("digest").to_pylist(), height(block.column("total")[0].as_py())


def _up(nodes: DataFrame) -> DataFrame:
    """group, at, total, digest of the block roots."""

    def roots(block: pa.Table) -> pa.Table:
        block, digests, level = _in_order(block)
        total = -(-block.column("total")[0].as_py() // BLOCK)
        one = {"group": block.column("group")[:1], "at": block.column("block")[:1], "total": [total], "digest": [traverse(digests, level, 0, len(digests))]}
        return pa.table(one)

    return _blocks(nodes.select("group", "at", "total", "digest")).applyInArrow(roots, "group string, at bigint, total bigint, digest string")


def _climb(leaves: DataFrame) -> list[DataFrame]:
    """The leaves and the nodes of each further traversal; of the last there is one in each group."""
    stages = [leaves]
    while True:
        stages.append(cut(_up(stages[-1]), "merkle-nodes"))
        if (stages[-1].agg(F.max("total")).first()[0] or 1) == 1:
            return stages


_PATH = "path array<string>, subroot string, root string"


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """group, at, path, subroot and root of each node. above: the same of the block roots."""

    def paths(block: pa.Table, own: pa.Table) -> pa.Table:
        block, digests, level = _in_order(block)
        found: list[list[str]] = [[] for _ in digests]
        traverse(digests, level, 0, len(digests), found)
        n, further = len(digests), own.column("path")[0].as_py()
        columns = {"group": block.column("group"), "at": block.column("at"), "path": pa.array([p + further for p in found], pa.list_(pa.string()))}
        return pa.table(columns | {c: pa.array([own.column(c)[0].as_py()] * n) for c in ("subroot", "root")})

    by_block = above.withColumnRenamed("at", "block").groupBy("group", "block")
    return _blocks(nodes.select("group", "at", "total", "digest")).cogroup(by_block).applyInArrow(paths, f"group string, at bigint, {_PATH}")


def _proofs(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified. leaves also has presented, the leaf to prove."""
    schema = schema_of(leaves, ["id"], "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    def prove(block: pa.Table, own: pa.Table) -> pa.Table:
        block, digests, level = _in_order(block)
        found: list[list[str]] = [[] for _ in digests]
        traverse(digests, level, 0, len(digests), found)
        further, subroot, root = (own.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        whole = [p + further for p in found]
        folded = [fold(x, p) for x, p in zip(block.column("presented").to_pylist(), whole, strict=True)]
        columns = {"id": block.column("id"), "leaf": block.column("digest"), "subroot": [subroot] * len(whole), "root": [root] * len(whole)}
        return pa.table(columns | {"proof_sha256": [digest("".join(p)) for p in whole], "folded_root": folded, "verified": [x == root for x in folded]})

    by_block = above.withColumnRenamed("at", "block").groupBy("group", "block")
    return _blocks(leaves).cogroup(by_block).applyInArrow(prove, schema)


def leaf_of(values: Sequence[Column]) -> Column:
    shown = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*shown), 256)


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: Sequence[str] = COLUMNS, tampered: Column | None = None, changes: dict[str, Column] | None = None
) -> DataFrame:
    """The id column, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered: where the row to prove isn't the recorded one but has the values of `changes`.
    A proof is of the siblings, level by level from the leaf to the root, left to right.
    """
    recorded = leaf_of([column(c) for c in columns])
    other = leaf_of([(changes or {}).get(c, column(c)) for c in columns])
    presented = F.when(tampered, other) if tampered is not None else F.lit(None).cast("string")
    group = F.coalesce(F.concat(F.lit("="), column(group_col).cast("string")), F.lit(""))  # null first, then by bytes
    leaves = docs.select(column(id_col).alias("id"), group.alias("group"), recorded.alias("digest"), presented.alias("presented"))
    leaves = cut(numbered(leaves.withColumn("presented", F.coalesce("presented", "digest")), "group", ["id", "digest", "presented"]), "merkle-leaves")
    stages = _climb(leaves)
    subroots = stages[-1].select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    tops = cut(numbered(subroots, "group", ["name"]), "merkle-groups")
    above = _climb(tops)
    path = above[-1].select("group", "at", F.array().cast("array<string>").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(above[:-1]):
        path = cut(_down(nodes, path), "merkle-paths")
    path = tops.select("at", "name", "digest").join(path.drop("subroot"), "at").select(F.col("name").alias("group"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(stages[1:-1]):
        path = cut(_down(nodes, path), "merkle-paths")
    return _proofs(leaves, path).withColumnRenamed("id", id_col)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every fifth hashed id are presented with their texts in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(table(spark, sf_dir, "documents"), tampered=tampered, changes={"text": lowered})
