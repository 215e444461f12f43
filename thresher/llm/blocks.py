"""Groups of rows handed to numpy in bounded blocks.

`spread` splits each group's two sides into chunks of bounded size, so that a group is a
grid of (left chunk, right chunk) cells and no task ever holds a whole hot group.
`each_group` runs a function over runs of equal keys in sorted partitions; `links_of` does so
for functions that give links, and hands on no more of them than connect a task's nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import forest


def spread(rows: DataFrame, key: str, side: str, salt: str, chunk: int) -> DataFrame:
    """rows with `cell`, a long for (key, left chunk, right chunk).

    side is 0 for left rows and 1 for right ones. A left row goes to its own chunk paired
    with every right chunk, and the other way round; groups of one cell are not copied, and
    groups that lack a side are left out, as they have no pairs. The number of different
    keys must be bounded (a code's anchors, an index's bucket groups): their sizes are
    broadcast.
    """
    sizes = rows.groupBy(key).agg(
        F.ceil(F.count_if(F.col(side) == 0) / chunk).alias("left_chunks"),
        F.ceil(F.count_if(F.col(side) == 1) / chunk).alias("right_chunks"),
    )
    sized = rows.join(F.broadcast(sizes.where("left_chunks > 0 and right_chunks > 0")), key)
    is_left = F.col(side) == 0
    own = F.pmod(F.xxhash64(salt), F.when(is_left, F.col("left_chunks")).otherwise(F.col("right_chunks")))
    other = F.when(is_left, F.col("right_chunks")).otherwise(F.col("left_chunks"))
    grid = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    left, right = F.when(is_left, F.col("own")).otherwise(F.col("other")), F.when(is_left, F.col("other")).otherwise(F.col("own"))
    return grid.withColumn("cell", F.xxhash64(key, left, right)).drop("own", "other", "left_chunks", "right_chunks")


def grid_of(rows: DataFrame, key: str, side: str, salt: str, chunk: int) -> DataFrame:
    """As spread(), for any number of keys: their sizes are joined, and keys at which no two different rows can meet are left out.

    A left row also stands among the right rows of its key.
    """
    sizes = rows.groupBy(key).agg(F.count_if(F.col(side) == 0).alias("left"), F.count_if(F.col(side) == 1).alias("right"))
    chunks = sizes.where("left > 0 and right > 1").select(key, *(F.ceil(F.col(c) / chunk).alias(f"{c}_chunks") for c in ("left", "right")))
    is_left = F.col(side) == 0
    own, others = (F.when(is_left, F.col(f"{a}_chunks")).otherwise(F.col(f"{b}_chunks")) for a, b in (("left", "right"), ("right", "left")))
    sized = rows.join(chunks, key).withColumns({"own": F.pmod(F.xxhash64(salt), own), "other": F.sequence(F.lit(0).cast("long"), others - 1)})
    grid = sized.withColumn("other", F.explode("other"))
    left, right = F.when(is_left, F.col("own")).otherwise(F.col("other")), F.when(is_left, F.col("other")).otherwise(F.col("own"))
    return grid.withColumn("cell", F.xxhash64(key, left, right)).drop("own", "other", "left_chunks", "right_chunks")


Found = Iterator[pa.RecordBatch]


def _links(found: Found, most: int = 1_000_000) -> Found:
    """Batches a, b of links, joined to a spanning forest; at most `most` links wait."""
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        a, b = forest(whole.column("a").to_numpy(), whole.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in found:
        held.append(batch)
        n += batch.num_rows
        if n > most:
            held = [joined()]
            n = held[0].num_rows
            if n > most // 2:
                yield held[0]
                held, n = [], 0
    if held:
        yield joined()


def links_of(rows: DataFrame, cell: str, columns: Sequence[str], fn: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None], parts: int) -> DataFrame:
    """a, b: links between longs that connect what fn's links over the cells connect."""
    return each_group(rows, cell, columns, fn, "a bigint, b bigint", parts, _links)


def each_group(
    rows: DataFrame,
    cell: str,
    columns: Sequence[str],
    fn: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None],
    schema: str,
    parts: int,
    after: Callable[[Found], Found] = iter,
) -> DataFrame:
    """fn over the columns of each run of equal cells, as numpy arrays; its batches, or what `after` makes of a task's batches, are the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return after(found(batches))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(at, at[1:], strict=False):
                if held and held[-1].column(0)[0] != batch.column(0)[a]:
                    yield from done(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            if (out := fn({c: _numpy(whole.column(c)) for c in columns})) is not None:
                yield out

    picked = rows.select(cell, *columns).repartition(parts, cell).sortWithinPartitions(cell)
    return picked.mapInArrow(run, schema)


def _numpy(column: pa.ChunkedArray) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Of lists: all values, and the length of each list."""
    if pa.types.is_list(column.type):
        lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    return column.to_numpy()
