"""What the corpus operators share: reading tables, cutting lineage by staging, names and batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.staging import shared_dir
from ..sources.staging import stage as cut
from ..sources.staging import unstage as drop_cut

__all__ = ["SPACE", "column", "cut", "drop_cut", "fraction_of", "packed", "quoted", "schema_of", "shared_dir", "slices", "table", "whole_row"]

#: ASCII white space, as the word rules of the operators define it.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fraction_of(hashed: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(2**53))


def quoted(name: str) -> str:
    """The name as Spark reads it whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col(quoted(name))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that none can clash with what a stage adds."""
    return F.struct(*(column(c).alias(c) for c in docs.columns))


def packed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns row, each row whole, and text; select("row.*") brings the rows back."""
    return docs.select(whole_row(docs).alias("row"), column(text_col).alias("text"))


def schema_of(docs: DataFrame, names: list[str], more: str) -> StructType:
    """The types of these columns of docs, followed by the fields that the text `more` declares."""
    held = [StructField(n, docs.schema[n].dataType) for n in names]
    return StructType([*held, *StructType.fromDDL(more).fields])


def slices(texts: pa.Array, most_bytes: int = 4 << 20, most_rows: int = 1000) -> Iterator[tuple[int, int]]:
    """First row and number of rows of consecutive slices of bounded bytes; a longer text is a slice of its own."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        stop = int(np.searchsorted(ends, before + most_bytes, side="right"))
        stop = min(max(stop, at + 1), at + most_rows)
        yield at, stop - at
        at = stop
