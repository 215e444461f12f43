"""Extractors that users register beside the engine's own.

An extractor has an id, a column that says which pages it supports, and a function. Either
the function makes a DataFrame of properties from element rows, by joins and expressions
like the engine's own; or it is plain Python over one page's HTML, called in Arrow batches
where the page is, which is for what expressions can't say. Users' extractors come after
the engine's in the order in which they are registered, which decides between properties
that are otherwise equally good. One that fails costs its own properties alone: of the page
on which it failed, or, for functions over DataFrames, of all pages, and leaves a warning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as t
from ..functions.values import TYPE, shown
from ..sources.staging import stage
from .discovery import EXTRACTORS

SOURCE = "CUSTOM"
#: A property as functions over pages give it, a value of Python or None.
Found = tuple[str, str, "str | float | bool | list[str] | None"]
_ROWS = f"nth int, name string, path string, value {TYPE}, failed string"


@dataclass(frozen=True)
class Extractor:
    """id: of letters, digits, hyphens. Exactly one of of_elements and of_page is given.

    of_elements: element rows and the name of the key column to rows of key, ord, name, path
    and value. of_page: a page's HTML to (name, path, value). supports: of columns of pages.
    """

    id: str
    of_elements: Callable[[DataFrame, str], DataFrame] | None = None
    of_page: Callable[[str], Iterable[Found]] | None = None
    supports: Column | None = None

    def __post_init__(self):
        if (self.of_elements is None) == (self.of_page is None):
            raise ValueError(f"extractor {self.id!r} needs either a function of elements or one of pages")


def _value(x: object) -> dict:
    held = {"kind": "null", "s": None, "n": None, "b": None, "a": None}
    if isinstance(x, bool):
        return held | {"kind": "boolean", "b": x}
    if isinstance(x, str):
        return held | {"kind": "string", "s": x}
    if isinstance(x, (int, float)):
        return held | {"kind": "number", "n": float(x)}
    if isinstance(x, list):
        return held | {"kind": "array", "a": [str(v) for v in x]}
    if x is None:
        return held
    raise TypeError(f"a property can't be {type(x).__name__}")


def _over_pages(pages: DataFrame, key: str, fn: Callable[[str], Iterable[Found]]) -> DataFrame:
    """key, nth, name, path, value of what fn finds; a page on which it fails has one row with failed."""
    schema = StructType([pages.schema[key], *StructType.fromDDL(_ROWS).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = [{key: page, "nth": k, "name": str(n), "path": str(p), "value": _value(x), "failed": None} for k, (n, p, x) in enumerate(fn(html.as_py()))]
                except Exception as error:  # whatever a user's function raises is its page's warning
                    found = [{key: page, "nth": 0, "name": None, "path": None, "value": None, "failed": type(error).__name__}]
                rows += found
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return pages.where(F.col("html").isNotNull()).select(key, "html").mapInArrow(run, schema)


def _shaped(rows: DataFrame, key: str, ext_ord: int, extractor: str, order: Sequence[str]) -> DataFrame:
    """PROPERTY columns of rows of key, name, path, value."""
    named = rows.where((t.trim(F.col("name")) != "") & F.col("path").isNotNull() & F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return named.select(
        key, F.lit(ext_ord).alias("ext_ord"), place.alias("prop_ord"), F.col("name").alias("key"), "path", F.col("value").cast(TYPE).alias("value"), F.lit(SOURCE).alias("source"),
        F.lit("OTHER").alias("vocabulary"), F.lit(extractor).alias("extractor_id"), F.lit(None).cast("string").alias("source_ref"), t.snippet(shown(F.col("value"))).alias("snippet"),
    )


def _warnings(pages: DataFrame, key: str, ext_ord: int, extractor: str) -> DataFrame:
    return pages.select(key, F.lit(ext_ord).alias("ext_ord"), F.lit(extractor).alias("extractor_id"), F.lit("EXTRACTOR_FAILED").alias("code"))


def run_all(extractors: Sequence[Extractor], pages: DataFrame, elements: DataFrame, key: str = "job_id") -> tuple[list[DataFrame], list[DataFrame]]:
    """Properties and warnings of each extractor. pages: key, html and what `supports` reads; elements: their element rows."""
    ids = [*EXTRACTORS, *(e.id for e in extractors)]
    if repeated := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"extractors share the ids {repeated}")
    properties, warnings = [], []
    for nth, one in enumerate(extractors, start=max(EXTRACTORS.values()) + 1):
        fit = pages if one.supports is None else pages.where(F.coalesce(one.supports, F.lit(False)))
        if one.of_page is not None:
            found = stage(_over_pages(fit, key, one.of_page), "extracted")
            properties.append(_shaped(found.where("failed is null"), key, nth, one.id, ["nth"]))
            warnings.append(_warnings(found.where("failed is not null"), key, nth, one.id))
            continue
        mine = elements if one.supports is None else elements.join(fit.select(key).distinct(), key, "left_semi")
        try:
            found = stage(one.of_elements(mine, key).select(key, "ord", "name", "path", F.col("value").cast(TYPE).alias("value")), "extracted")
            properties.append(_shaped(found, key, nth, one.id, ["ord", "path"]))
        except Exception:  # the plan or its run failed: the other extractors go on
            warnings.append(_warnings(fit.select(key).distinct(), key, nth, one.id))
    return properties, warnings
