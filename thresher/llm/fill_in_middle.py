"""Fill-in-the-middle training texts, made by DuckDB inside mapInArrow.

A text is a sequence of units, its lines. Two cuts, drawn from a hash of the document's id,
part it into prefix, middle and suffix, which are written in another order behind marks.
Tasks hand Arrow batches, in slices of bounded bytes, to an in-memory DuckDB of their own:
it finds the units, slices and joins them again and hashes the ids in SQL, and what returns
is Arrow as well, so no row becomes a Python object. `restore` is the way back.

Nothing is exchanged: each row is made where it is read, and a lost task is run again with
the same result, as all that is drawn follows from the id.

Defined results: a null text is an empty one; an empty text, or one that holds a mark, stays
as it is and is of the form plain, without counts of characters; a null id draws from the
seed alone; repeated rows get equal results; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import column, schema_of, slices, table

SEED, MARKS = "7", ("<P>", "<S>", "<M>")
_MAKE = r"""
WITH units AS (
  SELECT id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, sha256($seed || ':' || coalesce(CAST(id AS VARCHAR), '')) AS hash FROM batch),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(hash, k, 8) AS UBIGINT)) AS h,
    text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) AS odd FROM units),
cuts AS (SELECT *, CAST(h[1] % (n + 1) AS BIGINT) AS a, CAST(h[2] % (n + 1) AS BIGINT) AS b, odd OR h[3] % 100 >= $share AS stays FROM drawn),
parts AS (
  SELECT id, n, text, CASE WHEN stays THEN 'plain' WHEN h[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(list_slice(units, 1, least(a, b)), '') AS prefix, array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), '') AS middle,
    array_to_string(list_slice(units, greatest(a, b) + 1, n), '') AS suffix FROM cuts)
SELECT id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle ELSE $s || suffix || $p || prefix || $m || middle END AS output FROM parts"""
_RESTORE = """
WITH parts AS (
  SELECT *, split_part(output, $m, 1) AS head, split_part(output, $m, 2) AS middle, CASE form WHEN 'psm' THEN $s ELSE $p END AS second FROM batch),
two AS (SELECT *, split_part(substr(head, CASE form WHEN 'psm' THEN length($p) ELSE length($s) END + 1), second, 1) AS x, split_part(head, second, 2) AS y FROM parts)
SELECT * EXCLUDE (head, middle, second, x, y), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x || middle || y ELSE y || middle || x END AS restored FROM two"""


def _parted(marks: tuple[str, str, str]) -> dict[str, str]:
    """The marks as parameters. No mark may begin with what another ends with, or they couldn't be found again between texts that hold none."""
    if len(set(marks)) < 3 or any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))) or not all(marks):
        raise ValueError("marks must differ and must not overlap")
    return dict(zip("psm", marks, strict=True))


def _in_duckdb(sql: str, given: dict, text: str, schema: StructType):
    """A function for mapInArrow: the SQL over each slice of each batch, which it sees as `batch`."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for whole in batches:
                for at, n in slices(whole.column(whole.schema.get_field_index(text))):
                    con.register("batch", pa.Table.from_batches([whole.slice(at, n)]))
                    made = con.sql(sql, params=given).to_arrow_table()
                    con.unregister("batch")
                    yield from made.select(arrow.names).cast(arrow).to_batches()

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, marks: tuple[str, str, str] = MARKS, share: int = 100, spm: int = 50
) -> DataFrame:
    """The id column, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output, the text to train on.

    Of 100 documents `share` are changed, and of those `spm` put the suffix first.
    """
    ready = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    schema = schema_of(ready, ["id"], "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    given = _parted(marks) | {"seed": seed, "share": share, "spm": spm}
    return ready.mapInArrow(_in_duckdb(_MAKE, given, "text", schema), schema).withColumnRenamed("id", id_col)


def restore(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """made, rows of fill_in_middle(), with restored, the text that form and output stand for."""
    schema = schema_of(made, made.columns, "restored string")
    return made.mapInArrow(_in_duckdb(_RESTORE, _parted(marks), "output", schema), schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
