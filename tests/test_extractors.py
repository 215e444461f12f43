"""Users' extractors beside the engine's: order, support, failures; totals on the way."""

import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from thresher.functions.values import string_value
from thresher.operators.extractors import Extractor
from thresher.plans.extraction import extract

FIELD = "array(named_struct('name', 'grade', 'type', 'string', 'description', cast(null as string), 'aliases', cast(array() as array<string>), 'paths', cast(array() as array<string>), 'required', true))"


def _made():
    """A function that travels to workers by value, as they can't import the tests."""

    def comments(html):
        if "broken" in html:
            raise ValueError("broken")
        return [(m[1], f"comment[{k}]", m[2]) for k, m in enumerate(re.finditer(r"<!-- (\w+)=(\w+) -->", html))]

    return comments


_comments = _made()


def _spans(elements, key):
    return elements.where("tag = 'span'").select(key, "ord", F.lit("grade").alias("name"), F.concat(F.lit("span:"), F.col("ord").cast("string")).alias("path"), string_value(F.col("text")).alias("value"))


def _tables(spark, pages, extractors, **more):
    frame = spark.createDataFrame(pages, "job_id long, html string, kind string")
    return extract(frame.select("job_id", F.expr(FIELD).alias("requested_fields")), frame, extractors=extractors, **more)


PAGES = [(1, "<p>x</p><!-- grade=A --><span>S</span>", "a"), (2, "<p>broken</p><span>T</span>", "b"), (3, "<p>none</p>", "a"), (4, None, "a"), (5, "<!-- other=B --><!-- grade=C -->", "a")]


@pytest.mark.parametrize("first", ["comments", "spans"])
def test_order_of_registration_decides(spark, first):
    both = [Extractor("comments", of_page=_comments), Extractor("spans", of_elements=_spans)]
    t = _tables(spark, PAGES, both if first == "comments" else both[::-1])
    got = {r["job_id"]: (r["value"]["s"], r["evidence"]["extractor_id"]) for r in t["resolved"].collect()}
    assert got == {1: ("A", "comments") if first == "comments" else ("S", "spans"), 2: ("T", "spans"), 5: ("C", "comments")}
    assert [(r["job_id"], r["extractor_id"], r["code"]) for r in t["warnings"].collect()] == [(2, "comments", "EXTRACTOR_FAILED")]
    assert {r["job_id"]: r["status"] for r in t["validation"].collect()} == {1: "VALID", 2: "VALID", 3: "INVALID", 4: "INVALID", 5: "VALID"}


def test_support_and_failing_plans(spark):
    def lost(elements, key):
        return elements.select(key, F.col("no_such_column"))

    def late(elements, key):
        return _spans(elements, key).withColumn("name", F.raise_error(F.lit("late")).cast("string"))

    t = _tables(spark, PAGES, [Extractor("lost", of_elements=lost, supports=F.col("kind") == "b"), Extractor("late", of_elements=late), Extractor("spans", of_elements=_spans, supports=F.col("kind") == "b")])
    assert {(r["job_id"], r["value"]["s"]) for r in t["resolved"].collect()} == {(2, "T")}
    assert {(r["job_id"], r["extractor_id"]) for r in t["warnings"].collect()} == {(2, "lost"), *((k, "late") for k in range(1, 6))}


def test_values_of_any_kind(spark):
    def some(html):
        return [("grade", "a", 5), ("flag", "b", True), ("list", "c", ["x", 1]), ("none", "d", None), ("  ", "e", "blank name")]

    t = _tables(spark, PAGES[:1], [Extractor("some", of_page=some)])
    rows = {r["key"]: r["value"] for r in t["properties"].where("extractor_id = 'some'").collect()}
    assert (rows["grade"]["n"], rows["flag"]["b"], rows["list"]["a"], rows["none"]["kind"]) == (5.0, True, ["x", "1"], "null") and len(rows) == 4
    assert [(r["job_id"], r["code"]) for r in _tables(spark, PAGES[:1], [Extractor("odd", of_page=lambda html: [("grade", "a", object())])])["warnings"].collect()] == [(1, "EXTRACTOR_FAILED")]


def test_ids_are_told_apart(spark):
    with pytest.raises(ValueError, match="share"):
        _tables(spark, PAGES, [Extractor("x", of_page=_comments), Extractor("x", of_page=_comments)])
    with pytest.raises(ValueError, match="share"):
        _tables(spark, PAGES, [Extractor("meta", of_page=_comments)])
    with pytest.raises(ValueError, match="either"):
        Extractor("neither")


def test_totals_come_with_the_rows(spark):
    totals = Observation("totals")
    t = _tables(spark, PAGES, [Extractor("comments", of_page=_comments)], totals=totals)
    rows = t["validation"].collect()
    assert totals.get == {"total": 5, "valid": 2, "partial": 0, "invalid": 3} and len(rows) == 5
