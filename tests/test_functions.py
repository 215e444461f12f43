import pytest
from pyspark.sql import functions as F

from thresher.functions import http, text, urls, values
from thresher.operators import jobs, matching, network
from thresher.operators.flatten import Walk, leaves
from thresher.sources.recorded import fetch


def _one(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)) if given else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("number", "shown"),
    [(1.0, "1"), (0.1, "0.1"), (-2.5, "-2.5"), (1e7, "10000000"), (123456789.5, "123456789.5"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.00012, "0.00012"), (1.5e-5, "0.000015"), (0.0, "0"), (1e20, "100000000000000000000")],
)
def test_number_text(spark, number, shown):
    assert _one(spark, values.number_text(F.lit(number))) == shown


@pytest.mark.parametrize(
    ("raw", "number"),
    [(" 24999 ", 24999.0), ("-42.5", -42.5), (".75", 0.75), ("1e3", 1000.0), ("1,234", None), ("", None), ("0x10", None), ("NaN", None), ("Infinity", None), ("1e999", None), ("₹24,999", None)],
)
def test_strict_numbers(spark, raw, number):
    found = _one(spark, values.to_number(values.string_value(F.col("raw"))), raw=raw)
    assert (found["value"]["n"] if found["value"] else None) == number
    assert found["code"] == (None if number is not None else "TYPE_CONVERSION_FAILED")


def test_unsupported_kinds(spark):
    null = values.value("null")
    for convert in (values.to_string, values.to_number, values.to_boolean, values.to_array):
        assert _one(spark, convert(null))["code"] == "UNSUPPORTED_VALUE"


@pytest.mark.parametrize(
    ("url", "identity"),
    [
        ("HTTP://A.example:80/x/?b=2&a=1&utm_source=f#top", "http://a.example/x?a=1&b=2"), ("https://a.example:8443/", "https://a.example:8443"), ("nonsense", None),
    ],
)
def test_identity(spark, url, identity):
    assert _one(spark, urls.base_identity(F.col("url")), url=url) == identity


def test_url_and_domain(spark):
    assert _one(spark, urls.valid_http_url(F.col("u")), u=" https://A.example. ") == "https://A.example."
    assert _one(spark, urls.valid_http_url(F.col("u")), u="ftp://a.example") is None
    assert _one(spark, urls.domain(F.col("u")), u="https://A.example./x") == "a.example"


@pytest.mark.parametrize(("key", "path"), [("name", "$.name"), ("sale-price", '$["sale-price"]'), ('a"b', '$["a\\"b"]')])
def test_json_path(spark, key, path):
    assert _one(spark, text.json_path(F.lit("$"), F.col("k")), k=key) == path


def test_guards(spark):
    for guard in (")]}'\n", "while(1);", "for (;;);", "﻿", ")]}',while(true);"):
        assert _one(spark, network.strip_guards(F.col("b")), b=guard + '{"a":1}') == '{"a":1}'


def test_greedy_budget_skips_and_goes_on(spark):
    assert _one(spark, network.greedy_budget(F.array(*map(F.lit, [3, 5, 2, 4])).cast("array<bigint>"), 6)) == [True, False, True, False]


def test_walk_limits():
    walk = Walk(nulls=False, blanks=False, vocabulary=False, max_depth=2, max_nodes=50, max_items=3, max_string=5, max_leaves=4)
    found = list(leaves({"a": [1.0, 2.0, 3.0, 4.0], "b": {"c": {"d": {"e": 1.0}}}, "__t": 1.0, " ": 2.0, "s": "toolong", "n": None}, walk))
    assert [f[1] for f in found if f[1]] == ["$.a[0]", "$.a[1]", "$.a[2]"]
    assert [f[4] for f in found if f[4]] == ["ARRAY_LIMIT_REACHED", "DEPTH_LIMIT_REACHED", "STRING_TOO_LARGE"]


def test_fetch_never_fails(spark):
    asked = spark.createDataFrame([(1, "http://a.example/"), (2, "http://b.example/"), (3, "http://c.example/")], "job_id long, url string")
    schema = "url string, status_code int, headers map<string, array<string>>, body binary, final_url string, redirects array<string>, error_code string, error_message string"
    recorded = spark.createDataFrame(
        [("http://a.example/", 200, {"Content-Type": ["text/html"]}, bytearray(b"x" * 20), "http://a.example/z", ["http://a.example/y"], None, None), ("http://b.example/", None, None, None, None, None, "ECONNRESET", "reset")],
        schema,
    )
    rows = {r["job_id"]: r for r in fetch(asked, recorded, max_body=10).collect()}
    assert rows[1]["body_truncated"] and len(rows[1]["raw_body"]) == 10 and rows[1]["redirects"] == ["http://a.example/y", "http://a.example/z"]
    assert rows[1]["headers"] == {"content-type": ["text/html"]} and rows[1]["transport_error"] is None
    assert rows[2]["status_code"] == 0 and rows[2]["transport_error"]["type"] == "CONNECTION_ERROR"
    assert rows[3]["transport_error"]["type"] == "DNS_ERROR"


def test_invalid_bytes_are_replaced(spark):
    assert spark.sql("select X'61FF62' as b").select(http.body_text(F.col("b")).alias("x")).first()["x"] == "a�b"


def _jobs(spark, rows):
    return spark.createDataFrame(rows, f"job_id long, requested_fields array<{jobs.FIELD_TYPE}>")


def test_empty_schema_and_no_data(spark):
    made = _jobs(spark, [(1, []), (2, [("a", "string", None, None, None, True)])])
    fields = jobs.requested_fields(made)
    none = spark.createDataFrame([], f"job_id long, ext_ord int, prop_ord int, key string, path string, value {values.TYPE}, source string, vocabulary string, extractor_id string, snippet string")
    candidates = matching.match(fields, none)
    assert {r["job_id"]: r["status"] for r in matching.extraction(made, fields, candidates).collect()} == {1: "NO_DATA", 2: "NO_DATA"}
    good, issues = matching.normalize(fields, matching.resolve(candidates))
    validation, found = matching.validate(made, fields, good, issues)
    assert {r["job_id"]: (r["status"], r["missing_fields"]) for r in validation.collect()} == {1: ("INVALID", []), 2: ("INVALID", ["a"])}
    assert [r["message"] for r in found.collect()] == ['Required field "a" is missing.']
    assert {r["decision"] for r in matching.outcome(validation).collect()} == {"PARSER_FAILURE"}


def test_forms_that_stay_as_they_are(spark):
    """What a pattern tells to be in its form already, and what only looks like it."""
    texts = ["", " ", "a", "a b", "a  b", " a", "a ", "a\n", "a\tb", "é è", "a\u00a0b", "w " * 5000 + "w", None]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(text.collapse(F.col("x"))).collect()
    assert [r[0] for r in got] == ["", "", "a", "a b", "a b", "a", "a", "a", "a b", "é è", "a b", "w " * 5000 + "w", None]
    keys = ["lot-code", "lot--code", "-a", "a-", "Lot Code:", "lot_code", "lotCode", "lot-code\n", "é-a", "a9-9", "", None]
    got = spark.createDataFrame([(x,) for x in keys], "x string").select(text.normalize_key(F.col("x"))).collect()
    assert [r[0] for r in got] == ["lot-code", "lot-code", "a", "a", "lot-code", "lot-code", "lot-code", "lot-code", "é-a", "a9-9", "", None]
