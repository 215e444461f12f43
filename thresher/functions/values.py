"""The tagged value of a property, and its conversion to requested types.

A value is struct<kind, s, n, b, a>: kind is string, number, boolean, array or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

TYPE = "struct<kind: string, s: string, n: double, b: boolean, a: array<string>>"
NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
UNSUPPORTED, FAILED = "UNSUPPORTED_VALUE", "TYPE_CONVERSION_FAILED"


def value(kind: str, s: Column | None = None, n: Column | None = None, b: Column | None = None, a: Column | None = None) -> Column:
    none = lambda x, t: (x if x is not None else F.lit(None)).cast(t)
    return F.struct(
        F.lit(kind).alias("kind"), none(s, "string").alias("s"), none(n, "double").alias("n"), none(b, "boolean").alias("b"),
        none(a, "array<string>").alias("a"),
    )


def string_value(s: Column) -> Column:
    return value("string", s=s)


def number_text(n: Column) -> Column:
    """A double as JSON and browsers write it: no trailing .0, exponents from 1e21 and below 1e-6."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", n), "0+$", ""), r"\.$", "")
    shortest = n.cast("string")
    mantissa, power = F.split_part(shortest, F.lit("E"), F.lit(1)), F.split_part(shortest, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"[.-]", "")
    sign = F.when(n < 0, "-").otherwise("")
    whole = F.concat(sign, F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0"))
    split = F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    bare = F.regexp_replace(mantissa, r"\.0$", "")
    exponent = F.concat(bare, F.lit("e"), F.when(power > 0, "+").otherwise(""), power.cast("string"))
    return (
        F.when(n.isNull(), None).when(F.isnan(n), "NaN").when(n == float("inf"), "Infinity").when(n == float("-inf"), "-Infinity").when(n == 0, "0")
        .when(~shortest.contains("E"), F.regexp_replace(shortest, r"\.0$", ""))
        .when((power > 20) | (power < -6), exponent)
        .when(power < 0, small)
        .when(F.length(digits) <= power + 1, whole)
        .when(power >= 0, split)
        .otherwise(plain)
    )


def _attempt(ok: Column, converted: Column, failed: Column) -> Column:
    """struct<value, code>: the converted value, or else the code."""
    code = F.when(ok, None).when(failed, FAILED).otherwise(UNSUPPORTED)
    return F.struct(F.when(ok, converted).alias("value"), code.alias("code"))


def to_string(v: Column) -> Column:
    s = F.when(v["kind"] == "string", v["s"]).when(v["kind"] == "number", number_text(v["n"])).when(v["kind"] == "boolean", v["b"].cast("string"))
    return _attempt(v["kind"].isin("string", "number", "boolean"), string_value(s), F.lit(False))


def to_number(v: Column) -> Column:
    text = trim(v["s"])
    parsed = F.when(text.rlike(NUMBER), text.try_cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    n = F.when(v["kind"] == "number", v["n"]).when(v["kind"] == "string", parsed)
    return _attempt(v["kind"].isin("number", "string") & finite(n), value("number", n=n), v["kind"] == "string")


def to_boolean(v: Column) -> Column:
    text = F.lower(trim(v["s"]))
    b = F.when(v["kind"] == "boolean", v["b"]).when(text == "true", True).when(text == "false", False)
    return _attempt(v["kind"].isin("boolean", "string") & b.isNotNull(), value("boolean", b=b), v["kind"] == "string")


def to_array(v: Column) -> Column:
    return _attempt(v["kind"] == "array", value("array", a=v["a"]), F.lit(False))


def convert(v: Column, wanted: Column) -> Column:
    """struct<value, code> for the requested type; other types are unsupported."""
    return (
        F.when(wanted == "string", to_string(v)).when(wanted == "number", to_number(v)).when(wanted == "boolean", to_boolean(v))
        .when(wanted == "array", to_array(v)).otherwise(_attempt(F.lit(False), v, F.lit(False)))
    )


def issue_message(field: Column, wanted: Column, code: Column) -> Column:
    failed = F.concat(F.lit('Could not normalize field "'), field, F.lit('" to '), wanted, F.lit("."))
    unsupported = F.concat(F.lit('Value for field "'), field, F.lit('" is unsupported for '), wanted, F.lit("."))
    return F.when(code == FAILED, failed).when(code == UNSUPPORTED, unsupported)


def matches_type(v: Column, declared: Column, wanted: Column) -> Column:
    """Whether a normalized value has the requested type, both by name and by what it holds."""
    holds = (
        F.when(wanted == "string", v["s"].isNotNull()).when(wanted == "number", v["n"].isNotNull() & ~F.isnan(v["n"]) & (F.abs(v["n"]) < float("inf")))
        .when(wanted == "boolean", v["b"].isNotNull()).when(wanted == "array", v["a"].isNotNull())
    )
    return F.coalesce((declared == wanted) & (v["kind"] == wanted) & holds, F.lit(False))


def shown(v: Column) -> Column:
    """The value as a text, for reports: arrays as JSON."""
    return (
        F.when(v["kind"] == "string", v["s"]).when(v["kind"] == "number", number_text(v["n"])).when(v["kind"] == "boolean", v["b"].cast("string"))
        .when(v["kind"] == "array", F.to_json(v["a"]))
    )
