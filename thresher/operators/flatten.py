"""JSON documents as property rows.

`flatten` is the one table function of the engine: it walks a document depth-first and
returns its leaves in order. What differs between JSON-LD blocks and captured responses is
in `Walk`.

The walk is one expression over a row: an array of nodes in which, level by level, every
container is replaced by itself and what it holds, so document order needs no sort and no
exchange. VARIANT says of what kind a value is, and whether a document is JSON at all; names
in order and the text below them come from maps of strings, as a VARIANT keeps its names
sorted. Limits are places in that array. VARIANT refuses objects with a repeated name, and
the readers of maps let through more than JSON; where the two differ, `leaves` decides, a
walk in Python over such documents alone.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import json_path, trim
from ..functions.values import TYPE
from ..sources.staging import dealt, stage

_NAME = re.compile(r"^[A-Za-z_$][A-Za-z0-9_$]*$")
LEAF = f"leaf_ord int, leaf_key string, path string, value {TYPE}, vocabulary string, warning string"


@dataclass(frozen=True)
class Walk:
    """Limits, and which leaves count. None: no limit."""

    nulls: bool = True
    blanks: bool = True
    vocabulary: bool = True
    max_depth: int | None = None
    max_nodes: int | None = None
    max_items: int | None = None
    max_string: int | None = None
    max_leaves: int | None = None


def _value(x: object) -> dict:
    empty = {"kind": "null", "s": None, "n": None, "b": None, "a": None}
    if isinstance(x, str):
        return empty | {"kind": "string", "s": x}
    if isinstance(x, bool):
        return empty | {"kind": "boolean", "b": x}
    if isinstance(x, (int, float)):
        return empty | {"kind": "number", "n": float(x)}
    if isinstance(x, list):
        return empty | {"kind": "array", "a": x}
    return empty


def _names_schema_org(x: object) -> bool:
    stack = [x]
    while stack:
        one = stack.pop()
        if isinstance(one, str) and "schema.org" in one.lower():
            return True
        stack.extend(one if isinstance(one, list) else one.values() if isinstance(one, dict) else ())
    return False


def _no_constant(name: str) -> float:
    raise ValueError(name)


def _number(text: str) -> float:
    return float(text)


def parse(text: str) -> object:
    """Strict JSON; numbers are doubles."""
    return json.loads(text, parse_constant=_no_constant, parse_int=_number)


def leaves(document: object, walk: Walk) -> Iterator[tuple[str | None, str | None, object, str, str | None]]:
    """(key, path, value, vocabulary, None) of each leaf in order, and a (None, None, None, '', code) for the first breach of each limit."""
    warned: set[str] = set()

    def warn(code: str) -> Iterator[tuple]:
        if code not in warned:
            warned.add(code)
            yield None, None, None, "", code

    root = "OTHER" if not walk.vocabulary or not _names_schema_org(document) else "SCHEMA_ORG"
    stack = [(document, "$", None, 0, root)]
    nodes = found = 0
    while stack:
        x, path, key, depth, words = stack.pop()
        nodes += 1
        if walk.max_nodes is not None and nodes > walk.max_nodes:
            yield from warn("NODE_LIMIT_REACHED")
            return
        if walk.max_depth is not None and depth > walk.max_depth:
            yield from warn("DEPTH_LIMIT_REACHED")
            continue
        if isinstance(x, dict):
            if walk.vocabulary and "@context" in x:
                words = "SCHEMA_ORG" if _names_schema_org(x["@context"]) else "OTHER"
            below = []
            for name, child in x.items():
                if walk.blanks or (name.strip() and not name.startswith("__")):
                    tail = f".{name}" if _NAME.match(name) else f"[{json.dumps(name, ensure_ascii=False)}]"
                    below.append((child, path + tail, name, depth + 1, words))
            stack.extend(reversed(below))
            continue
        if isinstance(x, list):
            over = walk.max_items is not None and len(x) > walk.max_items
            if over:
                yield from warn("ARRAY_LIMIT_REACHED")
            fits = lambda s: isinstance(s, str) and (walk.blanks or bool(s.strip())) and (walk.max_string is None or len(s) <= walk.max_string)
            if key is None or not x or over or not all(map(fits, x)):
                some = x[: walk.max_items] if over else x
                stack.extend(reversed([(child, f"{path}[{k}]", key, depth + 1, words) for k, child in enumerate(some)]))
                continue
        if key is None or (x is None and not walk.nulls) or (isinstance(x, float) and not math.isfinite(x)):
            continue
        if isinstance(x, str):
            if not walk.blanks and not x.strip():
                continue
            if walk.max_string is not None and len(x) > walk.max_string:
                yield from warn("STRING_TOO_LARGE")
                continue
        if walk.max_leaves is not None and found >= walk.max_leaves:
            yield from warn("PROPERTY_LIMIT_REACHED")
            return
        found += 1
        yield key, path, x, words, None


def _in_python(documents: DataFrame, keep: Sequence[str], walk: Walk) -> DataFrame:
    """flatten() by `leaves`. documents: the columns to keep, and json."""
    schema = StructType([documents.schema[c] for c in keep] + StructType.fromDDL(LEAF).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, kept = row["json"], {c: row[c] for c in keep}
                try:
                    found = leaves(parse(text), walk)
                except (ValueError, RecursionError):
                    found = iter([(None, None, None, "", "MALFORMED_JSON")])
                for k, (key, path, x, words, warning) in enumerate(found):
                    rows.append(kept | {"leaf_ord": k, "leaf_key": key, "path": path, "value": _value(x) if path else None, "vocabulary": words, "warning": warning})
                    if len(rows) > 5000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return documents.mapInArrow(run, schema)


#: Documents that nest deeper are left to `leaves`.
_DEEPEST = 900
_ESCAPE, _STRING = r"\\.", '"[^"]*"'
#: The fields of a node.
_NODE = "path string, key string, depth int, kind string, text string, items array<string>, words string, code string, leaf boolean, open boolean"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kind(shown: Column, raw: Column) -> Column:
    """Of a value, by its JSON and by what a map of strings holds of it; infinite numbers, which JSON can't say, are none."""
    mark = F.substring(shown, 1, 1)
    infinite = shown.isin('"Infinity"', '"-Infinity"') & (raw == shown)
    return (
        F.when(raw.isNull() | shown.isNull() | (mark == "n"), "null").when(infinite, "infinite").when(mark == '"', "string").when(mark == "{", "object")
        .when(mark == "[", "array").when(mark.isin("t", "f"), "boolean").otherwise("number")
    )


def _names_it(shown: Column) -> Column:
    """Whether a string among the values, names left out, contains schema.org. shown: canonical JSON."""
    return F.contains(F.regexp_replace(F.regexp_replace(F.lower(shown), _ESCAPE, " "), rf"{_STRING}\s*:", ""), F.lit("schema.org"))


def _node(walk: Walk, path: Column, key: Column, depth: Column, kind: Column, text: Column, words: Column) -> Column:
    """A node just met: containers are open, others are leaves if they count."""
    none, deep = F.lit(None), depth > walk.max_depth if walk.max_depth is not None else F.lit(False)
    blank = trim(text) == "" if not walk.blanks else F.lit(False)
    long = F.length(text) > walk.max_string if walk.max_string is not None else F.lit(False)
    counts = key.isNotNull() & ~deep & (kind.isin("number", "boolean") | ((kind == "null") & F.lit(walk.nulls)) | ((kind == "string") & ~blank & ~long))
    code = F.when(deep, "DEPTH_LIMIT_REACHED").when(key.isNotNull() & (kind == "string") & ~blank & long, "STRING_TOO_LARGE")
    return F.struct(
        path.alias("path"), key.alias("key"), depth.cast("int").alias("depth"), kind.alias("kind"), text.alias("text"), none.cast("array<string>").alias("items"),
        words.alias("words"), code.alias("code"), counts.alias("leaf"), (kind.isin("object", "array") & ~deep).alias("open"),
    )


def _closed(n: Column, code: Column | None = None, items: Column | None = None) -> Column:
    """The container, looked into; with items it is a leaf. Its text is needed no more."""
    return F.struct(
        n["path"].alias("path"), n["key"].alias("key"), n["depth"].alias("depth"), n["kind"].alias("kind"), F.lit(None).cast("string").alias("text"),
        (n["items"] if items is None else items).alias("items"), n["words"].alias("words"), (n["code"] if code is None else code).alias("code"),
        F.lit(items is not None).alias("leaf"), F.lit(False).alias("open"),
    )


def _members(walk: Walk, n: Column) -> Column:
    """The object and its members in order."""

    def listed(pairs: Column) -> Column:
        words = n["words"]
        if walk.vocabulary:
            context = F.filter(pairs, lambda p: p["name"] == "@context")
            words = F.when(F.size(context) > 0, F.when(_names_it(F.get(context, F.lit(0))["shown"]), "SCHEMA_ORG").otherwise("OTHER")).otherwise(words)
        kept = pairs if walk.blanks else F.filter(pairs, lambda p: (trim(p["name"]) != "") & ~p["name"].startswith("__"))
        one = lambda p, words: _node(walk, json_path(n["path"], p["name"]), p["name"], n["depth"] + 1, p["kind"], p["raw"], words)
        return _let(words, lambda w: F.concat(F.array(_closed(n)), F.transform(kept, lambda p: one(p, w))))

    texts, variants = F.from_json(n["text"], "map<string,string>"), F.from_json(n["text"], "map<string,variant>")
    shown = F.transform(F.map_values(variants), lambda v: F.to_json(v))
    pairs = _let(texts, lambda t: F.arrays_zip(F.map_keys(t).alias("name"), F.map_values(t).alias("raw"), shown.alias("shown")))
    return _let(F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["raw"].alias("raw"), p["shown"].alias("shown"), _kind(p["shown"], p["raw"]).alias("kind"))), listed)


def _items(walk: Walk, n: Column) -> Column:
    """The array as one leaf, if it is strings that count, or the array and its items in order."""

    def listed(pairs: Column) -> Column:
        over = F.size(pairs) > walk.max_items if walk.max_items is not None else F.lit(False)
        blank = lambda x: trim(x) == "" if not walk.blanks else F.lit(False)
        long = lambda x: F.length(x) > walk.max_string if walk.max_string is not None else F.lit(False)
        fits = F.forall(pairs, lambda p: (p["kind"] == "string") & ~blank(p["raw"]) & ~long(p["raw"]))
        some = F.slice(pairs, 1, walk.max_items) if walk.max_items is not None else pairs
        path = lambda k: F.concat(n["path"], F.lit("["), k.cast("string"), F.lit("]"))
        below = F.transform(some, lambda p, k: _node(walk, path(k), n["key"], n["depth"] + 1, p["kind"], p["raw"], n["words"]))
        whole = n["key"].isNotNull() & (F.size(pairs) > 0) & ~over & fits
        leaf = F.array(_closed(n, items=F.transform(pairs, lambda p: p["raw"])))
        return F.when(whole, leaf).otherwise(F.concat(F.array(_closed(n, code=F.when(over, "ARRAY_LIMIT_REACHED").otherwise(n["code"]))), below))

    shown = F.transform(F.from_json(n["text"], "array<variant>"), lambda v: F.to_json(v))
    pairs = F.arrays_zip(F.from_json(n["text"], "array<string>").alias("raw"), shown.alias("shown"))
    return _let(F.transform(pairs, lambda p: F.struct(p["raw"].alias("raw"), _kind(p["shown"], p["raw"]).alias("kind"))), listed)


def _stop(code: str) -> Column:
    """A warning that ends the walk."""
    return F.array(F.from_json(F.lit(json.dumps({"code": code, "leaf": False, "open": False})), "struct<" + ", ".join(c.replace(" ", ": ") for c in _NODE.split(", ")) + ">"))


def _events(walk: Walk, nodes: Column) -> Column:
    """Leaves and warnings in order, as far as the limits let the walk go."""
    told = lambda x: F.filter(x, lambda n: n["leaf"] | n["code"].isNotNull())
    event = told(nodes)
    if walk.max_nodes is not None:
        event = F.when(F.size(nodes) > walk.max_nodes, F.concat(told(F.slice(nodes, 1, walk.max_nodes)), _stop("NODE_LIMIT_REACHED"))).otherwise(event)
    if walk.max_leaves is not None:
        beyond = lambda e: F.get(F.filter(F.transform(e, lambda n, k: F.when(n["leaf"], k)), lambda k: k.isNotNull()), F.lit(walk.max_leaves))
        cut = lambda e: _let(beyond(e), lambda k: F.when(k.isNotNull(), F.concat(F.slice(e, F.lit(1), k), _stop("PROPERTY_LIMIT_REACHED"))).otherwise(e))
        event = _let(event, lambda e: F.when(F.size(e) > walk.max_leaves, cut(e)).otherwise(e))
    # Of each warning the first alone.
    once = lambda e, codes: F.filter(e, lambda n, k: n["leaf"] | (F.array_position(codes, n["code"]) == k + 1))
    return _let(event, lambda e: _let(F.transform(e, lambda n: n["code"]), lambda codes: once(e, codes)))


def _nesting(brackets: Column) -> Column:
    """now, most and ends of a row of brackets: the depth at its end, the greatest, and how often it came back to none."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("ends"))

    def step(s: Column, c: Column) -> Column:
        opens = c.isin("{", "[")
        now = s["now"] + F.when(opens, 1).when(c == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"), (s["ends"] + F.when((now == 0) & (c != "") & ~opens, 1).otherwise(0)).alias("ends"))

    return F.aggregate(F.split(brackets, ""), start, step)


def _walked(documents: DataFrame, keep: Sequence[str], walk: Walk) -> DataFrame:
    """The columns to keep and LEAF, and odd: the text where `leaves` has to decide. documents: the columns to keep, and json."""
    # Without strings: brackets tell how deep a document nests, and whether something follows its end.
    bare = F.trim(F.regexp_replace(F.regexp_replace("json", _ESCAPE, " "), _STRING, "s"))
    seen = documents.select(*keep, "json", bare.alias("bare"), F.to_json(F.try_parse_json("json")).alias("shown"))
    nested = seen.select(*keep, "json", "bare", "shown", _nesting(F.regexp_replace("bare", r"[^\[\]{}]", "")).alias("nesting"))
    holds, last = F.substring("bare", 1, 1).isin("{", "["), F.regexp_extract("bare", r"([\]}])\s*$", 1)
    alone = F.regexp_like("bare", F.lit(r"^(?:s|[-+.\w]+)$"))  # a lone scalar
    good = F.col("shown").isNotNull() & F.when(holds, (F.col("nesting.ends") == 1) & (last != "")).otherwise(alone)
    lenient = F.from_json("json", "map<string,string>").isNotNull() | F.from_json("json", "array<string>").isNotNull()
    odd = (F.col("nesting.most") > _DEEPEST) | (F.col("shown").isNull() & lenient)
    told = nested.select(*keep, "json", "shown", F.col("nesting.most").alias("most"), odd.alias("is_odd"), good.alias("fine")).withColumn("good", F.col("fine") & ~F.col("is_odd"))

    words = F.lit(None).cast("string") if walk.vocabulary else F.lit("OTHER")
    kind = F.when(F.substring("shown", 1, 1) == "{", "object").otherwise("array")
    root = F.array(_node(walk, F.lit("$"), F.lit(None).cast("string"), F.lit(0), kind, F.col("json"), words))
    step = lambda n: F.when(n["open"] & (n["kind"] == "object"), _members(walk, n)).when(n["open"], _items(walk, n)).otherwise(F.array(n))
    levels = F.sequence(F.lit(1), F.least(F.col("most"), F.lit(_DEEPEST if walk.max_depth is None else walk.max_depth + 1)))
    nodes = F.aggregate(levels, root, lambda held, _: F.flatten(F.transform(held, step)))
    whole = F.when(_names_it(F.col("shown")), "SCHEMA_ORG").otherwise("OTHER") if walk.vocabulary else F.lit("OTHER")
    # What is of the document is computed here, below the explosion, and not for each leaf.
    walked = told.select(*keep, F.when(F.col("is_odd"), F.col("json")).alias("odd"), "good", whole.alias("whole"), F.when(F.col("good") & (F.col("most") > 0), nodes).alias("nodes"))
    bad = F.array(F.lit(None).cast("struct<" + ", ".join(c.replace(" ", ": ") for c in _NODE.split(", ")) + ">"))
    event = F.when(F.col("good"), _events(walk, F.col("nodes"))).otherwise(bad)
    # Outer, so that no filter on the array's size is derived, which would walk every document twice.
    rows = walked.select(*keep, "odd", "good", "whole", F.posexplode_outer(event).alias("leaf_ord", "n")).where("leaf_ord is not null")
    n, leaf, kind = F.col("n"), F.coalesce(F.col("n.leaf"), F.lit(False)), F.col("n.kind")
    value = F.struct(
        kind.alias("kind"), F.when(kind == "string", n["text"]).alias("s"), F.when(kind == "number", n["text"].cast("double")).alias("n"), F.when(kind == "boolean", n["text"] == "true").alias("b"),
        n["items"].alias("a"),
    )
    return rows.select(
        *keep, "leaf_ord", F.when(leaf, n["key"]).alias("leaf_key"), F.when(leaf, n["path"]).alias("path"), F.when(leaf, value).cast(TYPE).alias("value"),
        F.when(leaf, F.coalesce(n["words"], "whole")).otherwise("").alias("vocabulary"), F.when(~leaf, F.when(F.col("good"), n["code"]).otherwise("MALFORMED_JSON")).alias("warning"), "odd",
    )


def flatten(documents: DataFrame, text_col: str, keep: Sequence[str], walk: Walk) -> DataFrame:
    """The columns to keep and LEAF: a row for each leaf; warning rows have no path. Bad JSON: one warning, MALFORMED_JSON. Null texts have no rows.

    The result is staged, as its consumers are several.
    """
    ready = documents.where(documents[text_col].isNotNull()).select(*keep, F.col(text_col).alias("json"))
    found = stage(_walked(dealt(ready), keep, walk), "leaves")
    odd = found.where("odd is not null").select(*keep, F.col("odd").alias("json"))
    sure = found.where("odd is null").drop("odd")
    return sure if odd.isEmpty() else sure.unionByName(_in_python(odd, keep, walk))
