"""The walk over JSON as one expression, against the walk in plain Python."""

import json
import random

import pytest

from thresher.operators import flatten as fl
from thresher.operators.flatten import Walk
from thresher.operators.network import Limits

PAGE = Walk()
RESPONSE = Limits().walk()
TIGHT = Walk(nulls=False, blanks=False, vocabulary=False, max_depth=3, max_nodes=12, max_items=3, max_string=6, max_leaves=5)
ODD = [
    "", " ", "{", "}", "[]", "{}", "null", "5", '"text"', "1,2", '{"a":1} x', '{"a":1}{"b":2}', "[1],[2]", '{"a":NaN}', '{"a":01}', "{'a':1}", '{"a":1,}', '{"a":1e999,"b":-1e999,"c":"Infinity"}',
    '{"a":1,"a":2,"b":3,"a":{"x":[1]}}', '{"o":{"b":1,"b":[2,2]},"p":"s"}', '{"a":123456789012345678901234567890}', '{"a":-0.0,"b":1.50,"c":1e5}', ' {"a": "x\\/y\\u00e9\\"q\\"}{"} ',
    '{"":1,"  ":2,"__x":3,"a b":4,"$ok":5,"9":6,"q\\"t":7}', '{"a":["x","y"],"b":["x",1],"c":[],"d":[[["z"]]],"e":["",null]}', '["a",["b"],{"k":["c"]}]', '{"s":"{\\"u\\":[1]}","t":"[1]"}',
    '{"@context":"https://SCHEMA.org","a":1,"b":{"@context":{"schema.org":"no"},"c":2},"d":{"@context":["x",{"v":"http://schema.org/"}],"e":3}}', '{"a":{"schema.org":1}}', '{"a":"see schema.org"}',
    '{"a":"' + "x" * 30_000 + '"}', '{"a":' + "[" * 60 + "1" + "]" * 60 + "}", '{"a":' * 45 + "1" + "}" * 45, '{"a":' + "[" * 1500 + "]" * 1500 + "}", json.dumps({"l": list(range(1200))}),
    json.dumps({f"k{k}": k for k in range(1600)}), json.dumps({f"k{k}": [k, {"z": "v"}] for k in range(7000)}), '{"long":["ok","' + "y" * 20_001 + '"]}', '{"a":"\\n\\t","b":true,"c":false,"d":null}',
    "{\"a\":tru}", "[1,2", "nul", '{"a" 1}', '{"n":{"a":{"b":{"c":{"d":1}}}},"z":2}', '{"w":["aaaaaaa","b"],"x":["a","b","c","d"],"y":"aaaaaaa","z":"aaaaaaaa"}',
]


def _random(r, depth=0):
    k = r.random()
    if depth > 4 or k < 0.45:
        return r.choice([1, 2.5, -3, True, False, None, "", "x", " y ", "schema.org/a", "{}", "[1]", 'q"\\', "é\n"])
    if k < 0.7:
        return [_random(r, depth + 1) for _ in range(r.randint(0, 5))]
    if k < 0.78:
        return [r.choice(["a", "bb", "  ", "schema.org"]) for _ in range(r.randint(0, 5))]
    return {r.choice(["a", "b", "c d", "@context", "@type", "__p", "", "x.y", 'k"q', "$v"]): _random(r, depth + 1) for _ in range(r.randint(0, 6))}


def _want(text, walk):
    try:
        return list(fl.leaves(fl.parse(text), walk))
    except (ValueError, RecursionError):
        return [(None, None, None, "", "MALFORMED_JSON")]


def _shown(v):
    if v is None:
        return None
    return {"string": v["s"], "number": v["n"], "boolean": v["b"], "array": v["a"], "null": "null"}[v["kind"]]


def _compared(spark, texts, walk):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "id long, body string")
    found = {}
    for row in sorted(fl.flatten(docs, "body", ["id"], walk).collect(), key=lambda r: (r["id"], r["leaf_ord"])):
        found.setdefault(row["id"], []).append((row["leaf_key"], row["path"], _shown(row["value"]), row["vocabulary"], row["warning"]))
    for k, text in enumerate(texts):
        want = [(key, path, ("null" if x is None else x) if path else None, words, code) for key, path, x, words, code in _want(text, walk)]
        assert found.pop(k, []) == want, text[:200]
    assert not found


@pytest.mark.parametrize("walk", [PAGE, RESPONSE, TIGHT], ids=["page", "response", "tight"])
def test_walk_is_the_plain_walk(spark, walk):
    r = random.Random(8)
    made = [json.dumps(x, indent=r.choice([None, 2])) for x in (_random(r) for _ in range(400)) if isinstance(x, (dict, list))]
    _compared(spark, [*ODD, *made], walk)


def test_no_python_without_odd_documents(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":[1,"x"]}}'), (2, "{bad")], "id long, body string")
    plan = fl.flatten(docs, "body", ["id"], RESPONSE)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan
    assert fl.flatten(docs.where("false"), "body", ["id"], RESPONSE).count() == 0
