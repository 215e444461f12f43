import time

import pytest
from pyspark.sql import functions as F

from thresher.operators import discovery, network
from thresher.sources.elements import element_rows, elements

PAGE = """<html><head><title> Hi  there </title><meta property="og:title" content="A"><meta name="x" content=" b  c "><meta property="og:title" content="B">
<script type="application/ld+json">{"@context":"https://schema.org","name":"Finca","tags":["a","b"],"nil":null,"o":{"a b":[1,{"z":true}]}}</script>
<script type="application/ld+json">{bad</script></head>
<body><div itemscope itemtype="https://schema.org/Person"><span itemprop="name alt">Ines</span><i itemprop=" ">?</i><div itemprop="address" itemscope><b itemprop="street">S 1</b></div></div>
<dl><dt>Roast Level:</dt><dd>dark</dd><dd>medium</dd></dl><table><tr><th>Origin</th><td>Huila</td></tr><tr><td>Bags</td><td>31</td></tr></table>
<label for="q">Grower note</label><input id="q" value="v"><div><span>Aroma</span><span>cocoa</span></div><div class="acidity" data-value="4.9">x</div>
<p data-lot="k8">t</p><time datetime="2031-05-06">x</time><h2>Head</h2><div hidden><p id="secret">no</p></div></body></html>"""


def _pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def _found(table):
    v = F.col("value")
    rows = table.orderBy("ext_ord", "prop_ord").select("key", "path", F.coalesce(v["s"], v["n"].cast("string"), v["b"].cast("string"), F.array_join(v["a"], "|")).alias("v")).collect()
    return [(r["key"], r["path"], r["v"]) for r in rows]


def test_json_ld(spark):
    found, warnings = discovery.json_ld(elements(_pages(spark, PAGE, None, "", "<p>x")))
    assert _found(found) == [
        ("@context", '$["@context"]', "https://schema.org"), ("name", "$.name", "Finca"), ("tags", "$.tags", "a|b"), ("nil", "$.nil", None),
        ("a b", '$.o["a b"][0]', "1.0"), ("z", '$.o["a b"][1].z', "true"),
    ]
    assert [r["code"] for r in warnings.collect()] == ["JSON_LD_PARSE_ERROR"]
    assert {r["vocabulary"] for r in found.collect()} == {"SCHEMA_ORG"}


def test_meta_counts_equal_names(spark):
    found = discovery.meta(elements(_pages(spark, PAGE)))
    assert _found(found) == [
        ("title", "title", "Hi there"), ("og:title", 'meta[property="og:title"]:eq(0)', "A"), ("x", 'meta[name="x"]:eq(0)', "b c"),
        ("og:title", 'meta[property="og:title"]:eq(1)', "B"),
    ]


def test_microdata_nests(spark):
    found, warnings = discovery.microdata(elements(_pages(spark, PAGE)))
    assert _found(found) == [
        ("itemtype", "[itemscope]:eq(0)[itemtype]", "https://schema.org/Person"), ("name", '[itemscope]:eq(0) [itemprop="name"]:eq(0)', "Ines"),
        ("alt", '[itemscope]:eq(0) [itemprop="alt"]:eq(0)', "Ines"), ("address", '[itemscope]:eq(0) [itemprop="address"]:eq(0)', "S 1"),
        ("street", '[itemscope]:eq(0) [itemprop="address"]:eq(0) [itemprop="street"]:eq(0)', "S 1"),
    ]
    assert [r["code"] for r in warnings.collect()] == ["MICRODATA_EMPTY_ITEMPROP"]


def test_dom_rules_by_strength(spark):
    found, _ = discovery.dom(elements(_pages(spark, PAGE)))
    got = {(k, v) for k, _, v in _found(found)}
    assert {
        ("roast-level", "dark"), ("roast-level", "medium"), ("origin", "Huila"), ("bags", "31"), ("grower-note", "v"), ("lot", "k8"), ("acidity", "4.9"),
        ("acidity", "x"), ("aroma", "cocoa"), ("datetime", "2031-05-06"), ("h2", "Head"),
    } <= got
    assert "no" not in {v for _, v in got}
    paths = {k: p for k, p, _ in _found(found)}
    assert paths["grower-note"] == "#q" and paths["acidity"] == ".acidity" and paths["h2"] == "body > h2"


def test_dom_keeps_the_strongest_500(spark):
    page = "<body>" + "".join(f'<p id="item-name-{chr(97 + k % 26)}x{chr(97 + k // 26)}">v{k}</p>' for k in range(600)) + f'<p id="long-text">{"w" * 2001}</p></body>'
    found, warnings = discovery.dom(elements(_pages(spark, page)))
    assert found.count() == 500
    assert {r["code"] for r in warnings.collect()} == {"DOM_PROPERTY_LIMIT_REACHED", "DOM_VALUE_LIMIT_SKIPPED"}


def test_left_open_formatting_goes_on():
    rows = element_rows("<p><b>one<p>two</body>")
    assert [r["tag"] for r in rows] == ["html", "head", "body", "p", "b", "p", "b"]


def test_deep_nesting_does_not_recurse():
    assert len(element_rows("<div>" * 3000 + "x")) == 3003


def test_microdata_nests_deeply(spark):
    deep = 20
    page = '<div itemscope itemtype="https://schema.org/Thing">' + '<div itemprop="p" itemscope>' * deep + '<b itemprop="q">x</b>' + "</div>" * (deep + 1)
    found, _ = discovery.microdata(elements(_pages(spark, page)))
    row = found.where("key = 'q'").first()
    assert row["path"] == "[itemscope]:eq(0)" + ' [itemprop="p"]:eq(0)' * deep + ' [itemprop="q"]:eq(0)' and row["vocabulary"] == "SCHEMA_ORG"


def test_nested_tags_take_linear_time():
    start = time.perf_counter()
    rows = element_rows("<div>t " * 7000 + "</div>" * 7000)
    assert len(rows) == 7003 and rows[-1]["text"] == "t" and rows[3]["text_len"] == 13_999
    assert time.perf_counter() - start < 5


def test_text_is_collapsed_across_elements():
    rows = {r["tag"]: r["text"] for r in element_rows("<p> a <b> b</b> <i>c </i>d\n</p><q> </q>")}
    assert (rows["p"], rows["b"], rows["i"], rows["q"]) == ("a b c d", "b", "c", "")


@pytest.mark.parametrize("bad", [0, -1, 1.5, True, None, 2**53])
def test_limits_are_positive_safe_integers(bad):
    with pytest.raises(ValueError, match="nodes"):
        network.Limits(nodes=bad)


def test_limits_of_responses_warn(spark):
    bodies = [(1, "a", 0, '{"x": 1, "y": 2}'), (1, "b", 1, '{"z": [{"deep": {"er": 5}}]}'), (1, "c", 2, "{bad"), (2, "d", 0, '{"q": "long text"}'), (3, "e", 0, None)]
    responses = spark.createDataFrame(bodies, "job_id long, id string, sequence int, body string")
    found, warnings = network.network_properties(responses, limits=network.Limits(responses=2, all_properties=1, string=4))
    assert [(r["job_id"], r["path"]) for r in found.collect()] == [(1, "$.x")]
    codes = {(r["job_id"], r["code"]) for r in warnings.collect()}
    assert codes == {(1, "NETWORK_TOTAL_PROPERTY_LIMIT_REACHED"), (1, "NETWORK_RESPONSE_LIMIT_REACHED"), (2, "NETWORK_STRING_TOO_LARGE")}


def test_references_without_semicolon():
    page = '<title>a &amp; b &amp</title><p title="x&amp=1&amp;&lt">c &#60;&notit; &lt d</p><script type="application/ld+json">{"a": "&amp"}</script>'
    of = lambda *whole: {r["tag"]: r for r in element_rows(page, *whole)}
    html, whole = of(), of(True)
    assert (html["title"]["text"], whole["title"]["text"]) == ("a & b &", "a & b &amp")
    assert whole["p"]["text"] == "c <&notit; &lt d"
    assert dict(whole["p"]["attrs"]) == {"title": "x&amp=1&&lt"}
    assert html["script"]["script"] == whole["script"]["script"] == '{"a": "&amp"}'
