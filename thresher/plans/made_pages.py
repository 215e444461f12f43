"""Registered queries over made pages and bodies, whose properties SQL states from ids.

Each shows one family of rules on pages of several shapes; the tables' values stand in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, discovery, network
from ..sources.elements import elements
from ..sources.staging import dealt, spread
from . import coordination
from .queries import _attempts, _DECODED, _decisions, _ORDERED, _pick, _read, _sql_pick, _STREAKS, ORACLE_SQL, query


def _filled(pattern: str, **given: Column) -> Column:
    """The pattern with {name} replaced by columns."""
    parts, rest = [], pattern
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), given[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _parts(spark: SparkSession, sf_dir: str, pattern: str, odd: str | None = None) -> DataFrame:
    """A page for each part; of odd keys perhaps by another pattern."""
    given = {"id": F.col("p_partkey"), "name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")}
    html = _filled(pattern, **given)
    if odd is not None:
        html = F.when(F.col("p_partkey") % 2 == 1, _filled(odd, **given)).otherwise(html)
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("page_id", "key", "path", F.col("value.s").alias("text"))


def _sql_rows(rows: list[tuple[str, str, str]], odd: list[tuple[str, str, str]] | None = None) -> str:
    """(key, path, value) of every part's page, each a SQL expression; null values are no rows."""
    one = lambda rows: ", ".join(f"({k}, {p}, {v})" for k, p, v in rows)
    sql = f"SELECT p_partkey AS page_id, u.* FROM part, LATERAL (VALUES {one(rows)}) AS u(key, path, text) WHERE u.text IS NOT NULL"
    return sql if odd is None else f"{sql} AND p_partkey % 2 = 0 UNION ALL {_sql_rows(odd)} AND p_partkey % 2 = 1"


def _texts(*rows: tuple[str, str, str]) -> list[tuple[str, str, str]]:
    """Keys and paths as SQL texts."""
    return [(f"'{k}'", "'" + p.replace("'", "''") + "'", v) for k, p, v in rows]


# --- raw pages ---------------------------------------------------------------------------

_AD, _H1 = (_DECODED.format(f"""regexp_extract(html, '(?s){a}(.*?){b}', 1)""") for a, b in (('<div class="ad">', "</div>"), ("<h1>", "</h1>")))
ORACLE_SQL["X15_dom_discovery"] = f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY nth) - 1 AS prop_ord, key, path, text, substr(text, 1, 50) AS snippet FROM (
SELECT page_id, 0 AS nth, 'ad' AS key, '.ad' AS path, {_AD} AS text FROM pages UNION ALL SELECT page_id, 1, 'h1', 'body > article > h1', {_H1} FROM pages WHERE html LIKE '%<h1>%') WHERE text <> ''"""
ORACLE_SQL["page_records"] = f"""SELECT page_id AS job_id, CASE WHEN h <> '' AND a <> '' THEN 'VALID' ELSE 'INVALID' END AS status, nullif(h, '') AS headline, nullif(a, '') AS ad
FROM (SELECT page_id, {_H1} AS h, {_AD} AS a FROM pages)"""


# --- microdata ---------------------------------------------------------------------------

_ITEMS = (
    '<div itemscope itemtype="https://schema.org/Product"><meta itemprop="title" content="{name}"><a itemprop="link" href="/p/{id}">x</a><img itemprop="pic" src="/i/{id}.png">'
    '<data itemprop="amount" value="{size}">no</data><meter itemprop="share" value="0.5">no</meter><time itemprop="since" datetime="2031-02-03">soon</time><time itemprop="until">{brand}</time>'
    '<object itemprop="plan" data="/o/{id}"></object><span itemprop="kind"> {type}\n  x </span><span itemprop="kind">{brand}</span></div>'
)
_LACKING = '<div itemscope><meta itemprop="title"><a itemprop="link">x</a><data itemprop="amount" value=" ">no</data><time itemprop="since" datetime="">{brand}</time><span itemprop="kind">{type}</span></div>'
_ITEM = lambda name, nth=0: f'[itemscope]:eq(0) [itemprop="{name}"]:eq({nth})'


@query(
    _sql_rows(
        _texts(
            ("itemtype", "[itemscope]:eq(0)[itemtype]", "'https://schema.org/Product'"), ("title", _ITEM("title"), "p_name"), ("link", _ITEM("link"), "'/p/' || p_partkey"),
            ("pic", _ITEM("pic"), "'/i/' || p_partkey || '.png'"), ("amount", _ITEM("amount"), "CAST(p_size AS VARCHAR)"), ("share", _ITEM("share"), "'0.5'"), ("since", _ITEM("since"), "'2031-02-03'"),
            ("until", _ITEM("until"), "p_brand"), ("plan", _ITEM("plan"), "'/o/' || p_partkey"), ("kind", _ITEM("kind"), "p_type || ' x'"), ("kind", _ITEM("kind", 1), "p_brand"),
        ),
        _texts(("kind", _ITEM("kind"), "p_type")),
    )
)
def X12_microdata_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by tag; every other page lacks the attributes that hold them."""
    return _shown(discovery.microdata(elements(_parts(spark, sf_dir, _ITEMS, _LACKING)))[0])


# --- the page's structure ------------------------------------------------------------------

_ATTRIBUTES = '<body><p data-lot-code="{brand}" data-testid="t" data-productname=" {name} ">{type}</p></body>'
_FIELDS = '<body><div id="sheet-{id}" data-field="cupScore" data-value="{size}">{brand}</div><p class="grade-mark" data-value="{type}">x</p><p data-field="plain">{name}</p></body>'


@query(
    _sql_rows(
        _texts(("lot-code", "body > p", "p_brand"), ("productname", "body > p", "p_name")),
        [
            *_texts(("grade-mark", ".grade-mark", "p_type"), ("grade-mark", ".grade-mark", "'x'"), ("plain", "body > p:nth-of-type(2)", "p_name")),
            ("'cup-score'", "'#sheet-' || p_partkey", "CAST(p_size AS VARCHAR)"), ("'sheet-' || p_partkey", "'#sheet-' || p_partkey", "p_brand"),
        ],
    )
)
def X16_data_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that carry data: any of them, and on odd pages data-field and data-value."""
    return _shown(discovery.dom(elements(_parts(spark, sf_dir, _ATTRIBUTES, _FIELDS)))[0])


_PAIRS = (
    "<body><dl><dt>Roast level:</dt><dd>{type}</dd><dd>{brand}</dd></dl><table><tr><th>Origin</th><td>{name}</td></tr><tr><td>Bag size</td><td>{size}</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>"
    '<label for="note">Grower note</label><input id="note" value="{brand}"><label>Kind <select><option>aa</option><option>bb</option><option selected>{type}</option></select></label>'
    "<div><span>Aroma</span><span>{name}</span></div><section><em>Net weight</em><b>{size} g</b></section></body>"
)
_NO_PAIRS = (
    "<body><dl><dt>Roast level</dt><dt>Other</dt><p>between</p><dd>{type}</dd></dl><table><tr><td>One</td></tr></table><label for='gone'>Lost</label>"
    "<ul><li>Label</li><li>{brand}</li></ul><div><a>Aroma</a><b>{name}</b></div><div><b>w-4</b><b>{name}</b></div></body>"
)


@query(
    _sql_rows(
        _texts(
            ("roast-level", "body > dl > dd:nth-of-type(1)", "p_type"), ("roast-level", "body > dl > dd:nth-of-type(2)", "p_brand"), ("origin", "body > table > tbody > tr:nth-of-type(1) > td", "p_name"),
            ("bag-size", "body > table > tbody > tr:nth-of-type(2) > td:nth-of-type(2)", "CAST(p_size AS VARCHAR)"), ("grower-note", "#note", "p_brand"), ("kind", "body > label:nth-of-type(2) > select", "p_type"),
            ("aroma", "body > div > span:nth-of-type(2)", "p_name"), ("net-weight", "body > section > b", "p_size || ' g'"),
        ),
        _texts(("none", "none", "CAST(NULL AS VARCHAR)")),
    )
)
def X17_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and definitions, table rows, labels and controls, siblings; odd pages have what only looks like them."""
    return _shown(discovery.dom(elements(_parts(spark, sf_dir, _PAIRS, _NO_PAIRS)))[0])


_NAMED = (
    '<body><div id="w-4" aria-label="Cup score">{size}</div><span name="blend">{brand}</span><p class="flex price price-per-bag">{type}</p><time datetime="2031-02-03">soon</time><h2>{name}</h2>'
    '<div hidden><p id="inner-text">no</p></div><input type="checkbox" id="fair-trade" checked><input type="radio" id="bird-safe"><input type="password" id="pass-word" value="x"><a id="more-link" href="/more/{id}">x</a>'
    '<a id="dead-link" href="#">{brand}</a><div id="big-box"><i>1</i><i>2</i><i>3</i></div><svg id="draw-ing"><path id="inner-path">no</path></svg><b id="css-x1">{type}</b><p style="display: none" id="un-seen">no</p></body>'
)


@query(
    _sql_rows(
        _texts(
            ("cup-score", "#w-4", "CAST(p_size AS VARCHAR)"), ("blend", "body > span", "p_brand"), ("price-per-bag", ".price-per-bag", "p_type"), ("datetime", "body > time", "'2031-02-03'"),
            ("h2", "body > h2", "p_name"), ("fair-trade", "#fair-trade", "'true'"), ("bird-safe", "#bird-safe", "'false'"), ("more-link", "#more-link", "'/more/' || p_partkey"), ("dead-link", "#dead-link", "p_brand"),
        )
    )
)
def X21_named_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best name of an element, its primary value and its path; what is hidden, excluded, generated or a container gives none."""
    return _shown(discovery.dom(elements(_parts(spark, sf_dir, _NAMED)))[0])


_LOT = "'lot-' || chr(CAST(97 + k % 26 AS INT)) || chr(CAST(97 + k // 26 AS INT))"


@query(
    f"""SELECT s_suppkey AS page_id, k AS prop_ord, {_LOT} AS key, '#' || {_LOT} AS path, 'v' || k || ' ' || s_name AS text, true AS more FROM supplier, range(500) AS t(k)"""
)
def X31_strongest_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 520 named elements, and one whose text is too long: 500 properties stay, and a warning."""
    k = F.sequence(F.lit(0), F.lit(519))
    letter = lambda x: F.char(F.lit(97) + x)
    one = lambda n: F.concat(F.lit('<p id="lot-'), letter(n % 26), letter(F.floor(n / 26)), F.lit('">v'), n.cast("string"), F.lit(" "), F.col("s_name"), F.lit("</p>"))
    html = F.concat(F.lit("<body><p id='long-text'>"), F.repeat(F.lit("w"), 2001), F.lit("</p>"), F.array_join(F.transform(k, one), ""), F.lit("</body>"))
    found, warnings = discovery.dom(elements(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html"))))
    codes = warnings.groupBy("page_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    more = F.col("codes") == F.array(F.lit("DOM_PROPERTY_LIMIT_REACHED"), F.lit("DOM_VALUE_LIMIT_SKIPPED"))
    return found.join(spread(codes), "page_id").select("page_id", "prop_ord", "key", "path", F.col("value.s").alias("text"), more.alias("more"))


# --- the walk over JSON ---------------------------------------------------------------------

_BODIES = [
    '{"a": ["x", "y"], "k": #, "b c": {"__in": 1, "deep": "d#"}}', '{"l": [1, 2, #, 4, 5]}', '{"s": "abcdefgh", "t": "ok#"}', '{"d": {"d": {"d": {"d": {"d": 1}}}}, "e": #}',
    '{"p0": #, "p1": 1, "p2": 2, "p3": 3, "p4": 4, "p5": 5}', '{"m": {"a": [{"x": #}, {"x": null}]}, "n": " "}', '{"q": #, "q": 7}', '{"bad": #',
]
_TIGHT = network.Limits(items=3, string=6, depth=4, properties=4, nodes=12)
_LEAVES = [
    (0, "$.a", "'x, y'"), (0, "$.k", "e"), (0, '$["b c"].deep', "'d' || e"), (1, "$.l[0]", "'1'"), (1, "$.l[1]", "'2'"), (1, "$.l[2]", "e"), (2, "$.t", "'ok' || e"), (3, "$.e", "e"),
    (4, "$.p0", "e"), (4, "$.p1", "'1'"), (4, "$.p2", "'2'"), (4, "$.p3", "'3'"), (5, "$.m.a[0].x", "e"), (6, "$.q", "'7'"),
]
_CODES = [(1, "NETWORK_ARRAY_LIMIT_REACHED"), (2, "NETWORK_STRING_TOO_LARGE"), (3, "NETWORK_DEPTH_LIMIT_REACHED"), (4, "NETWORK_RESPONSE_PROPERTY_LIMIT_REACHED"), (7, "NETWORK_MALFORMED_JSON")]


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event a response of a job of its own, its body one of eight shapes with a number of four digits in it."""
    number = (F.col("event_id") % 9000 + 1000).cast("string")
    body = F.replace(_pick("event_id", _BODIES), F.lit("#"), number)
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.lit("r").alias("id"), F.lit(0).alias("sequence"), body.alias("body"))


@query(
    "SELECT event_id AS job_id, u.path, u.text FROM (SELECT event_id, CAST(event_id % 9000 + 1000 AS VARCHAR) AS e FROM events), LATERAL (VALUES "
    + ", ".join(f"({k}, '{p}', {v})" for k, p, v in _LEAVES) + ") AS u(shape, path, text) WHERE u.shape = event_id % 8"
)
def N5_walk_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of bodies that go beyond a limit each, nest, repeat a name or aren't JSON."""
    found, _ = network.network_properties(_bodies(spark, sf_dir), limits=_TIGHT)
    v = F.col("value")
    return found.select("job_id", "path", F.coalesce(v["s"], v["n"].cast("bigint").cast("string"), F.array_join(v["a"], ", ")).alias("text"))


@query("SELECT event_id AS job_id, u.code FROM events, LATERAL (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in _CODES) + ") AS u(shape, code) WHERE u.shape = event_id % 8")
def N6_walk_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, warnings = network.network_properties(_bodies(spark, sf_dir), limits=_TIGHT)
    return warnings.select("job_id", "code")


# --- access --------------------------------------------------------------------------------

_BODY_SIGNALS = [
    *((m, "CAPTCHA", 0.99) for m in access.CAPTCHA_MARKERS), *((m, "CAPTCHA", 0.98) for m in access.CAPTCHA_PHRASES), ("captcha", "CAPTCHA", 0.72),
    *((m, "LOGIN_REQUIRED", 0.97) for m in access.LOGIN_PHRASES), ("<input name=p type='password'> Login", "LOGIN_REQUIRED", 0.94), ("<input type=password>", None, None), ("log in", None, None),
    *((m, "SECURITY_CHALLENGE", 0.99) for m in access.SECURITY_MARKERS if "challenge-platform/" in m or "cf-chl" in m), *((m, "SECURITY_CHALLENGE", 0.96) for m in access.SECURITY_PHRASES),
    ("Security Challenge, continue", "SECURITY_CHALLENGE", 0.9), ("security check", None, None), ("plain text", None, None),
]
_TYPES = ["text/html", "Application/JSON; x=1", "image/png", None, "application/xhtml+xml"]


def _plain_envelope(key: str, body: Column, kind: Column) -> list[Column]:
    none = F.lit(None)
    failed = "struct<type: string, code: string, message: string>"
    headers = F.when(kind.isNull(), F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("content-type"), F.array(kind)))
    return [
        F.col(key).alias("job_id"), F.lit("d").alias("domain"), F.lit("https://a.example/").alias("requested_url"), F.lit("https://a.example/").alias("final_url"), F.array().cast("array<string>").alias("redirects"),
        F.lit(200).alias("status_code"), headers.alias("headers"), body.cast("binary").alias("raw_body"), none.cast(failed).alias("transport_error"), none.cast(failed).alias("body_error"),
    ]


@query(
    f"SELECT doc_id AS job_id, {_sql_pick('doc_id', [r for _, r, _ in _BODY_SIGNALS])} AS reason, CAST({_sql_pick('doc_id', [c for *_, c in _BODY_SIGNALS])} AS DOUBLE) AS confidence FROM documents WHERE {_sql_pick('doc_id', [r for _, r, _ in _BODY_SIGNALS])} IS NOT NULL"
)
def F7_body_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every marker of human checks, login walls and security challenges in turn."""
    body = F.concat(F.lit("<p>some "), _pick("doc_id", [m for m, *_ in _BODY_SIGNALS]), F.lit(" text</p>"))
    found = access.challenge_signals(_read(spark, sf_dir, "documents").select(*_plain_envelope("doc_id", body, F.lit("text/html"))))
    return found.select("job_id", "reason", "confidence")


@query("SELECT s_suppkey AS job_id, 'CAPTCHA' AS reason FROM supplier WHERE s_suppkey % 5 <> 2 AND s_suppkey % 3 < 2")
def F6_inspected_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of several types whose marker stands early, ends at the last inspected byte, or ends one byte later."""
    marker, turn = "g-recaptcha", F.col("s_suppkey") % 3
    before = F.when(turn == 0, 5).when(turn == 1, access.INSPECTED - len(marker)).otherwise(access.INSPECTED - len(marker) + 1)
    rows = dealt(_read(spark, sf_dir, "supplier"))  # before bodies of 256 KB each are made of rows that one task reads
    found = access.challenge_signals(rows.select(*_plain_envelope("s_suppkey", F.concat(F.repeat(F.lit("."), before), F.lit(marker + " and more")), _pick("s_suppkey", _TYPES))))
    return found.select("job_id", "reason")


def _sql_map(x: str, found: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in found.items()) + " END"


@query(
    f"""{_ORDERED} SELECT doc_id AS job_id, coalesce({_sql_map('reason', {k: m for k, (_, m) in access.ACTIONS.items()} | access.DENIALS)},
  CASE reason WHEN 'RATE_LIMITED' THEN 'Rate limited. Retry after 120s.' WHEN 'TIMEOUT' THEN 'Temporary failure (TIMEOUT). Retry after 10s.' WHEN 'SITE_UNAVAILABLE' THEN 'Temporary failure (SITE_UNAVAILABLE). Retry after 30s.' END) AS message,
  CASE WHEN reason IN ({', '.join(f"'{k}'" for k in access.ACTIONS)}) THEN 'https://a.example' || CASE WHEN doc_id % 4 = 0 THEN {_sql_pick('doc_id', ["/captcha/x", "/login", "/a/b", "/oauth/authorize", "/verify-human", "/x?client_id=1&redirect_uri=2"])} ELSE '/' || doc_id END END AS action_url
FROM documents LEFT JOIN (SELECT * FROM w WHERE nth = 1) ON job_id = doc_id"""
)
def E15_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of each decision, and where the user has to act."""
    return _decisions(spark, sf_dir).select("job_id", "message", "action_url")


# --- from job to status ----------------------------------------------------------------------

_SITES = ["full", "part", "none", "busy", "human", "gone", "shut"]


@query(
    f"""WITH c AS (SELECT *, c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'cool' ELSE {_sql_pick('c_custkey', _SITES)} END AS site, c_custkey % 5 + 1 >= 4 AS spent FROM customer),
w AS (SELECT *, CASE site WHEN 'cool' THEN 'TIMEOUT' WHEN 'busy' THEN 'RATE_LIMITED' WHEN 'gone' THEN 'DNS_ERROR' END AS waits FROM c)
SELECT k AS job_id, CASE WHEN waits IS NOT NULL THEN CASE WHEN spent THEN 'FAILED_FINAL' ELSE 'RETRY_SCHEDULED' END WHEN site IN ('full', 'part') THEN 'SUCCESS' WHEN site = 'none' THEN 'PARSER_FAILED'
    WHEN site = 'human' THEN 'USER_ACTION_REQUIRED' ELSE 'FAILED_FINAL' END AS status,
  coalesce(waits, CASE site WHEN 'human' THEN 'CAPTCHA' WHEN 'shut' THEN 'FORBIDDEN' END) AS last_access_reason, CAST(1 AS BIGINT) AS attempt,
  CASE WHEN waits IS NOT NULL THEN CASE WHEN spent THEN 'Retry budget exhausted after ' || (k % 5 + 1) || ' attempts. ' ELSE '' END
      || CASE site WHEN 'cool' THEN '' WHEN 'busy' THEN 'Rate limited. Retry after 120s.' ELSE 'Temporary failure (DNS_ERROR). Retry after 10s.' END
    WHEN site = 'none' THEN 'Parser validation failed with status INVALID.' WHEN site = 'human' THEN '{access.ACTIONS["CAPTCHA"][1]}' WHEN site = 'shut' THEN '{access.DENIALS["FORBIDDEN"]}' END AS last_error,
  CASE site WHEN 'full' THEN 'FULL' WHEN 'part' THEN 'PARTIAL' END AS quality, CASE WHEN site IN ('full', 'part') THEN c_name END AS headline, CASE WHEN site = 'full' THEN 12.5 END AS score,
  CASE WHEN waits IS NOT NULL AND NOT spent THEN CASE site WHEN 'cool' THEN 5000 WHEN 'busy' THEN 120000 ELSE 10000 END END AS retry_ms, CASE WHEN site = 'human' THEN 'CAPTCHA' END AS action FROM w"""
)
def V6_job_to_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs of eight sites: complete pages, partial ones, such that lack a required field, busy, guarded, unknown and forbidden ones, and one that cools down."""
    key, none = F.col("c_custkey"), F.array().cast("array<string>")
    site = F.when(key % 11 == 0, "cool").otherwise(_pick("c_custkey", _SITES))
    field = lambda name, kind, needed: F.struct(
        F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("description"), (F.array(F.lit("h1")) if needed else none).alias("aliases"), none.alias("paths"), F.lit(needed).alias("required")
    )
    c = _read(spark, sf_dir, "customer").withColumns({"site": site, "url": F.concat(F.lit("https://"), site, F.lit(".example/"), key.cast("string"))})
    made = c.select(key.alias("job_id"), "url", F.array(field("headline", "string", True), field("cup score", "number", False)).alias("requested_fields"), (key % 5).alias("attempt"), F.lit(None).cast("int").alias("max_retries"))
    head, at = F.concat(F.lit("<html><body><h1>"), "c_name", F.lit("</h1>")), F.col("site")
    html = F.when(at == "full", F.concat(head, F.lit('<p id="cup-score">12.5</p>'))).when(at == "part", head).when(at == "human", F.concat(head, F.lit("<div class='g-recaptcha'>"))).otherwise("<p>nothing</p>")
    text = F.lit(None).cast("string")
    recorded = c.where(at != "gone").select(
        "url", F.when(at == "busy", 429).when(at == "shut", 451).otherwise(200).alias("status_code"), F.create_map(F.lit("Content-Type"), F.array(F.lit("text/html"))).alias("headers"), html.cast("binary").alias("body"),
        text.alias("final_url"), F.array().cast("array<string>").alias("redirects"), text.alias("error_code"), text.alias("error_message"),
    )
    now = F.timestamp_millis(F.lit(1_000_000))
    domains = spark.createDataFrame([("cool.example", 0, 1, 1_005_000, "TIMEOUT"), ("busy.example", 2, 0, 999_000, "RATE_LIMITED")], "domain string, consecutive_rate_limits int, consecutive_failures int, ms long, last_reason string")
    t = coordination.coordinate(made, recorded, domains.withColumn("cooldown_until", F.timestamp_millis("ms")), now, F.lit(0.5))
    record = t["normalized"].groupBy("job_id").agg(F.max(F.when(F.col("field") == "headline", F.col("value.s"))).alias("headline"), F.max(F.when(F.col("field") == "cup score", F.col("value.n"))).alias("score"))
    rows = t["states"].join(t["outcome"].select("job_id", "quality"), "job_id", "left").join(record, "job_id", "left").join(t["retries"], "job_id", "left").join(t["actions"].select("job_id", "action"), "job_id", "left")
    good = F.col("status") == "SUCCESS"
    return rows.select(
        "job_id", "status", "last_access_reason", "attempt", F.coalesce("last_error", F.when(F.col("status").isin("RETRY_SCHEDULED"), F.lit(""))).alias("last_error"), "quality", F.when(good, F.col("headline")).alias("headline"),
        F.when(good, F.col("score")).alias("score"), (F.unix_millis("retry_at") - 1_000_000).alias("retry_ms"), "action",
    )


# --- a hot domain ------------------------------------------------------------------------------

_HOT = _STREAKS.replace("user_id", "(CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END)")


def _half_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access decisions, every second of them of one domain."""
    return _attempts(spark, sf_dir).withColumn("domain", F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("domain")))


@query(f"{_HOT} SELECT domain, event_id, consecutive_rate_limits, consecutive_failures FROM s")
def W5_hot_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks counted slice by slice, as any domain of more than a thousand events is here."""
    return access.streaks(_half_hot(spark, sf_dir), hot=1_000).select("domain", "event_id", "consecutive_rate_limits", "consecutive_failures")


@query(
    f"""{_HOT}, n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS nth FROM s),
r AS (SELECT domain, arg_max(struct_pack(t := ts, e := event_type), struct_pack(a := ts, b := event_id)) AS r FROM s WHERE event_type IN ('error', 'signup') GROUP BY 1)
SELECT n.domain, consecutive_rate_limits, consecutive_failures, CASE r.e WHEN 'error' THEN 'RATE_LIMITED' ELSE 'TIMEOUT' END AS last_reason, epoch_us(r.t) // 1000 + 5000 AS cooldown_until_ms, epoch_us(n.ts) // 1000 AS updated_ms
FROM n JOIN r ON r.domain = n.domain WHERE nth = 1 AND consecutive_rate_limits + consecutive_failures > 0"""
)
def T5_hot_domain_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States merged from the summaries of slices, with cooldowns and reasons."""
    found = access.domain_state(_half_hot(spark, sf_dir), hot=1_000)
    return found.select(
        "domain", "consecutive_rate_limits", "consecutive_failures", "last_reason", F.unix_millis("cooldown_until").alias("cooldown_until_ms"), F.unix_millis(F.col("updated_at").cast("timestamp")).alias("updated_ms")
    )
