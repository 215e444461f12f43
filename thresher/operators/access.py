"""Whether a page was really accessible.

Envelopes: job_id, domain, requested_url, final_url, redirects, status_code, headers,
raw_body, transport_error and body_error (type, code, message). Detectors turn them into
signals, one signal wins, and policies turn it into a decision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http
from ..functions.text import trim
from ..sources.staging import stage

INSPECTED, LEAST_CONFIDENCE = 262_144, 0.6
#: Domains of more events are folded slice by slice.
HOT_DOMAIN = 2_000_000
# What HTTP statuses mean, and how surely.
STATUS = {
    401: ("AUTH_REQUIRED", 1.0), 403: ("FORBIDDEN", 0.7), 408: ("TIMEOUT", 0.95), 429: ("RATE_LIMITED", 1.0), 451: ("FORBIDDEN", 0.9),
    500: ("SITE_UNAVAILABLE", 0.85), 502: ("SITE_UNAVAILABLE", 0.95), 503: ("SITE_UNAVAILABLE", 1.0), 504: ("SITE_UNAVAILABLE", 0.95), 511: ("NETWORK_BLOCKED", 0.9),
}
# Markers in lower-cased bodies.
CAPTCHA_MARKERS = ("g-recaptcha", "grecaptcha.", "h-captcha", "hcaptcha", "cf-turnstile", "challenges.cloudflare.com/turnstile")
CAPTCHA_PHRASES = (
    "verify you are human", "verify that you are human", "confirm you are human", "prove you are human", "i am not a robot", "i'm not a robot",
)
LOGIN_PHRASES = (
    "sign in to continue", "signin to continue", "log in to continue", "login to continue", "please sign in to continue", "please log in to continue",
    "you must be logged in", "you must be signed in",
)
LOGIN_INPUT, LOGIN_WORDS = r"""<input[^>]+type\s*=\s*["']?password["']?""", ("sign in", "log in", "login")
SECURITY_MARKERS = ("cf-chl-", "/cdn-cgi/challenge-platform/", "challenge-platform")
SECURITY_PHRASES = (
    "checking your browser before accessing", "checking if the site connection is secure", "performing security verification",
    "security verification required", "browser verification",
)
SECURITY_PAIR = (("security check", "security challenge"), ("verify", "verification", "continue"))
INSPECTABLE = ("application/xhtml+xml", "application/xml", "application/json", "application/javascript")
# Paths that redirects lead to.
REDIRECTS = (
    ("CAPTCHA", 0.98, r"(?i)/(?:captcha|recaptcha|hcaptcha|human[-_]?verification)(?:/|$)"),
    ("SECURITY_CHALLENGE", 0.96, r"(?i)/(?:challenge|security[-_]?check|verify[-_]?human|cdn-cgi/challenge-platform)(?:/|$)"),
    ("LOGIN_REQUIRED", 0.95, r"(?i)/(?:login|signin|sign-in|log-in|accounts/login|account/login|session/new)(?:/|$)"),
    ("AUTH_REQUIRED", 0.9, r"(?i)/(?:oauth2?/authorize|authorize|authentication|sso)(?:/|$)"),
)
# Which source and reason wins among equally sure signals.
SOURCE_ORDER = ("BODY", "HEADER", "REDIRECT", "HTTP_STATUS", "TRANSPORT", "STATE", "ROBOTS")
REASON_ORDER = (
    "CAPTCHA LOGIN_REQUIRED AUTH_REQUIRED ACCOUNT_RESTRICTED SUBSCRIPTION_REQUIRED GEO_RESTRICTED RATE_LIMITED ROBOTS_RESTRICTED "
    "SECURITY_CHALLENGE FORBIDDEN NETWORK_BLOCKED TLS_ERROR DNS_ERROR CONNECTION_ERROR TIMEOUT SITE_UNAVAILABLE"
).split()
# What policies answer.
RETRY_BASE = {"RATE_LIMITED": 30_000, "TIMEOUT": 5_000, "DNS_ERROR": 10_000, "CONNECTION_ERROR": 5_000, "SITE_UNAVAILABLE": 15_000}
RATE_MAX, TRANSIENT_MAX, MULTIPLIER, JITTER = 900_000, 300_000, 2.0, 0.15
ACTIONS = {
    "CAPTCHA": ("CAPTCHA", "Human verification is required before scraping can continue."),
    "LOGIN_REQUIRED": ("LOGIN", "Login is required before scraping can continue."),
    "AUTH_REQUIRED": ("LOGIN", "Authentication is required before scraping can continue."),
    "SECURITY_CHALLENGE": ("MANUAL_INTERVENTION", "A security verification challenge requires manual intervention."),
    "NETWORK_BLOCKED": ("MANUAL_INTERVENTION", "Network access requires manual intervention before scraping can continue."),
}
DENIALS = {
    "FORBIDDEN": "Access to the requested resource is forbidden.",
    "ROBOTS_RESTRICTED": "Crawling this resource is not permitted by the configured robots policy.",
    "ACCOUNT_RESTRICTED": "The account associated with this resource is restricted.",
    "GEO_RESTRICTED": "The requested resource is unavailable from the current region.",
    "SUBSCRIPTION_REQUIRED": "Authorized subscription access is required for this resource.",
    "TLS_ERROR": "A TLS security failure prevented a trusted connection.",
    "OTHER": "Access could not be safely classified or continued.",
}


def _lookup(x: Column, found: dict, default: object = None) -> Column:
    return F.coalesce(F.create_map(*(F.lit(y) for pair in found.items() for y in pair))[x], F.lit(default))


def _signals(rows: DataFrame, det: int, source: str, found: Column, phase: Column | None = None) -> DataFrame:
    """found: array of struct<reason, confidence, evidence>; null entries are none."""
    kept = F.filter(found, lambda s: s["reason"].isNotNull())
    # Outer, so that no filter on the array's size is derived, which would inspect bodies twice.
    every = rows.select("job_id", F.lit(det).alias("det_ord"), F.posexplode_outer(kept).alias("sig_ord", "s"), F.lit(source).alias("source"), (phase if phase is not None else F.lit(None).cast("string")).alias("failure_phase"))
    return every.where("s is not null").select(
        "job_id", "det_ord", "sig_ord", "s.reason", "source", "s.confidence", "failure_phase", "s.evidence"
    )


def _signal(reason: Column, confidence: Column, evidence: Column) -> Column:
    return F.struct(reason.alias("reason"), confidence.cast("double").alias("confidence"), evidence.cast("string").alias("evidence"))


def transport_signals(envelopes: DataFrame) -> DataFrame:
    """Failures before the response and in the body; both are possible."""
    one = lambda e: _signal(F.col(e)["type"], F.when(F.col(e)["type"] == "OTHER", 0.6).otherwise(1.0), F.coalesce(F.col(e)["code"], F.col(e)["message"]))
    phases = F.array(F.struct(one("transport_error").alias("s"), F.lit("PRE_RESPONSE").alias("phase")), F.struct(one("body_error").alias("s"), F.lit("BODY").alias("phase")))
    kept = F.filter(phases, lambda p: p["s"]["reason"].isNotNull())
    rows = envelopes.select("job_id", F.posexplode(kept).alias("sig_ord", "p"))
    return rows.select(
        "job_id", F.lit(0).alias("det_ord"), "sig_ord", "p.s.reason", F.lit("TRANSPORT").alias("source"), "p.s.confidence", F.col("p.phase").alias("failure_phase"), "p.s.evidence"
    )


def status_signals(envelopes: DataFrame) -> DataFrame:
    code = F.col("status_code")
    reason, sure = _lookup(code, {k: r for k, (r, _) in STATUS.items()}), _lookup(code, {k: c for k, (_, c) in STATUS.items()})
    return _signals(envelopes.where(code != 0), 1, "HTTP_STATUS", F.array(_signal(reason, sure, F.concat(F.lit("HTTP status "), code.cast("string")))))


def redirect_class(url: Column) -> Column:
    """struct<reason, confidence> of where a redirect leads; null reason: nowhere special."""
    path, query = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lower(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")))
    reason, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    oauth = query.contains("client_id=") & query.contains("redirect_uri=")
    for name, confidence, pattern in reversed(REDIRECTS):
        here = path.rlike(pattern) | oauth if name == "AUTH_REQUIRED" else path.rlike(pattern)
        reason, sure = F.when(here, name).otherwise(reason), F.when(here, confidence).otherwise(sure)
    return F.struct(reason.alias("reason"), sure.alias("confidence"))


def redirect_signals(envelopes: DataFrame) -> DataFrame:
    moved = (F.size("redirects") > 0) | (F.col("final_url") != F.col("requested_url"))
    url, c = F.col("final_url"), redirect_class(F.col("final_url"))
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    shown = F.concat(F.lit("Redirected to "), F.lower(origin), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return _signals(envelopes.where(moved), 2, "REDIRECT", F.array(_signal(c["reason"], c["confidence"], shown)))


def is_inspectable(content_type: Column) -> Column:
    kind = F.lower(content_type)
    found = kind.isNull() | trim(kind).startswith("text/")
    for word in INSPECTABLE:
        found = found | kind.contains(word)
    return found


def challenge_signals(envelopes: DataFrame) -> DataFrame:
    """Human checks, login walls and security challenges that the first part of the body shows."""
    rows = envelopes.where(F.col("raw_body").isNotNull() & is_inspectable(http.first_header(F.col("headers"), "content-type"))).select("job_id", "raw_body")
    body = F.lower(http.body_text(F.substring("raw_body", 1, INSPECTED)))
    # The variable of a function, so that a body is cut and lower-cased once and not for each marker.
    return _signals(rows, 3, "BODY", F.get(F.transform(F.array(body), _challenges), F.lit(0)))


def _challenges(b: Column) -> Column:
    """Signals that a lower-cased body shows."""
    sure = lambda *steps: reduce(lambda w, s: w.when(s[0], s[1]), steps[1:], F.when(*steps[0]))
    any_of = lambda words: http.contains_any(b, words)
    captcha = sure((any_of(CAPTCHA_MARKERS), 0.99), (any_of(CAPTCHA_PHRASES), 0.98), (F.contains(b, F.lit("captcha")), 0.72))
    login = sure((any_of(LOGIN_PHRASES), 0.97), (b.rlike(LOGIN_INPUT) & any_of(LOGIN_WORDS), 0.94))
    security = sure((any_of(SECURITY_MARKERS), 0.99), (any_of(SECURITY_PHRASES), 0.96), (any_of(SECURITY_PAIR[0]) & any_of(SECURITY_PAIR[1]), 0.9))
    one = lambda reason, c: _signal(F.when(c.isNotNull(), F.lit(reason)), c, F.lit(f"{reason} marker in body"))
    return F.array(one("CAPTCHA", captcha), one("LOGIN_REQUIRED", login), one("SECURITY_CHALLENGE", security))


def signals(envelopes: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [d(envelopes) for d in (transport_signals, status_signals, redirect_signals, challenge_signals)])


def resolve_signals(found: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """The winning signal of each job: confidence, source, reason, order."""
    good = found.where((F.col("confidence") >= least) & (F.col("confidence") <= 1))
    source = _lookup(F.col("source"), {s: k for k, s in enumerate(SOURCE_ORDER)}, 50)
    reason = F.when(F.col("reason") == "OTHER", 100).otherwise(_lookup(F.col("reason"), {r: k for k, r in enumerate(REASON_ORDER)}, 50))
    key = F.struct((-F.col("confidence")).alias("c"), source.alias("s"), reason.alias("r"), "det_ord", "sig_ord")
    best = F.min_by(F.struct("reason", "source", "confidence", "failure_phase", "evidence"), key)
    return good.groupBy("job_id").agg(best.alias("best")).select("job_id", "best.*")


def decide(
    envelopes: DataFrame, winners: DataFrame, state: DataFrame, now_ms: Column, random: Column
) -> DataFrame:
    """A decision for each envelope: ALLOW, RETRY_LATER, USER_ACTION_REQUIRED or DENY.

    state: domain, consecutive_rate_limits, consecutive_failures; domains without a row
    have none. A reason that no policy names is an error, and so fails the query.
    """
    won = winners.select("job_id", "reason")
    rows = envelopes.select("job_id", "domain", "final_url", "requested_url", "headers").join(won, "job_id", "left").join(state, "domain", "left")
    reason, limited = F.col("reason"), F.col("reason") == "RATE_LIMITED"
    server = http.retry_after_ms(F.col("headers")["retry-after"], now_ms)
    earlier = F.coalesce(F.when(limited, F.col("consecutive_rate_limits")).otherwise(F.col("consecutive_failures")), F.lit(0))
    base = _lookup(reason, RETRY_BASE)
    rate, transient = (http.retry_delay(base, MULTIPLIER, earlier, most, JITTER, random, server) for most in (RATE_MAX, TRANSIENT_MAX))
    rows = rows.withColumn("wait", F.when(limited, rate).otherwise(transient))
    retry, action, denied = base.isNotNull(), _lookup(reason, {k: a for k, (a, _) in ACTIONS.items()}), _lookup(reason, DENIALS)
    decision = (
        F.when(reason.isNull(), "ALLOW").when(retry, "RETRY_LATER").when(action.isNotNull(), "USER_ACTION_REQUIRED").when(denied.isNotNull(), "DENY")
        .otherwise(F.raise_error(F.concat(F.lit("no policy for "), reason)))
    )
    seconds = F.ceil(F.col("wait") / 1000).cast("string")
    wait_message = F.concat(F.when(limited, "Rate limited. Retry after ").otherwise(F.concat(F.lit("Temporary failure ("), reason, F.lit("). Retry after "))), seconds, F.lit("s."))
    url = F.when(trim(F.col("final_url")) != "", trim(F.col("final_url"))).otherwise(F.col("requested_url"))
    return rows.select(
        "job_id", "domain", decision.alias("decision"), "reason", F.when(retry, F.col("wait")).alias("retry_after_ms"), action.alias("action"),
        F.when(action.isNotNull(), url).alias("action_url"), F.coalesce(F.when(retry, wait_message), _lookup(reason, {k: m for k, (_, m) in ACTIONS.items()}), denied).alias("message"),
    )


def preflight(jobs: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Jobs of domains that are cooling down wait; the others may go on."""
    rows = jobs.select("job_id", "domain").join(state.select("domain", "cooldown_until", "last_reason"), "domain", "left")
    waits = F.coalesce(F.col("cooldown_until") > now, F.lit(False))
    reason = F.when(waits, F.when(F.col("last_reason").isin(*RETRY_BASE), F.col("last_reason")).otherwise(F.raise_error(F.lit("cooldown without a retryable reason"))))
    left = F.unix_millis("cooldown_until") - F.unix_millis(now)
    return rows.select("job_id", "domain", F.when(waits, "RETRY_LATER").otherwise("ALLOW").alias("decision"), reason.alias("reason"), F.when(waits, left).alias("retry_after_ms"))


def _sliced(events: DataFrame, hot: int) -> tuple[DataFrame, bool]:
    """events with slice, and whether there is more than one: domains of more than `hot` events are cut into runs of their events in order.

    There are fewer than one such domain for each `hot` events, so their names are few. Their
    events are range-partitioned, and what partition they came to is written down.
    """
    large = events.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("domain").alias("large"))
    if large.isEmpty():
        return events.withColumn("slice", F.lit(0)), False
    large, same = stage(large, "hot-domains"), F.col("domain").eqNullSafe(F.col("large"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = events.join(F.broadcast(large), same, "left_semi").repartitionByRange(parts, "domain", "ts", "event_id").withColumn("slice", F.spark_partition_id() + 1)
    rest = events.join(F.broadcast(large), same, "left_anti").withColumn("slice", F.lit(0))
    return rest.unionByName(stage(runs, "domain-slices")), True


def _within_slices(sliced: DataFrame) -> DataFrame:
    """sliced with the counts since the slice's last ALLOW, and fresh: whether there was none so far in the slice."""
    order = Window.partitionBy("domain", "slice").orderBy("ts", "event_id")
    allowed = F.coalesce(F.col("decision") == "ALLOW", F.lit(False))
    islands = sliced.withColumn("island", F.sum(allowed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("domain", "slice", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    retry, limited = F.col("decision") == "RETRY_LATER", F.coalesce(F.col("reason") == "RATE_LIMITED", F.lit(False))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(within).cast("int")
    counted = islands.withColumns({"consecutive_rate_limits": count(retry & limited), "consecutive_failures": count(retry & ~limited)})
    return counted.withColumn("fresh", F.col("island") == 0).drop("island")


def _summaries(counted: DataFrame) -> DataFrame:
    """What a slice adds to its domain's state: allowed (whether it has an ALLOW), the counts since the last one, the last event and the last retry.

    Summaries merge in the order of slices: the counts of the later one stand alone if it has
    an ALLOW and are added to the earlier one's if not.
    """
    order = F.struct("ts", "event_id")
    retry = F.when(F.col("decision") == "RETRY_LATER", order)
    return counted.groupBy("domain", "slice").agg(
        F.bool_or(~F.col("fresh")).alias("allowed"),
        F.max_by(F.struct("consecutive_rate_limits", "consecutive_failures", F.col("ts").alias("updated_at")), order).alias("s"),
        F.max_by(F.struct(F.col("reason").alias("last_reason"), "ts", *(c for c in ("retry_after_ms",) if c in counted.columns)), retry).alias("r"),
    )


def _merged(summaries: DataFrame) -> DataFrame:
    """summaries with the counts after each slice, as the slices before leave them. A domain has as many rows as slices."""
    slices = Window.partitionBy("domain").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("domain", "island").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    islands = summaries.withColumn("island", F.sum(F.col("allowed").cast("int")).over(slices))
    after = lambda c: F.sum(F.col(f"s.{c}")).over(since).cast("int").alias(c)
    return islands.select("domain", "slice", "s.updated_at", "r", after("consecutive_rate_limits"), after("consecutive_failures"))


def streaks(events: DataFrame, carried: tuple[str, ...] = (), hot: int = HOT_DOMAIN) -> DataFrame:
    """Consecutive rate limits and failures of each domain after each event, since its last ALLOW.

    events: domain, ts, event_id, decision, reason, and the columns that are carried along.
    A domain of more than `hot` events is counted slice by slice; what the slices before
    leave is added to the events of a slice that come before its first ALLOW.
    """
    names, counts = ("domain", "ts", "event_id", "decision", "reason", *carried), ("consecutive_rate_limits", "consecutive_failures")
    sliced, several = _sliced(events.select(*names), hot)
    counted = _within_slices(sliced)
    if not several:
        return counted.select(*names, *counts)
    before = Window.partitionBy("domain").orderBy("slice")
    left = _merged(_summaries(counted.where("slice > 0"))).select(
        F.col("domain").alias("of"), F.col("slice").alias("at"), *(F.coalesce(F.lag(c).over(before), F.lit(0)).alias(f"earlier_{c}") for c in counts)
    )
    joined = counted.join(left, F.col("domain").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")), "left")
    whole = lambda c: (F.col(c) + F.when(F.col("fresh"), F.coalesce(f"earlier_{c}", F.lit(0))).otherwise(0)).alias(c)
    return joined.select(*names, *map(whole, counts))


def domain_state(events: DataFrame, hot: int = HOT_DOMAIN) -> DataFrame:
    """The latest state of each domain; those without a retry since their last ALLOW have none. events also has retry_after_ms.

    Denials and requests to the user leave counters and cooldown as they are. Only the
    slices' summaries are merged, so a domain of any size is a few rows.
    """
    sliced, _ = _sliced(events.select("domain", "ts", "event_id", "decision", "reason", "retry_after_ms"), hot)
    merged = _merged(_summaries(_within_slices(sliced)))
    retried = F.when(F.col("r").isNotNull(), F.col("slice"))
    last = merged.groupBy("domain").agg(
        F.max_by(F.struct("consecutive_rate_limits", "consecutive_failures", "updated_at"), "slice").alias("s"), F.max_by("r", retried).alias("r")
    ).select("domain", "s.*", "r.*")
    until = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + F.col("retry_after_ms"))
    return last.where("consecutive_rate_limits + consecutive_failures > 0").select(
        "domain", "consecutive_rate_limits", "consecutive_failures", until.alias("cooldown_until"), "last_reason", "updated_at"
    )
