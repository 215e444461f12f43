"""HTTP facts and retry arithmetic, as Column expressions.

Headers are map<string, array<string>>. Times are milliseconds; now and random numbers are
columns, so results are repeatable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

SAFE = 2**53 - 1
SENSITIVE = r"(?i)(^|[-_])(authorization|cookie|token|secret|api[-_]?key)($|[-_])"
REDACTED = "[REDACTED]"

# Error codes of each kind of transport failure, in order of precedence.
TIMEOUT_CODES = ("ETIMEDOUT", "ESOCKETTIMEDOUT", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT")
DNS_CODES = ("ENOTFOUND", "EAI_AGAIN")
TLS_CODES = (
    "EPROTO", "CERT_HAS_EXPIRED", "DEPTH_ZERO_SELF_SIGNED_CERT", "SELF_SIGNED_CERT_IN_CHAIN", "UNABLE_TO_VERIFY_LEAF_SIGNATURE",
    "ERR_TLS_CERT_ALTNAME_INVALID", "ERR_SSL_PROTOCOL_ERROR",
)
CONNECTION_CODES = ("ECONNREFUSED", "ECONNRESET", "ECONNABORTED", "EHOSTUNREACH", "ENETUNREACH", "EPIPE", "UND_ERR_SOCKET")


def lower_headers(headers: Column) -> Column:
    """Names in lower case; values of names that then agree come together."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    gathered = lambda n: F.flatten(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, gathered(n))))


def first_header(headers: Column, name: str) -> Column:
    return F.get(headers[name.lower()], F.lit(0))


def redact_headers(headers: Column) -> Column:
    """map<string, string> without the values of sensitive names."""
    return F.transform_values(headers, lambda k, v: F.when(k.rlike(SENSITIVE), F.lit(REDACTED)).otherwise(v))


def content_length(x: Column) -> Column:
    n = trim(x).try_cast("bigint")
    return F.when(trim(x).rlike(r"^\d+$") & (n <= SAFE), n)


def bounded_body(body: Column, most: int) -> dict[str, Column]:
    """raw_body (null if empty), body_bytes and body_truncated of a binary body cut at `most` bytes."""
    size = F.octet_length(body)
    cut = F.substring(body, 1, most)
    return {
        "raw_body": F.when(size > 0, cut),
        "body_bytes": F.coalesce(F.least(size, F.lit(most)), F.lit(0)).cast("bigint"),
        "body_truncated": F.coalesce(size > most, F.lit(False)),
    }


def body_text(body: Column) -> Column:
    """UTF-8, invalid bytes replaced."""
    return F.make_valid_utf8(body.cast("string"))


def redirect_chain(redirects: Column, final_url: Column) -> Column:
    """Empty if there were none; else it ends with the final URL."""
    ends = F.element_at(redirects, -1) == final_url
    return F.when(F.size(redirects) <= 0, redirects).when(ends, redirects).otherwise(F.array_append(redirects, final_url))


def media_type(content_type: Column) -> Column:
    return F.lower(trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def is_text_like(content_type: Column) -> Column:
    kind = media_type(content_type)
    found = kind.startswith("text/")
    for word in ("json", "xml", "javascript", "graphql"):
        found = found | kind.contains(word)
    return found


def html_gate(content_type: Column, body_bytes: Column) -> Column:
    """Whether HTML extraction applies: there is a body, and no other type is stated."""
    kind = F.lower(content_type)
    return (body_bytes > 0) & (kind.isNull() | kind.contains("text/html") | kind.contains("application/xhtml+xml"))


def transport_type(code: Column, name: Column, message: Column) -> Column:
    """TIMEOUT, DNS_ERROR, TLS_ERROR, CONNECTION_ERROR or OTHER, the first that applies."""
    blank = lambda x: F.lower(F.coalesce(x, F.lit("")))
    code, name, message = F.upper(F.coalesce(code, F.lit(""))), blank(name), blank(message)
    tls = code.isin(*TLS_CODES) | name.contains("tls") | message.contains("certificate") | message.contains("ssl handshake")
    return (
        F.when(code.isin(*TIMEOUT_CODES) | name.contains("timeout"), "TIMEOUT").when(code.isin(*DNS_CODES) | message.contains("getaddrinfo"), "DNS_ERROR")
        .when(tls, "TLS_ERROR").when(code.isin(*CONNECTION_CODES), "CONNECTION_ERROR").otherwise("OTHER")
    )


def omission_reason(content_type: Column, declared: Column, actual: Column, left: Column, timed_out: Column, most: int) -> Column:
    """Why a captured body isn't kept; null if it is. left: what is left of the budget."""
    return (
        F.when(F.coalesce(trim(content_type), F.lit("")) == "", "MISSING_CONTENT_TYPE").when(media_type(content_type) == "text/event-stream", "STREAMING")
        .when(~is_text_like(content_type), "NON_TEXT").when(declared > most, "RESPONSE_TOO_LARGE").when(declared > left, "BUDGET_EXHAUSTED")
        .when(timed_out, "TIMEOUT").when(actual.isNull(), "UNAVAILABLE").when(actual > most, "RESPONSE_TOO_LARGE").when(actual > left, "BUDGET_EXHAUSTED")
    )


def retry_after_ms(values: Column, now_ms: Column) -> Column:
    """The wait that the first usable Retry-After value asks for: seconds, or an HTTP date."""

    def one(raw: Column) -> Column:
        x = trim(raw)
        seconds = x.try_cast("bigint")
        date = F.try_to_timestamp(F.concat(F.regexp_extract(x, r"^[A-Za-z]+,? +(\d{1,2}[ -][A-Za-z]{3}[ -]\d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
        return F.when(x.rlike(r"^\d+$"), F.when(seconds * 1000 <= SAFE, seconds * 1000)).when(date.isNotNull(), F.greatest(F.lit(0), F.unix_millis(date) - now_ms))

    usable = F.filter(F.transform(values, one), lambda v: v.isNotNull())
    return F.get(usable, F.lit(0))


def backoff(base: Column, multiplier: float, earlier: Column, most: int) -> Column:
    x = base * F.pow(F.lit(multiplier), earlier)
    return F.when(x.isNull() | F.isnan(x) | (x == float("inf")), F.lit(float(most))).otherwise(F.least(x, F.lit(float(most))))


def jitter(delay: Column, ratio: float, random: Column) -> Column:
    r = F.least(F.greatest(random, F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.lit(0.0), delay + delay * ratio * (2 * r - 1))


def retry_delay(base: Column, multiplier: float, earlier: Column, most: int, ratio: float, random: Column, server: Column) -> Column:
    """Milliseconds to wait: backoff with jitter, never less than the server asks, and at most `most` unless the server asks for more."""
    asked = F.greatest(backoff(base, multiplier, earlier, most), server)
    shaken = F.greatest(jitter(asked, ratio, random), server)
    capped = F.when(server > most, shaken).otherwise(F.least(shaken, F.lit(float(most))))
    return F.greatest(F.lit(0), F.floor(capped + 0.5)).cast("bigint")


def attempts_left(max_retries: Column, attempt: Column, default: int = 3) -> Column:
    return F.greatest(F.lit(0), F.coalesce(max_retries, F.lit(default)) + 1 - attempt - 1)


def contains_any(x: Column, markers: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(x, m))
