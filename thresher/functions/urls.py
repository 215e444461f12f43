"""URL validation, domains and identity, as Column expressions. Bad URLs give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

WINDOW_MS = 30_000


def valid_http_url(url: Column, trimmed: bool = True) -> Column:
    """The URL if its scheme is http or https and it has a host, else null."""
    x = trim(url) if trimmed else url
    scheme = F.lower(F.try_parse_url(x, F.lit("PROTOCOL")))
    host = F.try_parse_url(x, F.lit("HOST"))
    return F.when(scheme.isin("http", "https") & (F.coalesce(host, F.lit("")) != ""), x)


def domain(url: Column, keep_dot: bool = False) -> Column:
    """The host in lower case, without one trailing dot unless that is to be kept."""
    host = F.lower(F.try_parse_url(trim(url), F.lit("HOST")))
    return host if keep_dot else F.regexp_replace(host, r"\.$", "")


def base_identity(url: Column) -> Column:
    """What makes two URLs the same page: lower-case scheme and host, no fragment, no utm_ parameters, the others sorted, no trailing slash."""
    x = trim(url)
    part = lambda p: F.try_parse_url(x, F.lit(p))
    port = F.regexp_extract(x, r"^[^:]+://[^/?#]*?(:\d+)(?=[/?#]|$)", 1)
    usual = ((F.lower(part("PROTOCOL")) == "http") & (port == ":80")) | ((F.lower(part("PROTOCOL")) == "https") & (port == ":443"))
    pairs = F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    query = F.array_join(F.array_sort(pairs), "&")
    path = F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", "")
    return F.concat(
        F.lower(part("PROTOCOL")), F.lit("://"), F.lower(part("HOST")), F.when(usual, "").otherwise(port), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    )


def dedup_key(identity: Column, at: Column, window_ms: int = WINDOW_MS) -> Column:
    """Requests for one page within one tumbling window share a key."""
    return F.concat(identity, F.lit(":window:"), F.floor(F.unix_millis(at) / window_ms).cast("string"))


def forced_key(identity: Column, unique: Column) -> Column:
    return F.concat(identity, F.lit(":force:"), unique)
