"""Recorded responses instead of a network, and the sinks of stage tables.

A fetch is a join with a table of recorded responses. Failures become columns of the
envelope, never exceptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import http, urls

MAX_BODY = 10 * 1024 * 1024
ERROR = "struct<type: string, code: string, message: string>"


def fetch(jobs: DataFrame, recorded: DataFrame, max_body: int = MAX_BODY) -> DataFrame:
    """Envelopes of jobs (job_id, url) from recorded responses (url, status_code, headers, body, final_url, redirects, error_code, error_message).

    A job without a recorded response, or with a recorded failure, gets status 0 and a
    transport error. Bodies are cut at max_body bytes. Jobs and responses meet by hash on
    the URL; one response may serve many jobs.
    """
    one = recorded.groupBy("url").agg(F.max_by(F.struct(*[c for c in recorded.columns if c != "url"]), F.coalesce("status_code", F.lit(0))).alias("r"))
    rows = jobs.join(one, "url", "left").select(*jobs.columns, "r.*")
    none = F.col("status_code").isNull()
    code = F.when(none & F.col("error_code").isNull(), "ENOTFOUND").otherwise(F.col("error_code"))
    failed = none | F.col("error_code").isNotNull()
    error = F.struct(http.transport_type(code, F.lit(""), F.col("error_message")).alias("type"), code.alias("code"), F.col("error_message").alias("message"))
    kept = http.bounded_body(F.col("body"), max_body)
    final = F.coalesce("final_url", "url")
    return rows.select(
        *[c for c in jobs.columns if c != "url"], F.col("url").alias("requested_url"), urls.domain(F.col("url")).alias("domain"), final.alias("final_url"),
        http.redirect_chain(F.coalesce("redirects", F.array().cast("array<string>")), final).alias("redirects"), F.when(failed, 0).otherwise(F.col("status_code")).alias("status_code"),
        http.lower_headers(F.col("headers")).alias("headers"), F.when(~failed, kept["raw_body"]).alias("raw_body"), kept["body_bytes"].alias("body_bytes"), kept["body_truncated"].alias("body_truncated"),
        F.when(failed, error).alias("transport_error"), F.lit(None).cast(ERROR).alias("body_error"),
    )


def write_stages(tables: dict[str, DataFrame], folder: str) -> None:
    """Every stage table as Parquet under the folder."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
