"""From jobs to their final statuses as one plan.

Every job is started; those of domains that cool down wait. The others are fetched, what
came back is judged, pages that were really accessible are parsed and validated, and each
step is an event. The statuses are the fold of the events, as the lifecycle has it; retries
and pending actions come from the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, urls
from ..operators import access
from ..operators.jobs import lifecycle, route_retries, user_actions
from ..operators.network import Limits
from ..sources.recorded import fetch
from ..sources.staging import stage
from .extraction import extract


def coordinate(jobs: DataFrame, recorded: DataFrame, state: DataFrame, now: Column, random: Column, responses: DataFrame | None = None, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """One run over jobs: decisions, events, states, retries, actions, attempts, and the tables of extract().

    jobs: job_id, url, requested_fields, attempt, max_retries. recorded: as for fetch().
    state: as domain_state() gives it. attempts are decisions for the next domain_state(): what
    preflight holds back isn't among them, as no request was made.
    """
    known = stage(jobs.withColumns({"domain": urls.domain(F.col("url")), "attempt": F.coalesce("attempt", F.lit(0)) + 1}), "run-jobs")
    held = stage(access.preflight(known, state, now), "preflight")
    going = known.join(held.where("decision = 'ALLOW'"), "job_id", "left_semi")
    envelopes = stage(fetch(going.select("job_id", "url"), recorded), "envelopes")
    counters = state.select("domain", "consecutive_rate_limits", "consecutive_failures")
    judged = access.decide(envelopes, access.resolve_signals(access.signals(envelopes)), counters, F.unix_millis(now), random)
    waits = held.where("decision <> 'ALLOW'").select("job_id", "domain", "decision", "reason", F.col("retry_after_ms").cast("bigint").alias("retry_after_ms"))
    decisions = stage(judged.unionByName(waits, allowMissingColumns=True), "decisions")

    allowed = decisions.where("decision = 'ALLOW'").select("job_id")
    kind = http.first_header(F.col("headers"), "content-type")
    pages = envelopes.join(allowed, "job_id", "left_semi").select("job_id", http.body_text(F.col("raw_body")).alias("html"), kind.alias("content_type"), "body_truncated")
    read = responses.join(allowed, "job_id", "left_semi") if responses is not None else None
    tables = extract(known.join(allowed, "job_id", "left_semi").select("job_id", "requested_fields"), pages, read, limits)
    parsed = stage(tables["outcome"], "outcome")

    budgets = known.select("job_id", "attempt", "max_retries")
    routed = stage(route_retries(decisions.where("decision = 'RETRY_LATER'").join(budgets, "job_id"), now), "routed")
    asked, actions = user_actions(decisions, now)
    none = F.lit(None).cast("string")
    step = lambda rows, nth, kind, reason=none, error=none: rows.select("job_id", F.lit(nth).alias("event_id"), kind.alias("kind"), reason.alias("reason"), error.alias("error"))
    events = reduce(
        DataFrame.unionByName,
        [
            step(known, 0, F.lit("STARTED")), step(allowed, 1, F.lit("ALLOWED")), step(routed, 1, F.col("kind"), F.col("reason"), F.col("error")),
            step(asked, 1, F.col("kind"), F.col("reason"), F.col("error")), step(decisions.where("decision = 'DENY'"), 1, F.lit("DENIED"), F.col("reason"), F.col("message")),
            step(parsed, 2, F.when(F.col("decision") == "COMPLETE", "COMPLETED").otherwise("PARSER_FAILED"), none, F.col("error")),
        ],
    ).withColumn("ts", now)
    attempts = judged.select("domain", now.alias("ts"), F.col("job_id").alias("event_id"), "decision", "reason", "retry_after_ms")
    retries = routed.where("kind = 'RETRY_LATER'").select("job_id", "retry_at")
    return tables | {"outcome": parsed, "decisions": decisions, "events": events, "states": lifecycle(events), "retries": retries, "actions": actions, "attempts": attempts}
