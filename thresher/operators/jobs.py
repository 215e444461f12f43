"""Jobs: intake, deduplication, lifecycle and retries, as tables.

A job spec: url, requested_fields (array of struct<name, type, description, aliases, paths,
required>), max_retries, priority, created_at. State is what a fold over events gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import normalize_simple, trim

FIELD_TYPE = "struct<name: string, type: string, description: string, aliases: array<string>, paths: array<string>, required: boolean>"
TYPES = ("string", "number", "boolean", "array")
SAFE, MAX_DELAY_MS = 2**53 - 1, 2**31 - 1
#: The status after each transition.
TRANSITIONS = {
    "ENQUEUED": "QUEUED", "STARTED": "PROCESSING", "RETRY_LATER": "RETRY_SCHEDULED", "USER_ACTION": "USER_ACTION_REQUIRED", "DENIED": "FAILED_FINAL",
    "ALLOWED": "READY_FOR_PARSING", "COMPLETED": "SUCCESS", "PARSER_FAILED": "PARSER_FAILED", "EXCEPTION": "RETRYING", "FAILED": "FAILED_FINAL", "REQUEUED": "QUEUED",
}


def input_errors(specs: DataFrame) -> DataFrame:
    """specs with errors, the codes of every rule that a spec breaks, in order."""
    fields = F.col("requested_fields")
    blank = lambda x: F.coalesce(trim(x), F.lit("")) == ""
    any_field = lambda p: F.coalesce(F.exists(fields, p), F.lit(False))
    names = F.transform(fields, lambda f: normalize_simple(f["name"]))
    any_blank = lambda part: any_field(lambda f: F.coalesce(F.exists(f[part], blank), F.lit(False)))
    rules = {
        "URL_INVALID": urls.valid_http_url(F.col("url"), trimmed=False).isNull(),
        "FIELDS_EMPTY": F.coalesce(F.size(fields), F.lit(0)) <= 0,
        "FIELD_NAME_BLANK": any_field(lambda f: blank(f["name"])),
        "FIELD_NAME_REPEATED": F.coalesce(F.size(F.array_distinct(names)) < F.size(names), F.lit(False)),
        "FIELD_TYPE_UNKNOWN": any_field(lambda f: ~F.coalesce(f["type"].isin(*TYPES), F.lit(False))),
        "ALIAS_BLANK": any_blank("aliases"),
        "PATH_BLANK": any_blank("paths"),
        "MAX_RETRIES_INVALID": F.coalesce((F.col("max_retries") < 0) | (F.col("max_retries") > SAFE), F.lit(False)),
        "PRIORITY_INVALID": F.coalesce(F.abs("priority") > SAFE, F.lit(False)),
    }
    found = F.array(*(F.when(broken, code) for code, broken in rules.items()))
    return specs.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def with_keys(specs: DataFrame, window_ms: int = urls.WINDOW_MS) -> DataFrame:
    """specs with domain and dedup_key; forced ones (column force) get a key of their own from job_id."""
    identity = urls.base_identity(F.col("url"))
    force = F.coalesce(F.col("force"), F.lit(False)) if "force" in specs.columns else F.lit(False)
    key = F.when(force, urls.forced_key(identity, F.col("job_id").cast("string"))).otherwise(urls.dedup_key(identity, F.col("created_at"), window_ms))
    return specs.withColumns({"domain": urls.domain(F.col("url")), "dedup_key": key})


def enqueue(specs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """For each valid spec: job_id that now stands for it, duplicate, and the initial state.

    specs: job_id, url, created_at, ... with_keys(). stored: dedup_key and job_id of jobs from
    before. Of specs with one key the earliest, then the least job_id, is stored.
    """
    first = specs.groupBy("dedup_key").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("first_id"))
    if stored is not None:
        older = stored.groupBy("dedup_key").agg(F.min("job_id").alias("older_id"))
        first = first.join(older, "dedup_key", "left").select("dedup_key", F.coalesce("older_id", "first_id").alias("first_id"))
    rows = specs.select(F.col("job_id").alias("request_id"), "dedup_key", "domain").join(first, "dedup_key")
    return rows.select(
        "request_id", F.col("first_id").alias("job_id"), "domain", "dedup_key", (F.col("request_id") != F.col("first_id")).alias("duplicate"),
        F.lit("QUEUED").alias("status"), F.lit(0).alias("attempt"), F.lit(0).alias("deferred_retry_count"),
    )


def requested_fields(jobs: DataFrame) -> DataFrame:
    """A row for each requested field."""
    return jobs.select("job_id", F.posexplode("requested_fields").alias("field_ord", "f")).select(
        "job_id", F.col("f.name").alias("field"), "field_ord", "f.type", "f.aliases", "f.paths", F.coalesce("f.required", F.lit(False)).alias("required")
    )


def lifecycle(events: DataFrame) -> DataFrame:
    """The state of each job after its events: job_id, ts, event_id, kind, reason, error.

    Transitions don't look at the status before, so the status is that of the last event,
    counters are counts, and reason and error are those of the last event that sets or
    clears them. A retry without a message keeps the error before; a failure takes its own
    reason, and clears the reason if it has none.
    """
    order = F.struct("ts", "event_id")
    status = F.create_map(*(F.lit(x) for pair in TRANSITIONS.items() for x in pair))[F.col("kind")]
    sets_reason = F.col("kind").isin("RETRY_LATER", "USER_ACTION", "DENIED", "FAILED")
    clears_reason = F.col("kind").isin("ALLOWED", "COMPLETED", "EXCEPTION")
    sets_error = F.col("kind").isin("USER_ACTION", "DENIED", "PARSER_FAILED", "EXCEPTION", "FAILED") | ((F.col("kind") == "RETRY_LATER") & F.col("error").isNotNull())
    clears_error = F.col("kind").isin("ALLOWED", "COMPLETED")
    last = lambda sets, clears, x: F.max_by(F.struct(F.when(sets, x).alias("x")), F.when(sets | clears, order))["x"]
    return events.groupBy("job_id").agg(
        F.max_by(status, order).alias("status"),
        F.count_if(F.col("kind") == "STARTED").alias("attempt"),
        F.count_if(F.col("kind") == "RETRY_LATER").alias("deferred_retry_count"),
        last(sets_reason, clears_reason, F.col("reason")).alias("last_access_reason"),
        last(sets_error, clears_error, F.col("error")).alias("last_error"),
        F.max("ts").alias("updated_at"),
    )


def queue_stats(states: DataFrame) -> DataFrame:
    """total, handled (final states) and pending jobs."""
    handled = F.col("status").isin("SUCCESS", "PARSER_FAILED", "FAILED_FINAL")
    return states.agg(F.count("*").alias("total"), F.count_if(handled).alias("handled"), F.count_if(~handled).alias("pending"))


def route_retries(waiting: DataFrame, now: Column, carried: tuple[str, ...] = ()) -> DataFrame:
    """Of jobs that are to wait (job_id, attempt, max_retries, retry_after_ms, reason, message): scheduled with retry_at, or failed as the budget is spent. Columns to carry come along."""
    spent = F.col("attempt") >= F.coalesce("max_retries", F.lit(3)) + 1
    error = F.concat(F.lit("Retry budget exhausted after "), F.col("attempt").cast("string"), F.lit(" attempts. "), F.coalesce("message", F.lit("")))
    at = F.timestamp_millis(F.unix_millis(now) + F.least(F.col("retry_after_ms"), F.lit(MAX_DELAY_MS)))
    return waiting.select(
        "job_id", F.when(spent, "FAILED").otherwise("RETRY_LATER").alias("kind"), "reason", F.when(spent, error).otherwise(F.col("message")).alias("error"),
        F.when(~spent, at).alias("retry_at"), *carried,
    )


def due_retries(scheduled: DataFrame, now: Column) -> DataFrame:
    """One retry for each job, the one scheduled last, if its time has come. scheduled: job_id, scheduled_at, retry_at, cancelled."""
    last = scheduled.groupBy("job_id").agg(F.max_by(F.struct("retry_at", "cancelled"), "scheduled_at").alias("s")).select("job_id", "s.*")
    return last.where(~F.coalesce("cancelled", F.lit(False)) & (F.col("retry_at") <= now)).select("job_id", "retry_at")


def requeue(jobs: DataFrame, cause: str, unique: Column) -> DataFrame:
    """Jobs with attempts left, back in the queue under a fresh key; counters stay."""
    open_ = F.col("attempt") < F.coalesce("max_retries", F.lit(3)) + 1
    return jobs.where(open_).select("job_id", F.concat(F.lit("job:"), F.col("job_id").cast("string"), F.lit(f":{cause}:"), unique).alias("queue_key"), F.lit("QUEUED").alias("status"), "attempt")


def pending_actions(changes: DataFrame) -> DataFrame:
    """The pending action of each job: the last one set and not deleted. changes: job_id, ts, op (set or delete), action, action_url."""
    last = changes.groupBy("job_id").agg(F.max_by(F.struct("op", "action", "action_url", F.col("ts").alias("created_at")), "ts").alias("c"))
    return last.where("c.op = 'set'").select("job_id", "c.action", "c.action_url", "c.created_at")


def user_actions(decisions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Of decisions that ask for the user: events for lifecycle() but for event_id, and changes for pending_actions().

    decisions: job_id, decision, reason, message, action, action_url. Both tables come from the
    same rows, so no job is marked whose action isn't stored. A null time fails the query.
    """
    asked = decisions.where(F.col("decision") == "USER_ACTION_REQUIRED").withColumn("ts", F.coalesce(at, F.raise_error(F.lit("no time of the decision"))))
    events = asked.select("job_id", "ts", F.lit("USER_ACTION").alias("kind"), "reason", F.col("message").alias("error"))
    return events, asked.select("job_id", "ts", F.lit("set").alias("op"), "action", "action_url")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """sequence: the place of each row within its key, from 0."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
