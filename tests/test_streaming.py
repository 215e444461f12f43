import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from thresher.operators import access, jobs
from thresher.sources.staging import dealt
from thresher.streaming import state

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def timers(spark):
    """Timers need the RocksDB state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    state.use_timers(spark)
    yield
    spark.conf.set(name, before)


def _stream(spark, folder, schema, batches):
    """A stream of the batches, one file each, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
        time.sleep(0.02)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _run(stream, name, mode, folder):
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(240)
    return stream.sparkSession.table(name).collect()


RETRY = "job_id long, scheduled_at timestamp, order_id long, retry_at timestamp, cancelled boolean"


def test_retries_come_when_they_are_due(spark, tmp_path, timers):
    """Replaced, cancelled, late and due timers, against the batch form at the last watermark."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    row = lambda job, s, k, due, off=False: (job, at(s), k, None if due is None else at(due), off)
    batches = [
        [row(1, 0, 0, 100), row(2, 0, 1, 100), row(3, 0, 2, 100), row(4, 0, 3, 5000)] + [row(10, 0, 10 + k, 50 + k) for k in range(40)],
        [row(2, 10, 4, 4000), row(3, 10, 5, None, True), row(1, 5, 1, 300), row(1, 5, 0, 200)],
        [row(9, 400, 6, 400)],
        [row(9, 500, 7, 900), row(3, 500, 8, 600)],
        [row(8, 1000, 9, 1500)],
        [row(7, 1100, 9, 9999)],
    ]
    found = _run(state.retries(_stream(spark, tmp_path, RETRY, batches), late="0 seconds"), "retries", "append", tmp_path)
    assert sorted((r["job_id"], (r["retry_at"] - T0).total_seconds()) for r in found) == [(1, 300), (3, 600), (9, 900), (10, 89)]
    whole = spark.createDataFrame([x for b in batches for x in b], RETRY).withColumn("scheduled_at", F.struct("scheduled_at", "order_id"))
    due = jobs.due_retries(whole, F.lit(at(1100))).collect()
    assert {(r["job_id"], r["retry_at"]) for r in due} == {(r["job_id"], r["retry_at"]) for r in found}


@pytest.mark.parametrize("due", [2**31 / 1000, -1])
def test_retry_delays_are_bounded(spark, tmp_path, timers, due):
    bad = [[(1, T0, 0, T0 + dt.timedelta(seconds=due), False)]]
    with pytest.raises(Exception, match="delay must lie"):
        _run(state.retries(_stream(spark, tmp_path, RETRY, bad)), f"bad{int(due > 0)}", "append", tmp_path)


ACCESS_ROWS = "domain string, ts timestamp, event_id long, kind string, job_id long, decision string, reason string, retry_after_ms long"


def test_a_cooldown_of_one_batch_holds_back_jobs_of_the_next(spark, tmp_path, timers):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    told = lambda d, s, k, decision, reason=None, wait=None: (d, at(s), k, "decision", None, decision, reason, wait)
    job = lambda d, s, k: (d, at(s), k, "job", k, None, None, None)
    batches = [
        [job("a", 0, 1), told("a", 1, 2, "RETRY_LATER", "RATE_LIMITED", 60_000), job("a", 1, 3), told("b", 1, 4, "RETRY_LATER", "TIMEOUT", 60_000), told("b", 2, 5, "ALLOW")],
        [job("a", 30, 6), job("b", 30, 7), job("c", 30, 8), told("a", 31, 9, "DENY", "FORBIDDEN")],
        [job("a", 61, 10), job("a", 62, 11), told("a", 63, 12, "RETRY_LATER", "TIMEOUT", 1000)],
        [job("a", 64, 13), told("a", 65, 14, "ALLOW"), job("a", 66, 15)],
    ]
    found = _run(state.access(_stream(spark, tmp_path, ACCESS_ROWS, batches)), "access", "update", tmp_path)
    jobs_ = {r["job_id"]: (r["decision"], r["reason"], r["retry_after_ms"]) for r in found if r["kind"] == "job"}
    assert jobs_ == {
        1: ("ALLOW", None, None), 3: ("RETRY_LATER", "RATE_LIMITED", 60_000), 6: ("RETRY_LATER", "RATE_LIMITED", 31_000), 7: ("ALLOW", None, None), 8: ("ALLOW", None, None),
        10: ("ALLOW", None, None), 11: ("ALLOW", None, None), 13: ("ALLOW", None, None), 15: ("ALLOW", None, None),
    }
    states = [(r["domain"], r["consecutive_rate_limits"], r["consecutive_failures"], r["cooldown_until"], r["reason"]) for r in found if r["kind"] == "state"]
    assert sorted(states, key=str) == sorted([
        ("a", 1, 0, at(61), "RATE_LIMITED"), ("b", 0, 0, None, None), ("a", 1, 0, at(61), "RATE_LIMITED"), ("a", 1, 1, at(64), "TIMEOUT"), ("a", 0, 0, None, None),
    ], key=str)


def test_streamed_domain_states_are_the_batch_states(spark, tmp_path, timers):
    """One domain has half of all decisions."""
    r = random.Random(3)
    rows = []
    for k in range(900):
        decision, reason = r.choice([("ALLOW", None), ("DENY", "FORBIDDEN")] + [("RETRY_LATER", x) for x in ("RATE_LIMITED", "TIMEOUT", "DNS_ERROR")] * 3)
        rows.append(("hot" if k % 2 else f"d{k % 11}", T0 + dt.timedelta(seconds=k // 3), k, "decision", None, decision, reason, r.randint(0, 10**6)))
    batches = [rows[k : k + 225] for k in range(0, 900, 225)]
    for b in batches:
        r.shuffle(b)
    found = _run(state.access(_stream(spark, tmp_path, ACCESS_ROWS, batches)), "domains", "update", tmp_path)
    last = {}
    for x in found:
        if x["domain"] not in last or x["updated_at"] >= last[x["domain"]]["updated_at"]:
            last[x["domain"]] = x
    got = {(x["domain"], x["consecutive_rate_limits"], x["consecutive_failures"], x["cooldown_until"], x["reason"], x["updated_at"]) for x in last.values() if x["consecutive_rate_limits"] + x["consecutive_failures"]}
    batch = access.domain_state(spark.createDataFrame(rows, ACCESS_ROWS), hot=100).collect()
    assert got == {(x["domain"], x["consecutive_rate_limits"], x["consecutive_failures"], x["cooldown_until"], x["last_reason"], x["updated_at"]) for x in batch}


def test_idle_domains_are_forgotten(spark, tmp_path, timers):
    told = lambda d, s, k: (d, T0 + dt.timedelta(seconds=s), k, "decision", None, "RETRY_LATER", "TIMEOUT", 1000)
    batches = [[told("a", 0, 1)], [told("b", 5000, 2)], [told("b", 5001, 3)], [told("a", 5002, 4)]]
    found = _run(state.access(_stream(spark, tmp_path, ACCESS_ROWS, batches), late="0 seconds", keep_ms=60_000), "idle", "update", tmp_path)
    assert [r["consecutive_failures"] for r in found if r["domain"] == "a"] == [1, 1] and [r["consecutive_failures"] for r in found if r["domain"] == "b"] == [1, 2]


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    kinds = ["ENQUEUED", "STARTED", "RETRY_LATER", "STARTED", "ALLOWED", "COMPLETED", "EXCEPTION", "RETRY_LATER", "FAILED", "PARSER_FAILED"]
    rows = [(j, T0 + dt.timedelta(seconds=k), k, kinds[(j + k) % 10], "TIMEOUT" if k % 2 else None, f"e{k}" if k % 3 else None) for j in range(12) for k in range(9)]
    events = spark.createDataFrame(rows, "job_id long, ts timestamp, event_id long, kind string, reason string, error string")
    for n in (0, 1):
        events.where(f"event_id {'<' if n == 0 else '>='} 5").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.lifecycle(stream).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {}
    for r in spark.table("states").collect():
        if r["job_id"] not in last or r["updated_at"] >= last[r["job_id"]]["updated_at"]:
            last[r["job_id"]] = r
    batch = {r["job_id"]: r for r in jobs.lifecycle(events).collect()}
    assert {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in batch.items()}


def test_lifecycle_keeps_and_clears(spark):
    """A retry without a message keeps the last error; a failure has its own reason or none."""
    step = lambda job, k, kind, reason, error: (job, T0 + dt.timedelta(seconds=k), k, kind, reason, error)
    rows = [
        step(1, 0, "RETRY_LATER", "TIMEOUT", "first"), step(1, 1, "RETRY_LATER", "RATE_LIMITED", None),
        step(2, 0, "RETRY_LATER", "TIMEOUT", "first"), step(2, 1, "FAILED", None, "last"),
        step(3, 0, "ALLOWED", None, None), step(3, 1, "FAILED", "FORBIDDEN", "refused"),
    ]
    events = spark.createDataFrame(rows, "job_id long, ts timestamp, event_id long, kind string, reason string, error string")
    found = {r["job_id"]: (r["status"], r["last_access_reason"], r["last_error"]) for r in jobs.lifecycle(events).collect()}
    assert found == {1: ("RETRY_SCHEDULED", "RATE_LIMITED", "first"), 2: ("FAILED_FINAL", None, "last"), 3: ("FAILED_FINAL", "FORBIDDEN", "refused")}


def test_deduplication_by_window(spark, tmp_path):
    rows = [(1, "http://a.example/", T0), (2, "http://a.example/#x", T0 + dt.timedelta(seconds=5)), (3, "http://a.example/", T0 + dt.timedelta(seconds=31))]
    spark.createDataFrame(rows, "job_id long, url string, created_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, url string, created_at timestamp").parquet(str(tmp_path / "in"))
    query = state.deduplicated(stream).writeStream.format("memory").queryName("requests").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["dedup_key"].rsplit(":", 1)[1] for r in spark.table("requests").collect()) == ["56802240", "56802241"]


def test_user_actions_come_from_the_same_rows(spark):
    schema = "job_id long, decision string, reason string, message string, action string, action_url string"
    rows = [(1, "ALLOW", None, None, None, None), (2, "USER_ACTION_REQUIRED", "CAPTCHA", "solve it", "CAPTCHA", "u"), (None, "USER_ACTION_REQUIRED", "CAPTCHA", None, None, None)]
    decisions = spark.createDataFrame(rows, schema)
    events, changes = jobs.user_actions(decisions, F.timestamp_millis(F.lit(0)))
    assert {r.job_id for r in events.collect()} == {r.job_id for r in changes.collect()} == {2, None}
    assert jobs.user_actions(decisions.where("false"), F.timestamp_millis(F.lit(0)))[0].count() == 0
    with pytest.raises(Exception, match="no time"):
        jobs.user_actions(decisions, F.lit(None).cast("timestamp"))[0].collect()


def test_small_inputs_are_dealt_over_all_cores(spark):
    one = spark.range(100).coalesce(1)
    assert dealt(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt(one).collect()) == list(range(100))
    assert dealt(one.where("id < 0")).count() == 0
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
        assert dealt(one).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
