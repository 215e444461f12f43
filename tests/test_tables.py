"""Change-log tables under batches that are replayed, that fail between two tables, and that are compacted."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from thresher.streaming import tables
from thresher.streaming.tables import Tables

T0 = dt.datetime(2024, 1, 1)
DECISIONS = "job_id long, ts timestamp, decision string, reason string, message string, retry_after_ms long, attempt int, max_retries int, action string, action_url string"


def _decisions(seed, batch, n=60):
    r = random.Random(f"{seed}{batch}")
    rows = []
    for k in range(n):
        kind = r.choice(["ALLOW", "DENY", "RETRY_LATER", "RETRY_LATER", "USER_ACTION_REQUIRED"])
        asks = kind == "USER_ACTION_REQUIRED"
        rows.append((
            r.randint(0, 15), T0 + dt.timedelta(seconds=batch * 100 + k), kind, None if kind == "ALLOW" else "TIMEOUT", f"m{batch}-{k}", r.randint(0, 10**6), r.randint(0, 5), r.choice([None, 2]),
            "LOGIN" if asks else None, f"u{k}" if asks else None,
        ))
    return rows


def _fold(rows):
    """states, retries and actions as plain Python leaves them."""
    states, retries, actions = {}, {}, {}
    for job, ts, kind, reason, message, wait, attempt, most, action, url in sorted(rows, key=lambda x: x[1]):
        retries.pop(job, None)
        actions.pop(job, None)
        if kind == "RETRY_LATER":
            spent = attempt >= (3 if most is None else most) + 1
            states[job] = "FAILED" if spent else "RETRY_LATER"
            if not spent:
                retries[job] = ts + dt.timedelta(milliseconds=wait)
        else:
            states[job] = {"ALLOW": "ALLOWED", "DENY": "DENIED", "USER_ACTION_REQUIRED": "USER_ACTION"}[kind]
            if kind == "USER_ACTION_REQUIRED":
                actions[job] = (action, url)
    return states, retries, actions


def _read(t):
    return (
        {r["job_id"]: r["kind"] for r in t.read("states").collect()}, {r["job_id"]: r["retry_at"] for r in t.read("retries").collect()},
        {r["job_id"]: (r["action"], r["action_url"]) for r in t.read("actions").collect()},
    )


def test_batches_replayed_failed_and_compacted(spark, tmp_path):
    t = tables.coordination(spark, str(tmp_path / "t"))
    assert _read(t) == ({}, {}, {})
    made = [_decisions("a", k) for k in range(4)]
    frame = lambda rows: spark.createDataFrame(rows, DECISIONS)
    assert t.commit(0, tables.decided(frame(made[0]))) and not t.commit(0, tables.decided(frame(made[3])))
    assert _read(t) == _fold(made[0])

    broken = tables.decided(frame(made[1]))
    broken["actions"] = broken["actions"].withColumn("action", F.raise_error(F.lit("the second store fails")).cast("string"))
    with pytest.raises(Exception, match="second store"):
        t.commit(1, broken)
    assert _read(t) == _fold(made[0])  # nothing of the batch shows, though the first tables were written
    assert t.commit(1, tables.decided(frame(made[1])))
    assert _read(t) == _fold(made[0] + made[1])

    t.compact()
    assert _read(t) == _fold(made[0] + made[1])
    assert not t.commit(1, tables.decided(frame(made[3])))  # older than the snapshot
    assert t.commit(2, tables.decided(frame(made[2])))
    t.compact()
    t.compact()
    assert t.commit(3, tables.decided(frame(made[3])))
    assert _read(t) == _fold([x for b in made for x in b])
    assert len(list((tmp_path / "t/states").glob("snapshot-*"))) == 1 and len(list((tmp_path / "t/states/log").glob("_batch=*"))) == 1


def test_a_failed_compaction_leaves_the_tables(spark, tmp_path):
    t = tables.coordination(spark, str(tmp_path / "t"))
    made = [_decisions("b", k) for k in range(2)]
    for k, rows in enumerate(made):
        t.commit(k, tables.decided(spark.createDataFrame(rows, DECISIONS)))
    note, t._note = t._note, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        t.compact()
    assert _read(t) == _fold(made[0] + made[1])
    t._note = note
    t.compact()
    assert _read(t) == _fold(made[0] + made[1])


def test_a_stream_that_fails_and_goes_on(spark, tmp_path):
    """The query dies once between its tables; started again from its checkpoint it replays the batch."""
    made = [_decisions("c", k) for k in range(3)]
    for k, rows in enumerate(made):
        spark.createDataFrame(rows, DECISIONS).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    t = tables.coordination(spark, str(tmp_path / "t"))
    failing = {1}

    def store(rows, batch):
        changes = tables.decided(rows)
        if batch in failing:
            failing.discard(batch)
            changes["actions"] = changes["actions"].withColumn("action", F.raise_error(F.lit("lost")).cast("string"))
        t.commit(batch, changes)

    def run():
        stream = spark.readStream.schema(DECISIONS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)

    with pytest.raises(Exception, match="lost"):
        run()
    assert _read(t) == _fold(made[0])
    run()
    assert _read(t) == _fold([x for b in made for x in b])


def test_unknown_tables_are_refused(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), {"a": ["k"]}, {"a": "k long, ts timestamp"})
    with pytest.raises(ValueError, match="no such"):
        t.commit(0, {"b": spark.range(1)})
