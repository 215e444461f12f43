"""Streaks and domain states as merged summaries, against a fold in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from thresher.operators import access

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "domain string, ts timestamp, event_id long, decision string, reason string, retry_after_ms long"
KINDS = [("ALLOW", None), ("RETRY_LATER", "RATE_LIMITED"), ("RETRY_LATER", "TIMEOUT"), ("RETRY_LATER", None), ("DENY", "FORBIDDEN"), ("USER_ACTION_REQUIRED", "CAPTCHA"), (None, None)]


def _events(seed, n, allow):
    """Half of the events belong to one domain; several share a time."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        domain = "hot" if k % 2 else r.choice(["a", "b", "c", None, ""])
        decision, reason = KINDS[0] if r.random() < allow else r.choice(KINDS[1:])
        rows.append((domain, T0 + dt.timedelta(seconds=k // 7), k, decision, reason, r.randint(0, 10**6)))
    r.shuffle(rows)
    return rows


def _fold(rows):
    state, after = {}, {}
    for domain, ts, i, decision, reason, wait in sorted(rows, key=lambda x: x[1:3]):
        limits, failures, until, last, _ = state.get(domain, (0, 0, None, None, None))
        if decision == "ALLOW":
            limits, failures = 0, 0
        elif decision == "RETRY_LATER":
            limits, failures = limits + (reason == "RATE_LIMITED"), failures + (reason != "RATE_LIMITED")
            until, last = ts + dt.timedelta(milliseconds=wait), reason
        state[domain] = (limits, failures, until, last, ts)
        after[i] = (domain, limits, failures)
    return after, {d: s for d, s in state.items() if s[0] + s[1] > 0}


@pytest.mark.parametrize("hot", [10, 400, 10**6])
@pytest.mark.parametrize("allow", [0.3, 0.002, 0.0])
def test_streaks_and_states(spark, hot, allow):
    """All domains sliced, the hot one alone, none; islands shorter and longer than slices."""
    rows = _events(f"{allow}", 1200, allow)
    events = spark.createDataFrame(rows, SCHEMA)
    after, states = _fold(rows)
    found = access.streaks(events, ("retry_after_ms",), hot=hot).collect()
    assert len(found) == len(rows) and {r["event_id"]: (r["domain"], r["consecutive_rate_limits"], r["consecutive_failures"]) for r in found} == after
    assert {r["event_id"]: r["retry_after_ms"] for r in found} == {x[2]: x[5] for x in rows}
    got = {r["domain"]: (r["consecutive_rate_limits"], r["consecutive_failures"], r["cooldown_until"], r["last_reason"], r["updated_at"]) for r in access.domain_state(events, hot=hot).collect()}
    assert got == states


def test_a_hot_domain_is_dealt_over_all_tasks(spark):
    events = spark.createDataFrame(_events("even", 4000, 0.1), SCHEMA).repartition(4)
    sliced, several = access._sliced(events, 500)
    sizes = [r["count"] for r in sliced.where("domain = 'hot'").groupBy("slice").count().collect()]
    assert several and sum(sizes) == 2000 and len(sizes) >= 3 and max(sizes) < 1200
    # Within a slice events are a run: no other slice has one between its first and last.
    ends = sliced.where("domain = 'hot'").groupBy("slice").agg(F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b")).orderBy("slice").collect()
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(ends, ends[1:], strict=False))


def test_no_events(spark):
    events = spark.createDataFrame([], SCHEMA)
    assert access.streaks(events).count() == 0 and access.domain_state(events).count() == 0
