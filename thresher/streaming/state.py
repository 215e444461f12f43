"""Streams: deduplicated intake, job lifecycle, per-domain access state and timed retries.

The batch functions in operators are folds over events; these are the same folds kept as
state. The lifecycle is an aggregation that Spark keeps in the JVM. What needs time, the
cooldowns of domains and the retries of jobs, is a stateful processor with timers on the
watermark; it needs the RocksDB state store, see use_timers(). A key's rows of one batch are
held as a few numbers each, not as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import urls
from ..operators import jobs
from ..operators.access import RETRY_BASE

MAX_DELAY_MS = jobs.MAX_DELAY_MS
_NEVER = np.iinfo(np.int64).min


def use_timers(spark: SparkSession) -> None:
    """Sets the state store that timers need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def deduplicated(requests: DataFrame, window_ms: int = urls.WINDOW_MS, late: str = "1 minute") -> DataFrame:
    """The first request of each page and window. requests: job_id, url, created_at."""
    return jobs.with_keys(requests.withWatermark("created_at", late), window_ms).dropDuplicatesWithinWatermark(["dedup_key"])


def lifecycle(events: DataFrame) -> DataFrame:
    """The state of each job whenever a batch changes it, in update mode. events as for operators.jobs.lifecycle, whose aggregation this is."""
    return jobs.lifecycle(events)


# --- access state and preflight -------------------------------------------------------------

_ALLOW, _RETRY, _OTHER, _JOB = 0, 1, 2, 3
ACCESS = "domain string, kind string, job_id bigint, decision string, reason string, retry_after_ms bigint, consecutive_rate_limits int, consecutive_failures int, cooldown_until timestamp, updated_at timestamp"
_HELD = "limits int, failures int, until_ms bigint, reason string, at_ms bigint, timer_ms bigint"


def _carried(marks: np.ndarray) -> np.ndarray:
    """For each place the last place so far that is marked, -1 if none."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1)) if len(marks) else np.zeros(0, dtype=np.int64)


class DomainAccess(StatefulProcessor):
    """Folds decisions into the domain's counters and cooldown, and lets jobs of the domain go on or wait.

    State is dropped on an ALLOW, and `keep_ms` after the last cooldown has ended.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("domain", _HELD)

    def _compact(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """Order, code, wait, reason and job of all rows, in order of time and event."""
        parts = []
        for frame in rows:
            code = np.where(frame["kind"] == "job", _JOB, np.where(frame["decision"] == "ALLOW", _ALLOW, np.where(frame["decision"] == "RETRY_LATER", _RETRY, _OTHER)))
            ms = frame["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) // 1000
            parts.append(pd.DataFrame({"ms": ms, "event_id": frame["event_id"], "code": code, "wait": frame["retry_after_ms"].fillna(0).astype(np.int64), "reason": pd.Categorical(frame["reason"]).astype(object), "job_id": frame["job_id"]}))
        return pd.concat(parts).sort_values(["ms", "event_id"], kind="stable", ignore_index=True)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        limits, failures, until, reason, at, timer = self.held.get() if self.held.exists() else (0, 0, None, None, None, None)
        told = self._compact(rows)
        code, reasons, ms = told["code"].to_numpy(), told["reason"].to_numpy(dtype=object), told["ms"].to_numpy()
        retried, limited = code == _RETRY, (code == _RETRY) & (reasons == "RATE_LIMITED")
        allow, retry = _carried(code == _ALLOW), _carried(retried)
        # Cooldown before each row: of the last retry, if no ALLOW came after it.
        ends = ms + told["wait"].to_numpy()
        before = np.where(allow >= 0, _NEVER, _NEVER if until is None else until)
        cool = np.where(retry > allow, ends[np.maximum(retry, 0)], before)
        why = np.where(retry > allow, reasons[np.maximum(retry, 0)], np.where(allow >= 0, None, reason))
        asked = np.flatnonzero(code == _JOB)
        waits = cool[asked] > ms[asked]
        if any(x not in RETRY_BASE for x in why[asked][waits]):
            raise ValueError("cooldown without a retryable reason")
        decided = code != _JOB
        if decided.any():
            last = int(allow[-1])
            since = np.arange(len(code)) > last
            limits, failures = (0 if last >= 0 else limits) + int((limited & since).sum()), (0 if last >= 0 else failures) + int((retried & ~limited & since).sum())
            until, reason = (None, None) if cool[-1] == _NEVER else (int(cool[-1]), why[-1])
            at = int(ms[decided].max())
        if asked.size:
            stamp = pd.DataFrame({"domain": key[0], "kind": "job", "job_id": told["job_id"].to_numpy()[asked], "decision": np.where(waits, "RETRY_LATER", "ALLOW"), "reason": np.where(waits, why[asked], None)})
            stamp["retry_after_ms"] = pd.array(np.where(waits, cool[asked] - ms[asked], 0), dtype="Int64")
            stamp.loc[~waits, "retry_after_ms"] = pd.NA
            yield self._shaped(stamp)
        if decided.any():
            times = [pd.Timestamp(x, unit="ms") if x is not None else pd.NaT for x in (until, at)]
            yield self._shaped(pd.DataFrame([{"domain": key[0], "kind": "state", "reason": reason, "consecutive_rate_limits": limits, "consecutive_failures": failures, "cooldown_until": times[0], "updated_at": times[1]}]))
            if timer is not None:
                self.handle.deleteTimer(timer)
            if until is None and not limits and not failures:
                self.held.clear()
            else:
                timer = max((until or at) + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1)
                self.handle.registerTimer(timer)
                self.held.update((limits, failures, until, reason, at, timer))

    def _shaped(self, frame: pd.DataFrame) -> pd.DataFrame:
        kinds = {"bigint": "Int64", "int": "Int32", "string": "object", "timestamp": "datetime64[us]"}
        return pd.DataFrame({name: pd.Series(frame[name] if name in frame else None, index=frame.index).astype(kinds[kind]) for name, kind in (c.split() for c in ACCESS.split(", "))})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self.held.get()[5] == expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def access(rows: DataFrame, late: str = "1 minute", keep_ms: int = 24 * 3_600_000) -> DataFrame:
    """Preflight decisions of jobs and the changed states of domains, told apart by kind (job or state).

    rows: domain, ts, event_id, kind (decision or job), job_id, decision, reason,
    retry_after_ms. A job sees what came before it by time and event, in its own batch and
    in all batches before.
    """
    timed = rows.withWatermark("ts", late)
    return timed.groupBy("domain").transformWithStateInPandas(DomainAccess(keep_ms), ACCESS, "update", "eventTime")


# --- retries --------------------------------------------------------------------------------


class RetryTimers(StatefulProcessor):
    """One timer a job: scheduling again replaces it, cancelling deletes it, and when it comes the job is due."""

    def __init__(self, most_ms: int):
        self.most_ms = most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "scheduled_ms bigint, order_id bigint, retry_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:
            f = frame.sort_values(["scheduled_at", "order_id"], kind="stable").iloc[-1]
            if last is None or (f["scheduled_at"], f["order_id"]) >= (last["scheduled_at"], last["order_id"]):
                last = f
            kept = frame[~frame["cancelled"].fillna(False).astype(bool)]
            delay = (kept["retry_at"] - kept["scheduled_at"]).dt.total_seconds() * 1000
            if kept["retry_at"].isna().any() or (delay > self.most_ms).any() or (delay < 0).any():
                raise ValueError(f"a delay must lie between 0 and {self.most_ms} ms")
        stamp = int(last["scheduled_at"].value // 10**6), int(last["order_id"])
        old = self.task.get() if self.task.exists() else None
        if old is not None:
            if (old[0], old[1]) > stamp:
                return
            if old[2] is not None:
                self.handle.deleteTimer(old[2])
        if bool(last["cancelled"]):
            self.task.clear()
            return
        due = int(last["retry_at"].value // 10**6)
        if due <= timerValues.getCurrentWatermarkInMs():
            self.task.clear()
            yield self._due(key, due)
        else:
            self.handle.registerTimer(due)
            self.task.update((*stamp, due))

    def _due(self, key: tuple, due: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "retry_at": pd.Series([pd.Timestamp(due, unit="ms")], dtype="datetime64[us]")})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.task.exists() and self.task.get()[2] == due:
            self.task.clear()
            yield self._due(key, due)

    def close(self) -> None:
        pass


def retries(scheduled: DataFrame, late: str = "1 minute", most_ms: int = MAX_DELAY_MS) -> DataFrame:
    """job_id and retry_at of each retry once the watermark has reached it. scheduled: job_id, scheduled_at, order_id, retry_at, cancelled.

    A job's last row by scheduled_at and order_id counts. A delay beyond most_ms fails the query.
    """
    timed = scheduled.withWatermark("scheduled_at", late)
    return timed.groupBy("job_id").transformWithStateInPandas(RetryTimers(most_ms), "job_id bigint, retry_at timestamp", "append", "eventTime")
