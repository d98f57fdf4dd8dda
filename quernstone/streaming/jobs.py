"""A queue of jobs as keyed state over a stream of what happens to them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a job may be told, and what it is then.
AFTER = {"enqueue": "queued", "claim": "running", "heartbeat": "running", "complete": "done"}
FINAL = ("done", "failed")
_STATE = "status string, attempts int, seen_ms long"
_OUT = "job string, status string, attempts int, at_ms long"


def next_status(status: str | None, attempts: int, event: str, retries: int) -> tuple[str | None, int]:
    """Status and attempts of a job after an event; finished jobs stay so, and what makes no sense in a status changes nothing."""
    if status in FINAL:
        return status, attempts
    if event == "enqueue":
        return (status or "queued"), attempts
    if event == "claim":
        return ("running", attempts + 1) if status == "queued" else (status, attempts)
    if event in ("heartbeat", "complete"):
        return (AFTER[event], attempts) if status == "running" else (status, attempts)
    if event in ("fail", "stale"):
        if status != "running":
            return status, attempts
        return ("queued" if attempts <= retries else "failed"), attempts
    return status, attempts


def job_states(events: DataFrame, stale: str = "10 minutes", late: str = "1 minute", retries: int = 2) -> DataFrame:
    """(job, status, attempts, at_ms) after each micro-batch that changes a job.

    events: a stream of job, event (enqueue, claim, heartbeat, complete, fail) and ts. A running job of which nothing is heard for `stale`
    of event time is taken back into the queue, or given up after as many retries. Events of a job are applied in the order of ts within a micro-batch;
    those that are later than `late` are dropped by the watermark.
    """
    stale_ms = int(pd.Timedelta(stale).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        status, attempts, seen = state.get if state.exists else (None, 0, 0)
        before = status, attempts
        if state.hasTimedOut:
            status, attempts = next_status(status, attempts, "stale", retries)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event"], kind="stable")
            for event, ts in zip(rows["event"], rows["ts"]):
                at = int(ts.timestamp() * 1000)
                if status == "running" and at - seen > stale_ms:
                    status, attempts = next_status(status, attempts, "stale", retries)
                status, attempts = next_status(status, attempts, event, retries)
                seen = max(seen, at)
        state.update((status, attempts, seen))
        if status == "running":
            state.setTimeoutTimestamp(max(seen + stale_ms, state.getCurrentWatermarkMs() + 1))
        if (status, attempts) != before and status is not None:
            yield pd.DataFrame({"job": [key[0]], "status": [status], "attempts": [attempts], "at_ms": [seen]})

    told = events.filter("job is not null and event is not null and ts is not null").withWatermark("ts", late)
    return told.groupBy("job").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
