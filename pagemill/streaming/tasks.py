"""Task life cycle over a stream of status events."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.operators.tasks import TERMINAL
from pagemill.params import Params
from pagemill.sources.streams import timed_rows

FIELDS = ["status", "created_us", "started_us", "completed_us", "result", "error"]
SCHEMA = "status string, created_us bigint, started_us bigint, completed_us bigint, result string, error string"
_NONE = (None,) * (1 + len(FIELDS))
#: Events that are handed to the state at once.
CHUNK = 1000
EVENT = ["ts_us", "event_id", "status", "result", "error"]


def _after(state: dict | None, event: tuple) -> dict | None:
    """The state of a task after one event; updates of unknown tasks are ignored."""
    at, _, status, result, error = event
    if state is None:
        if status != "pending":
            return None
        state = {**dict.fromkeys(FIELDS), "created_us": at}
    started, ended = status == "processing" and state["started_us"] is None, status in TERMINAL
    return {
        "status": status, "created_us": state["created_us"],
        "started_us": at if started else state["started_us"], "completed_us": at if ended else state["completed_us"],
        "result": state["result"] if result is None else result, "error": state["error"] if error is None else error,
    }


class TaskLife(StatefulProcessor):
    """One state per created task. Events wait until the watermark has passed them and are then applied by (time, event), so
    the order in which they arrive changes nothing. Emits the state after each change. A finished task of which nothing
    waits is forgotten once the watermark is ``retention_s`` past its end.
    """

    def __init__(self, retention_s: int) -> None:
        self.retention_us = retention_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the timer that is set, then the state; each access goes to the JVM and back, so one value holds both
        self.task = handle.getValueState("task", f"due_ms long, {SCHEMA}")
        self.waiting = handle.getListState("waiting", "ts_us long, event_id long, status string, result string, error string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        set_to, *state = self.task.get() or _NONE
        due = set_to
        for chunk in batched((tuple(row[c] for c in EVENT) for row in rows), CHUNK):
            self.waiting.appendList(list(chunk))
            first = -(-min(e[0] for e in chunk) // 1000)
            due = first if due is None else min(due, first)
        if due != set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(due)
            self.task.update((due, *state))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        events = sorted(self.waiting.get(), key=lambda e: e[:2])
        ready = [e for e in events if e[0] <= watermark * 1000]
        rest = events[len(ready):]
        _, *held = self.task.get() or _NONE
        state = dict(zip(FIELDS, held)) if held[0] is not None else None
        for event in ready:
            state = _after(state, tuple(event))
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
            if state is not None:
                yield Row(task_id=key[0], **state)
        due = None
        if rest:
            due = -(-rest[0][0] // 1000)
        elif state is not None and state["status"] in TERMINAL:
            due = -(-(state["completed_us"] + self.retention_us) // 1000)
            if watermark >= due:
                state, due = None, None
        if due is not None:
            self.handle.registerTimer(due)
        if due is None and state is None:
            self.task.clear()
        else:
            self.task.update((due, *(state[f] for f in FIELDS)) if state else (due, *_NONE[1:]))

    def close(self) -> None:
        pass


def task_states(events: DataFrame, p: Params = Params(), delay: str = "10 minutes") -> DataFrame:
    """States of tasks from a stream of (task_id, event_id, status, result, error, ts, ts_us)."""
    known = timed_rows(events.select("task_id", *EVENT, "ts"), ["task_id"], delay)
    return known.groupBy("task_id").transformWithState(
        statefulProcessor=TaskLife(p.task_retention_s), outputStructType=f"task_id bigint, {SCHEMA}", outputMode="Update", timeMode="EventTime")
