"""The life of sessions as a stateful stream: begun by work, completed by a stop, closed by silence.

Each session keeps a few values in the state store; its events are taken as an iterator, in any order,
for what counts are the first and the last times.  An event-time timer closes a session that has
been silent for too long without a stop."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: times in microseconds
OUTPUT = "session_id string, version bigint, project string, status string, started_at bigint, last_at bigint, ended_at bigint, ended_by string"
_STATE = "version bigint, project string, project_at bigint, started bigint, last bigint, stopped bigint, closed bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEGINS = ("prompt-submit", "post-tool-use")


def state_store(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB, on disk and in snapshots, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class SessionLife(StatefulProcessor):
    """Tells of a session whenever something changed: its version, status and times."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else (0, None, None, None, None, None, None)
        version, project, project_at, started, last, stopped, closed = old
        for row in rows:
            at = row["at"]
            if row["event"] in BEGINS:
                started = at if started is None else min(started, at)
                last = at if last is None else max(last, at)
                if row["project"] is not None and (project_at is None or (at, row["project"]) > (project_at, project or "")):
                    project, project_at = row["project"], at
            elif row["event"] == "stop":
                stopped = at if stopped is None else max(stopped, at)
        if (project, project_at, started, last, stopped, closed) == tuple(old[1:]):
            return
        if closed is not None and last is not None and last >= closed:
            closed = None  # work went on after the silence
        self.state.update((version + 1, project, project_at, started, last, stopped, closed))
        if started is None:
            return  # a stop of a session that nobody began
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not self._stopped(started, stopped):
            self.handle.registerTimer(last // 1000 + self.silence_ms)
        yield self._told(key, self.state.get())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        version, project, project_at, started, last, stopped, closed = self.state.get()
        if self._stopped(started, stopped) or closed is not None:
            return
        self.state.update((version + 1, project, project_at, started, last, stopped, last + self.silence_ms * 1000))
        yield self._told(key, self.state.get())

    def close(self) -> None:
        pass

    @staticmethod
    def _stopped(started: int, stopped: int | None) -> bool:
        return stopped is not None and stopped >= started

    def _told(self, key: tuple, state: tuple) -> Row:
        version, project, _, started, last, stopped, closed = state
        over = self._stopped(started, stopped)
        by = "stop" if over else "silence" if closed is not None else None
        return Row(session_id=key[0], version=version, project=project, status="completed" if by else "active", started_at=started, last_at=last, ended_at=stopped if over else closed, ended_by=by)


def session_lives(events: DataFrame, silence: timedelta = timedelta(hours=2), late: str = "10 minutes") -> DataFrame:
    """A stream of (session_id, event, received_at, project) to one of what became of sessions.

    A session is active from its first prompt or tool event, completed at its latest stop, if that comes
    no earlier, and otherwise completed once the watermark is ``silence`` past its last work.  Of the
    rows of a session the highest version counts.  Needs the state store that ``state_store`` sets."""
    rows = events.filter("session_id is not null").select("session_id", "event", "received_at", "project", F.unix_micros("received_at").alias("at")).withWatermark("received_at", late)
    told = rows.groupBy("session_id").transformWithState(SessionLife(int(silence.total_seconds() * 1000)), OUTPUT, "Append", "EventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "last_at", "ended_at")})
