"""Queue events as keyed state: duplicates of what is queued already, and jobs that run too long.

The store must be RocksDB (`spark.sql.streaming.stateStore.providerClass`; `session.local_session` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Waiting(StatefulProcessor):
    """State of a kind and payload: the id that is queued for it and not yet begun."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queued = handle.getValueState("queued", "id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("id", kind="stable")
        events = events[events["status"].isin(["queued", "running"])]
        asks = events["status"] == "queued"
        ended = (~asks).cumsum()  # whatever was queued before is taken out by the next job that begins
        first = asks & ~asks.groupby(ended).cumsum().gt(1)
        if self.queued.exists():
            first &= ended > 0
        last = events[first & (ended == ended.iloc[-1])] if len(events) else events
        if len(last):
            self.queued.update((int(last["id"].iloc[0]),))
        elif len(events) and ended.iloc[-1] > 0:
            self.queued.clear()
        kept = events[asks]
        yield pd.DataFrame({"kind": key[0], "payload": key[1], "id": kept["id"], "kept": first[asks]})

    def close(self) -> None:
        pass


def queued_once(events: DataFrame) -> DataFrame:
    """(kind, payload, id, kept) for every queueing in a stream of (id, kind, payload, status): kept unless the same work is queued and not yet begun.

    State is the id that is queued for a kind and payload: `running` takes it out, so that the next queueing counts again. Keys with nothing queued keep no state.
    """
    return events.groupBy("kind", "payload").transformWithStateInPandas(Waiting(), "kind string, payload long, id long, kept boolean", "append", "None")


class Running(StatefulProcessor):
    """State of a job: when it began, with a timer at the end of its time."""

    def __init__(self, timeout_s: int) -> None:
        self.timeout_ms = 1000 * timeout_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.began = handle, handle.getValueState("began", "ms long")

    def _forget(self) -> None:
        if self.began.exists():
            self.handle.deleteTimer(self.began.get()[0] + self.timeout_ms)
            self.began.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("ts", kind="stable").iloc[-1]
        self._forget()
        if last.status == "running":
            began = int(last.ts.timestamp() * 1000)
            self.began.update((began,))
            self.handle.registerTimer(began + self.timeout_ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (began,) = self.began.get()
        self.began.clear()
        yield pd.DataFrame({"id": [key[0]], "began": [pd.Timestamp(began, unit="ms")]})

    def close(self) -> None:
        pass


def stale_running(events: DataFrame, timeout_s: int, late: str = "1 hour") -> DataFrame:
    """(id, began) of jobs in a stream of (id, status, ts) that ran longer than the timeout by event time without an end.

    A timer at the end of a job's time fires once the watermark passes it, and an end that comes before takes both away.
    """
    marked = events.withWatermark("ts", late)
    return marked.groupBy("id").transformWithStateInPandas(Running(timeout_s), "id long, began timestamp", "append", "EventTime")
