"""Decisions on matches as keyed state: a role's ranked list is kept by Spark's state store, and a batch reads its new events only.

The store must be RocksDB (`spark.sql.streaming.stateStore.providerClass`; `session.local_session` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolemesh.operators import review

COLUMNS = ["status", "released", "active", "score", "run_rank"]
SCHEMA = "role_id long, match_id long, status string, released boolean, event_id long, result string"


class RankedList(StatefulProcessor):
    """State of a role: its matches by id, and the ids of events that were decided. Only matches that a batch changes are written."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.matches = handle.getMapState("matches", "match_id long", "status string, released boolean, active boolean, score double, run_rank int")
        self.decided = handle.getMapState("decided", "event_id long", "result string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            rank = None if pd.isna(r.run_rank) else int(r.run_rank)
            self.matches.updateValue((int(r.match_id),), (r.status, bool(r.released), bool(r.active), float(r.score), rank))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).drop_duplicates("event_id")
        before = {m[0]: tuple(v) for m, v in self.matches.iterator()}
        new = [e in before and not self.decided.containsKey((int(i),)) for e, i in zip(events["match_id"], events["event_id"], strict=True)]
        events = events[new]
        if not len(events):
            return
        ends, log = review.fold(pd.DataFrame([(m, *v) for m, v in before.items()], columns=["match_id", *COLUMNS]), events)
        out = []
        for m, status, released in ends.itertuples(index=False):
            if (status, released) != before[m][:2]:
                self.matches.updateValue((int(m),), (status, bool(released), *before[m][2:]))
                out.append((*key, m, status, released, None, None))
        for event, said in log.itertuples(index=False):
            self.decided.updateValue((int(event),), (said,))
            out.append((*key, None, None, None, event, said))
        found = pd.DataFrame(out, columns=["role_id", "match_id", "status", "released", "event_id", "result"])
        yield found.astype({"match_id": "Int64", "event_id": "Int64", "released": "boolean"})

    def close(self) -> None:
        pass


def decided(events: DataFrame, matches: DataFrame) -> DataFrame:
    """(role_id, match_id, status, released, event_id, result) for a stream of events (event_id, match_id, ts, action): after each batch a row for every match
    that it changed (event_id null), and one for every event with what came of it. matches are the lists to begin with (see `review.decisions`).

    Events of a batch are taken in order of time. One that comes in a later batch than its time is decided on the state it meets; one that comes again, in
    the same batch or later, changes nothing and gives no row; one of an unknown match gives none either.
    """
    begin = matches.select("role_id", "match_id", *COLUMNS)
    asked = events.join(matches.select("match_id", "role_id"), "match_id")
    return asked.select("role_id", "match_id", "event_id", "ts", "action").groupBy("role_id").transformWithStateInPandas(RankedList(), SCHEMA, "append", "None", initialState=begin.groupBy("role_id"))
