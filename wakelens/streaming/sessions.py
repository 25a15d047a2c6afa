"""Assistant sessions as event-time state.

Events wait in a session's list state until the watermark passes them; an
event-time timer then decides them in time order.  So the result is that of the
table form, however the input is cut into micro-batches and in whatever order
rows come within the delay.  A row behind the watermark is not decided but leaves
with ``late`` set, so every row that comes in goes out once.  A session without
events for ``idle`` is over: its state goes, and a later event starts a new one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Ship the processor inside the closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END = "end"
PENDING = "event_id long, t long, kind string, text string, candidate boolean, trigger boolean"
STATE = "last long, said string, chunks long, active boolean, name string, seen long"
OUTPUT = (
    "session string, event_id long, t long, kind string, trigger_accepted boolean, cooldown_active boolean, "
    "assistant_state string, rolling_transcript string, chunks long, active boolean, late boolean"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def _append(existing: str, new: str, keep: int) -> str:
    both = " ".join(p for p in (existing.strip(), new.strip()) if p)
    return both if len(both) <= keep else both[-keep:].lstrip()


class Sessions(StatefulProcessor):
    """One session's waiting events, its record, and the time of its only timer."""

    def __init__(self, cooldown: int, keep: int, names: dict[str, str], idle: int | None) -> None:
        self.cooldown, self.keep, self.names, self.idle = cooldown, keep, names, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.record = handle.getValueState("record", STATE)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        for batch in rows:
            batch = batch[batch["kind"] != END]
            behind = (batch["t"] // 1000 <= passed) & (passed > 0)
            late = batch[behind]
            if len(late):
                out = pd.DataFrame({c: None for c in COLUMNS}, index=late.index)
                out[["event_id", "t", "kind"]] = late[["event_id", "t", "kind"]]
                out["session"], out["late"] = key[0], True
                yield out
            waiting = batch[~behind]
            if len(waiting):
                fields = ["event_id", "t", "kind", "text", "candidate", "trigger"]
                self.pending.appendList([_plain(r) for r in waiting[fields].itertuples(index=False)])
                least = int(waiting["t"].min()) // 1000
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first, sooner=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.pending.get(), key=lambda r: (r[1], r[0])) if self.pending.exists() else []
        ready = [r for r in rows if r[1] // 1000 <= passed]
        rest = [r for r in rows if r[1] // 1000 > passed]
        self.timer.clear()
        if ready:
            out, record = self._decide(key[0], ready)
            self.record.update(record)
            if rest:
                self.pending.put([_plain(r) for r in rest])
            else:
                self.pending.clear()
            yield pd.DataFrame(out, columns=COLUMNS)
        over = self.record.get()[5] // 1000 + self.idle // 1000 + 1 if self.idle is not None and self.record.exists() else None
        if over is not None and over <= passed:
            self.record.clear()
            over = None
        wake = [r[1] // 1000 for r in rest] + ([over] if over is not None else [])
        if wake:
            self._wake(min(wake), sooner=False)

    def _wake(self, at: int, sooner: bool) -> None:
        held = self.timer.get()[0] if sooner and self.timer.exists() else None
        if held is not None and held <= at:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _decide(self, session: str, rows: list) -> tuple[list[tuple], tuple]:
        fresh = (None, "", 0, True, self.names["idle"], None)
        last, said, chunks, active, name, seen = self.record.get() if self.record.exists() else fresh
        out = []
        for event_id, t, kind, text, candidate, trigger in rows:
            if self.idle is not None and seen is not None and t - seen > self.idle:
                last, said, chunks, active, name, _ = fresh
            accepted = waiting = False
            if kind == "chunk":
                chunks += 1
                said = _append(said, text or "", self.keep)
                waiting = last is not None and t - last < self.cooldown
                accepted = bool(trigger) and not waiting
                if accepted:
                    last, name = t, self.names["accepted"]
                else:
                    name = self.names["candidate"] if candidate and not waiting else self.names["listening"]
            elif kind == "start":
                active, name = True, self.names["listening"]
            elif kind == "stop":
                active, name = False, self.names["idle"]
            elif kind == "reset":
                last, said, name = None, "", self.names["idle"]
            seen = t
            out.append((session, event_id, t, kind, accepted, waiting, name, said, chunks, active, False))
        return out, (last, said, chunks, active, name, seen)

    def close(self) -> None:
        pass


def _plain(row) -> tuple:
    event_id, t, kind, text, candidate, trigger = row
    return int(event_id), int(t), str(kind), None if text is None or text != text else str(text), bool(candidate), bool(trigger)


def assistant_stream(events: DataFrame, *, cooldown: int, keyword: str, keep: int, names: dict[str, str], delay: str, idle: int | None) -> DataFrame:
    """Decided events of a stream, and late ones; times are in microseconds.

    Reads session, event_id, t, kind, text, candidate and trigger.  A row of kind
    ``end`` only moves the watermark.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    cols = ["session", "event_id", "t", "kind", "text", "candidate", "trigger"]
    timed = events.select(*cols, F.timestamp_micros("t").alias("_at")).withWatermark("_at", delay)
    # Without the time column the engine filters nothing: late rows reach the processor.
    return timed.select(*cols).groupBy("session").transformWithStateInPandas(Sessions(cooldown, keep, names, idle), OUTPUT, "Append", "EventTime")
