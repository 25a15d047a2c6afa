"""Event-time windows that hand late rows on instead of losing them.

Spark's own window aggregates drop what comes behind the watermark.  Here a
session's open windows are state, an event-time timer closes them, and rows that
no open window takes leave with ``late`` set, in the same pass.  So every row
that comes in is counted in at least one window or goes out as a late row.  A row
without a session or a time is a late row too.  Closed windows equal those of
``windows.sliding`` and ``windows.sessions``.

Sessions are dealt over shards by hash.  The open windows of a shard's sessions
are one table in its state and share one timer, so a batch reads and writes that
table once a shard, and not an entry and a timer a window.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .sessions import END, PROVIDER

# Ship the processors inside the closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INPUT = ["session", "t", "score", "kind"]
OUTPUT = (
    "session string, t long, score double, window_start long, window_end long, "
    "chunks long, max_score double, candidates long, late boolean"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
HELD = {"session": pa.string(), "start": pa.int64(), "last": pa.int64(), "chunks": pa.int64(), "top": pa.float64(), "candidates": pa.int64()}
JOINED = {"last": ("last", "max"), "chunks": ("chunks", "sum"), "top": ("top", "max"), "candidates": ("candidates", "sum")}
# Fixed for the life of a checkpoint: a state belongs to its shard.
SHARDS = 1024


class _Windows(StatefulProcessor):
    """Open windows of one shard's sessions; times are in microseconds."""

    def __init__(self, theta: float) -> None:
        self.theta = theta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "windows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        # A window over at this watermark but not yet given out takes no more rows.
        held, over = self._load(passed)
        if len(over):
            yield self._closed(over)
        for batch in rows:
            batch = batch[(batch["kind"] != END).fillna(True)]
            if not len(batch):
                continue
            timed = (batch["t"].notna() & batch["session"].notna()).to_numpy()
            t = batch["t"].fillna(0).astype("int64").to_numpy()
            closed = (self._ends_last(t) // 1000 <= passed) & (passed > 0)
            late = batch[~timed | closed]
            if len(late):
                out = pd.DataFrame({c: None for c in COLUMNS}, index=late.index)
                out["t"], out["score"] = late["t"].astype("Int64"), late["score"]
                out["session"], out["late"] = late["session"], True
                yield out
            live = timed & ~closed
            scores = batch["score"].to_numpy(dtype=float, na_value=np.nan)[live]
            ones = {"session": batch["session"].to_numpy()[live], "last": t[live], "chunks": 1, "top": scores, "candidates": (scores >= self.theta).astype("int64")}
            held = self._taken(held, pd.DataFrame(ones), passed)
        self._store(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, over = self._load(timerValues.getCurrentWatermarkInMs())
        if len(over):
            yield self._closed(over)
        self._store(held)

    def _load(self, passed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The shard's windows, those still open and those over at the watermark."""
        value = self.open.get()
        if value is None:
            empty = pa.schema(list(HELD.items())).empty_table().to_pandas()
            return empty, empty
        windows = pa.ipc.open_stream(bytes(value[0])).read_pandas()
        over = (self._ends(windows) // 1000 <= passed).to_numpy() & (passed > 0)
        return windows[~over], windows[over]

    def _store(self, held: pd.DataFrame) -> None:
        if not len(held):
            self.open.clear()
            return
        table = pa.Table.from_pandas(held, schema=pa.schema(list(HELD.items())), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.open.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(self._ends(held).min()) // 1000)

    def _closed(self, over: pd.DataFrame) -> pd.DataFrame:
        over = over.sort_values(["session", "start"])
        out = pd.DataFrame({c: None for c in COLUMNS}, index=over.index)
        out["session"], out["window_start"], out["window_end"] = over["session"], over["start"], self._ends(over)
        out["chunks"], out["max_score"], out["candidates"], out["late"] = over["chunks"], over["top"], over["candidates"], False
        return out

    def close(self) -> None:
        pass


class Sliding(_Windows):
    """Windows of ``size`` that start at every multiple of ``slide``."""

    def __init__(self, theta: float, size: int, slide: int) -> None:
        super().__init__(theta)
        self.size, self.slide = size, slide

    def _ends_last(self, t: np.ndarray) -> np.ndarray:
        return t // self.slide * self.slide + self.size

    def _ends(self, windows: pd.DataFrame) -> pd.Series:
        return windows["start"] + self.size

    def _taken(self, held: pd.DataFrame, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        parts = [held]
        for back in range(0, self.size, self.slide):
            part = rows.assign(start=rows["last"] // self.slide * self.slide - back)
            ends = part["start"] + self.size
            parts.append(part[(part["last"] < ends) & ((ends // 1000 > passed) | (passed <= 0))])
        every = pd.concat([p for p in parts if len(p)] or [held])
        return every.groupby(["session", "start"], sort=False, as_index=False).agg(**JOINED)


class Gaps(_Windows):
    """Runs of rows closer than ``gap``; a late joiner may unite two open runs."""

    def __init__(self, theta: float, gap: int) -> None:
        super().__init__(theta)
        self.gap = gap

    def _ends_last(self, t: np.ndarray) -> np.ndarray:
        return t + self.gap

    def _ends(self, windows: pd.DataFrame) -> pd.Series:
        return windows["last"] + self.gap

    def _taken(self, held: pd.DataFrame, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        every = pd.concat([p for p in (held, rows.assign(start=rows["last"])) if len(p)] or [held])
        every = every.sort_values(["session", "start"], ignore_index=True)
        reach = every.groupby("session", sort=False)["last"].cummax().shift() + self.gap
        fresh = (every["session"] != every["session"].shift()) | (every["start"] >= reach)
        runs = every.groupby(fresh.cumsum().to_numpy(), sort=False)
        return runs.agg(session=("session", "first"), start=("start", "first"), **JOINED)


def _windowed(rows: DataFrame, processor: _Windows, delay: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = rows.select(*INPUT, F.timestamp_micros("t").alias("_at")).withWatermark("_at", delay)
    # Without the time column the engine filters nothing: late rows reach the processor.
    dealt = timed.select(F.pmod(F.hash("session"), F.lit(SHARDS)).alias("_shard"), *INPUT)
    return dealt.groupBy("_shard").transformWithStateInPandas(processor, OUTPUT, "Append", "EventTime")


def sliding(rows: DataFrame, *, size: int, slide: int, theta: float, delay: str) -> DataFrame:
    """Closed sliding windows and late rows of a stream; times are in microseconds.

    Reads session, t, score and kind; a row of kind ``end`` only moves the
    watermark.  With ``slide == size`` the windows are tumbling.
    """
    return _windowed(rows, Sliding(theta, size, slide), delay)


def sessions(rows: DataFrame, *, gap: int, theta: float, delay: str) -> DataFrame:
    """Closed session windows and late rows of a stream, as ``sliding``."""
    return _windowed(rows, Gaps(theta, gap), delay)
