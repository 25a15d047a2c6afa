"""Streaming windows whose late rows leave in a table of their own."""

from __future__ import annotations

import random

import pandas as pd

from wakelens.session import shared_folder
from wakelens.streaming import intake, late

SCHEMA = "session string, t long, score double, kind string"
SECOND = 1_000_000
END = ("", 10**9 * SECOND, None, "end")


def run(spark, files, windowed):
    path, base = shared_folder(spark), shared_folder(spark)
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)
        out = intake.drain(windowed(intake.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema)), base=base)
    rows = out.collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    return sorted(((r.session, r.window_start, r.window_end, r.chunks, r.max_score, r.candidates) for r in rows if not r.late), key=key), sorted(((r.session, r.t, r.score) for r in rows if r.late), key=key)


def some(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), (1000 + k + rng.randint(-60, 4)) * SECOND, rng.choice([None, 0.1, 0.5, 0.9]), "chunk") for k in range(150)]
    return [rows[:50], rows[50:90], rows[90:] + rows[90:93], [END]]


def by_hand_sliding(files, size, slide, delay):
    mark, windows, gone = None, {}, []
    for rows in files:
        for s, t, score, kind in rows:
            if kind == "end":
                continue
            starts = [t // slide * slide - k * slide for k in range(size // slide)]
            live = [w for w in starts if mark is None or w + size > mark]
            if not live:
                gone.append((s, t, score))
            for w in live:
                windows.setdefault((s, w), []).append(score)
        mark = max([mark or 0] + [r[1] - delay for r in rows])
    return windows, gone


def test_sliding_windows_and_late_rows(spark):
    files = some(3)
    got, gone = run(spark, files, lambda s: late.sliding(s, size=20 * SECOND, slide=10 * SECOND, theta=0.5, delay="5 seconds"))
    want, lost = by_hand_sliding(files, 20 * SECOND, 10 * SECOND, 5 * SECOND)
    assert len(gone) > 3 and len(gone) == len(lost) and {g[:2] for g in gone} == {x[:2] for x in lost}
    assert {(s, a): (n, top, hits) for s, a, _, n, top, hits in got} == {
        k: (len(v), max([x for x in v if x is not None], default=None), sum(x is not None and x >= 0.5 for x in v)) for k, v in want.items()
    }


def test_tumbling_windows_count_every_row_once(spark):
    files = some(4)
    got, gone = run(spark, files, lambda s: late.sliding(s, size=10 * SECOND, slide=10 * SECOND, theta=0.5, delay="5 seconds"))
    assert gone and sum(w[3] for w in got) + len(gone) == sum(map(len, files)) - 1


def test_session_windows_unite_and_count_every_row_once(spark):
    gap = lambda s: late.sessions(s, gap=10 * SECOND, theta=0.5, delay="30 seconds")
    one = [("a", k * SECOND, 0.5, "chunk") for k in (100, 115)]
    joined, gone = run(spark, [one, [("a", 107 * SECOND, 0.9, "chunk")], [END]], gap)
    assert joined == [("a", 100 * SECOND, 125 * SECOND, 3, 0.9, 3)] and not gone
    files = some(5)
    got, gone = run(spark, files, gap)
    assert gone and sum(w[3] for w in got) + len(gone) == sum(map(len, files)) - 1
    for (s, _, end, *_), (z, start, *_) in zip(got, got[1:]):
        assert s != z or end <= start


def test_rows_without_time_or_session_are_late(spark):
    rows = [("a", None, 0.5, "chunk"), (None, 5 * SECOND, 0.5, "chunk"), ("a", 5 * SECOND, None, None)]
    got, gone = run(spark, [rows, [END]], lambda s: late.sliding(s, size=10 * SECOND, slide=10 * SECOND, theta=0.5, delay="5 seconds"))
    assert got == [("a", 0, 10 * SECOND, 1, None, 0)]
    assert gone == [(None, 5 * SECOND, 0.5), ("a", None, 0.5)]
    assert run(spark, [[END]], lambda s: late.sessions(s, gap=SECOND, theta=0.5, delay="5 seconds")) == ([], [])


class Held:
    """A shard's state and timers, which counts how often each is used."""

    def __init__(self):
        self.value, self.timers, self.writes = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_a_batch_of_many_sessions_writes_one_state_and_one_timer():
    rows = pd.DataFrame([(f"s{s}", k * 60 * SECOND, 0.5, "chunk") for s in range(200) for k in range(10)], columns=late.INPUT)
    for processor in (late.Sliding(0.5, 20 * SECOND, 10 * SECOND), late.Gaps(0.5, 20 * SECOND)):
        held = Held()
        held.mark = 0
        processor.init(held)
        assert list(processor.handleInputRows((7,), iter([rows[:700], rows[700:]]), held)) == []
        assert held.writes == 1 and held.timers == [held.timers[0]]
        held.mark = 10**9
        closed = pd.concat(processor.handleExpiredTimer((7,), held, None))
        assert len(closed) == 2000 * (2 if isinstance(processor, late.Sliding) else 1) and set(closed["chunks"]) == {1}
        assert held.value is None
