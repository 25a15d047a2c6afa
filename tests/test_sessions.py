"""Event-time session state: order, micro-batches, late rows and expiry."""

from __future__ import annotations

import os
import random

import pytest

from wakelens.session import shared_folder
from wakelens.streaming import intake, triggers

SCHEMA = "session string, event_id long, t long, kind string, text string, candidate boolean, trigger boolean"
SECOND = 1_000_000
END = ("", -1, 10**9 * SECOND, "end", None, False, False)


def stream_of(spark, files):
    """A stream that takes one file a micro-batch, in order."""
    path = shared_folder(spark)
    os.makedirs(path)
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{k}")
        (name,) = [f for f in os.listdir(f"{path}/{k}") if f.endswith(".parquet")]
        os.replace(f"{path}/{k}/{name}", f"{path}/file-{k}.parquet")
        os.utime(f"{path}/file-{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = spark.createDataFrame([], SCHEMA).schema
    return intake.file_stream(spark, path, schema, maxFilesPerTrigger=1, pathGlobFilter="file-*.parquet")


def decided(spark, files, **options):
    out = intake.drain(triggers.assistant_stream(stream_of(spark, files), cooldown=5 * SECOND, keyword="word", **options))
    return [tuple(r) for r in out.orderBy("late", "session", "t", "event_id").collect()]


@pytest.fixture(scope="module")
def events():
    rng = random.Random(7)
    rows = []
    for k in range(160):
        trigger = rng.random() < 0.4
        kind = rng.choice(["chunk"] * 8 + ["start", "reset"])
        rows.append((rng.choice(["hot", "hot", "a", "b"]), k, (1000 + k // 2 + rng.randint(0, 4)) * SECOND, kind, rng.choice(["one", " two ", None]), trigger or rng.random() < 0.3, trigger))
    return sorted(rows, key=lambda r: r[1])


def test_result_does_not_depend_on_micro_batches(spark, events):
    whole = decided(spark, [[*events, END]], delay="10 seconds")
    cut = decided(spark, [events[:30], events[30:75], events[75:120], events[120:], [END]], delay="10 seconds")
    assert len(whole) == len(events) and cut == whole


def test_stream_equals_its_table_form(spark, events):
    chunks = [r for r in events if r[3] == "chunk"]
    live = decided(spark, [chunks[:40], chunks[40:90], chunks[90:], [END]], delay="10 seconds")
    table = triggers.trigger_states(
        spark.createDataFrame(chunks, SCHEMA), session="session", t="t", tie="event_id", trigger="trigger", candidate="candidate", cooldown=5 * SECOND, chunk=20 * SECOND, keyword="word"
    )
    want = table.select("session", "event_id", "trigger_accepted", "cooldown_active", "assistant_state").collect()
    assert sorted((r[0], r[1], *r[4:7]) for r in live) == sorted(map(tuple, want))


def test_late_rows_leave_apart(spark, events):
    late = ("a", 999, 990 * SECOND, "chunk", "late", True, True)
    got = decided(spark, [events[:80], events[80:], [late], [END]], delay="10 seconds")
    assert [r[:4] + r[-1:] for r in got if r[-1]] == [("a", 999, 990 * SECOND, "chunk", True)]
    assert [r for r in got if not r[-1]] == decided(spark, [[*events, END]], delay="10 seconds")


def test_idle_sessions_expire(spark):
    """State goes with the session, and what comes later starts anew, in one batch or in many."""
    first = [(f"s{k}", k, (100 + k) * SECOND, "chunk", "old", True, True) for k in range(20)]
    later = [("s3", 50, 1000 * SECOND, "chunk", "new", False, False), ("t", 51, 1200 * SECOND, "chunk", "x", False, False)]
    stream = triggers.assistant_stream(stream_of(spark, [first, later[:1], later[1:], [END]]), cooldown=5 * SECOND, keyword="word", delay="1 second", idle=60 * SECOND)
    base = shared_folder(spark)
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) > 20 and held[-1] == 0
    got = {r.event_id: (r.rolling_transcript, r.chunks) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got[3] == ("old", 1) and got[50] == ("new", 1) and len(got) == 22
    one = decided(spark, [[*first, *later, END]], delay="1 second", idle=60 * SECOND)
    assert {r[1]: r[7:9] for r in one} == got
