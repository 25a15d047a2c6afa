"""Trigger cool-down, rolling transcripts and session accounting."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import map_sorted_groups, running
from ..session import cut
from . import sessions

# Ship the task functions inside the closure, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEEP_CHARS = 1600


def states(keyword: str) -> dict[str, str]:
    """Names of the assistant states; the candidate state names the keyword."""
    return {"idle": "IDLE", "listening": "LISTENING", "candidate": f"{keyword.upper()}_CANDIDATE", "accepted": "ASSISTANT_STATE"}


# --- batch: cool-down ------------------------------------------------------------


def _orbit(times: np.ndarray, cooldown: int) -> np.ndarray:
    """For each trigger: the last one accepted if this one is accepted."""
    following = np.searchsorted(times, times + cooldown, side="left")
    last = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            last[i] = last[following[i]]
    return last


def _chunk_map(cooldown: int):
    """Task function: how one chunk turns an entry time into an exit time.

    One row per range of entry times that lead to the same last trigger.  Only
    entries within one cool-down of the chunk start can occur.
    """

    def task(cols: dict) -> dict:
        times = cols["t"]
        last = times[_orbit(times, cooldown)]
        entries = min(len(times), int(np.searchsorted(times, cols["chunk_start"][0] + cooldown, side="left")) + 1)
        keep = np.append(last[: entries - 1] != last[1:entries], True)
        n = int(keep.sum())
        return {
            "session": cols["session"][:n],
            "chunk": cols["chunk"][:n],
            "until": times[:entries][keep],
            "last": last[:entries][keep],
        }

    return task


def _walk(cooldown: int):
    """Task function: carry the earliest next accept through the chunk maps."""

    def task(cols: dict) -> dict:
        chunks, firsts = np.unique(cols["chunk"], return_index=True)
        ends = np.append(firsts[1:], len(cols["chunk"]))
        ready, entry = np.iinfo(np.int64).min, np.empty(len(chunks), dtype=np.int64)
        for i, (lo, hi) in enumerate(zip(firsts, ends)):
            entry[i] = ready
            at = lo + int(np.searchsorted(cols["until"][lo:hi], ready, side="left"))
            if at < hi:
                ready = int(cols["last"][at]) + cooldown
        return {"session": cols["session"][: len(chunks)], "chunk": chunks, "ready": entry}

    return task


def _accept(cooldown: int):
    """Task function: accepted triggers of one chunk for its entry time."""

    def task(cols: dict) -> dict:
        times, picked = cols["t"], []
        i = int(np.searchsorted(times, cols["ready"][0], side="left"))
        while i < len(times):
            picked.append(i)
            i = int(np.searchsorted(times, times[i] + cooldown, side="left"))
        return {c: cols[c][picked] for c in ("session", "t", "tie")}

    return task


def accepted_triggers(events: DataFrame, *, session: str, t: str, tie: str, trigger: Column, cooldown: int, chunk: int) -> DataFrame:
    """Triggers that are not within ``cooldown`` of the last accepted one.

    Times are integers.  Greedy acceptance looks sequential, but over a stretch
    of time it is a step function from "ready at" to "ready at".  So each
    (session, chunk) is summarised on its own, the short summaries are walked
    per session, and each chunk is then decided from its entry time.  A session
    with a third of all rows spreads over its chunks.
    """
    if chunk < 2 * cooldown:
        raise ValueError("a chunk must span at least two cool-downs")
    fired = events.where(trigger).select(
        F.col(session).alias("session"), F.col(t).alias("t"), F.col(tie).alias("tie"), F.floor(F.col(t) / chunk).alias("chunk")
    )
    kind = dict(fired.dtypes)
    based = fired.withColumn("chunk_start", F.col("chunk") * chunk)
    span = ["session", "chunk"]
    maps = map_sorted_groups(
        based.select(*span, "chunk_start", "t"), span, ["t"], _chunk_map(cooldown), f"session {kind['session']}, chunk long, until long, last long"
    )
    entries = map_sorted_groups(maps, ["session"], ["chunk", "until"], _walk(cooldown), f"session {kind['session']}, chunk long, ready long")
    placed = fired.join(entries, span)
    out = map_sorted_groups(placed, span, ["t", "tie"], _accept(cooldown), f"session {kind['session']}, t long, tie {kind['tie']}")
    return out.select(F.col("session").alias(session), F.col("t").alias(t), F.col("tie").alias(tie))


def trigger_states(
    events: DataFrame, *, session: str, t: str, tie: str, trigger: str, candidate: str, cooldown: int, chunk: int, keyword: str
) -> DataFrame:
    """Every event with its acceptance, cool-down flag and assistant state."""
    taken = accepted_triggers(events, session=session, t=t, tie=tie, trigger=F.col(trigger), cooldown=cooldown, chunk=chunk)
    marked = events.join(cut(taken).withColumn("_ok", F.lit(True)), [session, t, tie], "left")
    marked = marked.withColumn("trigger_accepted", F.col("_ok").isNotNull()).drop("_ok")
    order = [F.col(t).asc(), F.col(tie).asc()]
    before = running(
        marked,
        [session],
        order,
        F.floor(F.col(t) / chunk),
        {"_last": ("max", F.when(F.col("trigger_accepted"), F.col(t)))},
        inclusive=False,
    )
    waiting = F.coalesce(F.col(t) - F.col("_last") < cooldown, F.lit(False))
    names = states(keyword)
    state = (
        F.when(F.col("trigger_accepted"), names["accepted"])
        .when(waiting, names["listening"])
        .when(F.col(candidate), names["candidate"])
        .otherwise(names["listening"])
    )
    return before.withColumns({"cooldown_active": waiting, "assistant_state": state}).drop("_last")


# --- batch: rolling transcript ------------------------------------------------------


def rolling_transcript(turns: DataFrame, session: str, order: Sequence[str], text: str, *, bucket: Column, keep: int = KEEP_CHARS, span: int = 1 << 16) -> DataFrame:
    """Last ``keep`` characters of everything said so far.

    Positions are running lengths; a frame holds only turns that end within
    the last ``keep`` characters.  Long sessions are cut by position, and turns
    near a cut are repeated for the next piece.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    base = turns.withColumn("_clean", clean)
    length = F.when(F.col("_clean") == "", 0).otherwise(F.length("_clean") + 1).cast("long")
    placed = running(base, [session], [F.col(c).asc() for c in order], bucket, {"_end": ("sum", length)})
    placed = placed.withColumn("_tail", F.right("_clean", F.lit(keep)))
    own = F.floor(F.col("_end") / span)
    near = F.col("_end") % span >= span - keep - 1
    pieces = F.when(near, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.select("*", F.posexplode(pieces).alias("_copy", "_piece"))
    frame = Window.partitionBy(session, "_piece").orderBy("_end").rangeBetween(-(keep + 1), 0)
    said = F.collect_list(F.when(F.col("_tail") != "", F.col("_tail"))).over(frame)
    joined = F.regexp_replace(F.right(F.array_join(said, " "), F.lit(keep)), r"(?U)^\s+", "")
    out = spread.withColumn("rolling_transcript", joined).where(F.col("_copy") == 0)
    return out.drop("_clean", "_end", "_tail", "_copy", "_piece")


# --- stream ----------------------------------------------------------------------


def assistant_stream(events: DataFrame, *, cooldown: int, keyword: str, keep: int = KEEP_CHARS, delay: str = "0 seconds", idle: int | None = None) -> DataFrame:
    """Session stream in event time; see ``streaming.sessions``.

    Reads session, event_id, t (microseconds), kind, text, candidate and trigger;
    one row out per row in.  ``delay`` is how far rows may be out of order, ``idle``
    (microseconds) after how long without events a session ends.
    """
    return sessions.assistant_stream(events, cooldown=cooldown, keyword=keyword, keep=keep, names=states(keyword), delay=delay, idle=idle)


def chunk_decisions(chunks: DataFrame, calibration: DataFrame, theta2: float, *, default_similarity: float = 0.6) -> DataFrame:
    """Cascade with calibration bias, or prototype similarity, for candidates.

    Stateless, so it serves streams (stream-static join) and tables alike.
    ``calibration`` has session, bias, prototype_threshold.
    """
    from ..operators.fewshot import biased_score

    joined = chunks.join(calibration, "session", "left")
    score = biased_score(F.col("stage2_score"), F.coalesce("bias", F.lit(0.0)))
    limit = F.coalesce("prototype_threshold", F.lit(default_similarity))
    base = F.col("candidate") & F.coalesce(score >= theta2, F.lit(False))
    alike = F.col("candidate") & F.coalesce(F.col("similarity") >= limit, F.lit(False))
    return joined.withColumns(
        {"calibrated_score": score, "base_trigger": base, "prototype_detected": alike, "trigger_detected": base | alike}
    )
