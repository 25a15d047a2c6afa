"""Operator 13 against a search over all edit strings, and its defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from wakelens.llm import conversation_repair as cr

PATTERN = re.compile(r"(s?(ua)+)?")
ROWS = "conv_id long, turn long, role string, text string, id string, copy int, step string"


def every_edit(rows):
    """(cost, audit) of the best edits, by trying all strings with at most two insertions in a row."""
    best = None
    gaps = [""] + ["I", "II"]
    for edits in product("KDR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, rows)):
            continue
        cost = sum({"K": 0, "D": 4, "R": 3}[e] + (3 if f == "truncated" and e != "D" else 0) for e, (_, f) in zip(edits, rows))
        for extra in product(gaps, repeat=len(rows) + 1):
            audit = extra[0] + "".join(e + x for e, x in zip(edits, extra[1:]))
            total = cost + 3 * audit.count("I")
            if (best is None or (total, audit) < best) and fits(audit, rows):
                best = (total, audit)
    return best


def fits(audit, rows):
    """Whether some roles for the rerolled and inserted rows give a legal conversation."""
    shape, k = "", 0
    for edit in audit:
        if edit == "K":
            shape += rows[k][0]
        elif edit in "RI":
            shape += "?"
        k += edit != "I"
    if not shape:
        return True
    for start in (("s", "ua"), ("", "ua")):
        for n in range(len(shape) // 2 + 1):
            whole = start[0] + start[1] * n
            if n and len(whole) == len(shape) and all(a == b or (a == "?" and b != "s") for a, b in zip(shape, whole)):
                return True
    return False


def searched(rows):
    search = cr.Search()
    out = b"".join(search.step(r, f in ("blank", "duplicate"), f == "truncated") for r, f in rows)
    return search, (out + search.finish()).decode()


def test_search_equals_all_edit_strings():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.choice([None, None, None, "blank", "truncated"])) for _ in range(rng.randint(0, 4))]
        search, audit = searched(rows)
        assert (search.best[0][0], audit) == every_edit(rows), rows


def test_survivors_coalesce_and_unresolved_ties_stay_exact():
    """Edits leave while rows arrive; where parity stays open to the end, the tree holds one byte an edit."""
    search = cr.Search()
    sent = sum(len(search.step("ua"[k % 2], False, False)) for k in range(2000))
    assert sent > 1900
    open_end = cr.Search()
    assert sum(len(open_end.step("x", False, False)) for _ in range(3001)) < 2
    nodes = {id(n): len(n.edits) for _, leaf in open_end.best.values() for n in cr._line(leaf)}
    assert len(nodes) <= 7 and sum(nodes.values()) <= 2 * 3001 + 8
    assert open_end.finish().decode() == "D" + "R" * 3000


def test_rows_wait_in_a_spill_file(monkeypatch):
    monkeypatch.setattr(cr, "HELD_BYTES", 10)
    waiting = cr.Waiting()
    for k in range(8):
        waiting.push((k, "user", "text" * k, None))
    first = [waiting.pop()[0] for _ in range(5)]
    waiting.push((8, "user", "more", None))
    assert first + [waiting.pop()[0] for _ in range(4)] == list(range(9)) and waiting.file is None


def expected(rows):
    """Whole result of one conversation in plain Python."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    seen, faulty = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append((role[:1], fault))
    search, audit = searched(faulty)
    out, k, at = [], 0, 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        role, text = (rows[k][1], rows[k][2]) if edit != "I" else (None, "")
        if edit == "K":
            at = cr.KEPT[at][role[:1]]
        else:
            at = cr.NEXT[at]
            role = cr.ROLE[at]
        k += edit != "I"
        out.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a + b for (a, _), (b, _) in zip(faulty, faulty[1:])]
    counts = [sum(f == name for _, f in faulty) for name in cr.FAULTS]
    return (gaps, *counts, sum(p not in cr.LEGAL for p in pairs), search.best[0][0], audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(9)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]), rng.choice(["Yes.", "No", "", None, " \t\n", "What? ", "A. \x0b", "Ünlike!"])))
    rows += [(99, k, "ua"[k % 2].replace("u", "user").replace("a", "assistant"), f"Line {k}.") for k in range(3000)]
    rows += [(98, 0, "system", "long " * 200_000 + ".")]
    return rows


def test_summaries(spark, conversations):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in conversations], ROWS).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in cr.summaries(df).collect()}
    ids = {r[0] for r in conversations}
    assert set(got) == ids
    for name in ids:
        assert got[name] == expected([r[1:] for r in conversations if r[0] == name]), name
    assert cr.summaries(df.limit(0)).count() == 0


def test_edits_rebuild_the_conversation(spark, conversations):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in conversations], ROWS)
    rows = sorted(cr.repair(df).collect(), key=lambda r: (r.id is not None, r.id or 0, r.step))
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r.id, []).append(r)
    for name, edits in by_conv.items():
        assert [r.step for r in edits] == list(range(len(edits)))
        initials = "".join(r.role[:1] for r in edits if r.role is not None)
        assert PATTERN.fullmatch(initials)
        assert sum(r.edit != "I" for r in edits) == sum(c[0] == name for c in conversations)


def test_damage(spark, conversations):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in conversations[:200]], ROWS)
    want = []
    for conv, turn, role, text, *_ in conversations[:200]:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, cr.damaged(df).collect()), key=key) == sorted(want, key=key)
