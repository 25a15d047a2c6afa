"""Conversation structure repair (operator 13).

The cheapest edits that give a conversation the roles ``(system? (user
assistant)+)?`` are found by a Viterbi search with one survivor per place in that
pattern.  Edits are kept, given another role, deleted or inserted; blank and
repeated rows must go.  Of equally cheap edit strings the least in ASCII order
wins.  The survivors' edits hang in one backpointer tree whose nodes count what
refers to them.  As soon as every survivor shares an ancestor, the edits up to it
are final: they leave the tree, and the rows they belong to leave the task.  So
a task streams through the sorted rows of its conversations and holds what is
undecided only: one byte per edit and branch, and the waiting rows, which go to a
spill file of the task beyond ``HELD_BYTES``.

Two survivors that meet in one place with one cost are compared by their whole
edits since their common ancestor.  Neither can be a beginning of the other,
since edits of one string and the same rows cost the same.  A survivor that
another one can imitate for less goes at once.

A conversation is sorted and read by one task, as its repaired text is one
sequence; nothing of it but the undecided part is held.

Defined cases: null roles and texts are one space; rows without a turn come first;
rows of one turn are taken by role, then text; a null identifier is one
conversation; repeated rows are duplicates, so they go; an empty table gives no
rows; only the named columns are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
import tempfile
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import arrow_map

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")
CHANGE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
HELD_BYTES = 16 << 20
SENT_ROWS, SENT_BYTES = 1000, 4 << 20

# Places in the pattern: nothing yet, after the system row, after a user row,
# after an assistant row.  The first and the last may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}


class Node:
    """A piece of a survivor's edits, from its parent's end on."""

    __slots__ = ("parent", "edits", "refs")

    def __init__(self, parent: Node | None, edits: bytes = b"") -> None:
        self.parent, self.edits, self.refs = parent, bytearray(edits), 0


def _line(node: Node) -> list[Node]:
    out = [node]
    while node.parent is not None:
        node = node.parent
        out.append(node)
    return out[::-1]


def _before(a: tuple[Node, bytes], b: tuple[Node, bytes]) -> bool:
    """Whether the edits of ``a`` come before those of ``b``, of equal cost."""
    left, right = _line(a[0]), _line(b[0])
    k = 0
    while k < min(len(left), len(right)) and left[k] is right[k]:
        k += 1
    tail = lambda line, last: b"".join(bytes(n.edits[:64]) for n in line[k:]) + last
    first, second = tail(left, a[1]), tail(right, b[1])
    # Branches part at their first letter, so a short beginning settles nearly all.
    if first[:1] != second[:1]:
        return first < second
    whole = lambda line, last: b"".join(bytes(n.edits) for n in line[k:]) + last
    return whole(left, a[1]) < whole(right, b[1])


class Search:
    """Survivors of one conversation; ``step`` and ``finish`` return the edits that became final."""

    def __init__(self) -> None:
        self.root = Node(None)
        self.best: dict[int, tuple[int, Node]] = {NOTHING: (0, self.root)}
        self._insert()

    def step(self, initial: str, removed: bool, truncated: bool) -> bytes:
        found: dict[int, tuple[int, Node, bytes]] = {}
        extra = TRUNCATED if truncated else 0
        for place, (cost, node) in self.best.items():
            self._offer(found, place, cost + DELETE, node, b"D")
            if not removed:
                if initial in KEPT[place]:
                    self._offer(found, KEPT[place][initial], cost + extra, node, b"K")
                self._offer(found, NEXT[place], cost + CHANGE + extra, node, b"R")
        self._grow(found)
        self._insert()
        self._prune()
        return self._settle()

    def finish(self) -> bytes:
        ends = {0: (*self.best[p], b"") for p in (ASSISTANT,) if p in self.best}
        if NOTHING in self.best:
            self._offer(ends, 0, *self.best[NOTHING], b"")
        self.best = {0: ends[0][:2]}
        edits = b"".join(bytes(n.edits) for n in _line(ends[0][1]))
        return edits

    def _offer(self, found: dict, place: int, cost: int, node: Node, edit: bytes) -> None:
        held = found.get(place)
        if held is None or cost < held[0] or (cost == held[0] and _before((node, edit), held[1:])):
            found[place] = (cost, node, edit)

    def _grow(self, found: dict[int, tuple[int, Node, bytes]]) -> None:
        """Append the chosen edits; a node that goes on in one way only is extended in place."""
        for node in {id(n): n for _, n, _ in found.values()}.values():
            node.refs = 0
        for _, node, _ in found.values():
            node.refs += 1
        inner = {id(n) for _, leaf in self.best.values() for n in _line(leaf)[:-1]}
        self.best = {}
        for place, (cost, node, edit) in found.items():
            if node.refs == 1 and id(node) not in inner:
                node.edits += edit
                self.best[place] = (cost, node)
            else:
                self.best[place] = (cost, Node(node, edit))

    def _insert(self) -> None:
        """Insertions between rows: a user row from anywhere, then an assistant row."""
        for place, sources in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            found = {place: (*self.best[place], b"")} if place in self.best else {}
            for source in sources:
                if source in self.best:
                    cost, node = self.best[source]
                    self._offer(found, place, cost + INSERT, node, b"I")
            if place in found and found[place][2]:
                cost, node, edit = found[place]
                self.best[place] = (cost, Node(node, edit))

    def _prune(self) -> None:
        """Drop what the survivor after an assistant row can imitate for less."""
        limit = self.best[ASSISTANT][0]
        if SYSTEM in self.best and self.best[SYSTEM][0] > limit:
            del self.best[SYSTEM]
        if NOTHING in self.best and self.best[NOTHING][0] > limit + DELETE:
            del self.best[NOTHING]

    def _settle(self) -> bytes:
        """Count references, join nodes that no longer branch, and hand out the edits all survivors share."""
        ends = {id(node) for _, node in self.best.values()}
        nodes: dict[int, Node] = {}
        only: dict[int, Node] = {}
        for _, leaf in self.best.values():
            node = leaf
            while id(node) not in nodes:
                nodes[id(node)] = node
                node.refs = 1 if id(node) in ends else 0
                if node.parent is None:
                    break
                node = node.parent
        for node in nodes.values():
            if node.parent is not None:
                node.parent.refs += 1
                only[id(node.parent)] = node
        for node in list(nodes.values()):
            while node.refs == 1 and id(node) not in ends and node is not self.root and id(node) in nodes:
                child = only[id(node)]
                node.edits += child.edits
                self._replace(child, node, nodes, ends, only)
        out = b""
        while self.root.refs == 1 and id(self.root) not in ends:
            child = only[id(self.root)]
            out += bytes(child.edits)
            child.edits, child.parent, self.root = bytearray(), None, child
        if self.root.edits:
            out, self.root.edits = bytes(self.root.edits) + out, bytearray()
        return out

    def _replace(self, child: Node, node: Node, nodes: dict, ends: set, only: dict) -> None:
        for place, (cost, leaf) in self.best.items():
            if leaf is child:
                self.best[place] = (cost, node)
                ends.add(id(node))
        node.refs = child.refs
        for other in nodes.values():
            if other.parent is child:
                other.parent = node
        if id(child) in only:
            only[id(node)] = only[id(child)]
        del nodes[id(child)]


class Waiting:
    """Rows whose edit is not final, first in first out; beyond ``HELD_BYTES`` in a spill file."""

    def __init__(self) -> None:
        self.rows: deque = deque()
        self.bytes = self.spilled = self.read_at = 0
        self.file = None

    def push(self, row: tuple) -> None:
        if self.spilled or self.bytes > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            pickle.dump(row, self.file)
            self.spilled += 1
        else:
            self.rows.append(row)
            self.bytes += len(row[2])

    def pop(self) -> tuple:
        if self.rows:
            row = self.rows.popleft()
            self.bytes -= len(row[2])
            return row
        self.file.seek(self.read_at)
        row = pickle.load(self.file)
        self.read_at = self.file.tell()
        self.spilled -= 1
        if not self.spilled:
            self.file.close()
            self.file, self.read_at = None, 0
        return row


class Repair:
    """Streams the rows of one conversation into rows of edits."""

    def __init__(self, name) -> None:
        self.name, self.search, self.waiting = name, Search(), Waiting()
        self.place, self.steps = NOTHING, 0

    def add(self, turn, role: str, text: str, fault: str | None) -> Iterator[tuple]:
        self.waiting.push((turn, role, text, fault))
        yield from self._apply(self.search.step(role[:1], fault in FAULTS[:2], fault == "truncated"))

    def end(self) -> Iterator[tuple]:
        yield from self._apply(self.search.finish())

    def _apply(self, edits: bytes) -> Iterator[tuple]:
        for edit in edits.decode("ascii"):
            turn, was, text, fault = (None, None, "", None) if edit == "I" else self.waiting.pop()
            role, extra = was, TRUNCATED if fault == "truncated" else 0
            if edit == "K":
                cost, self.place = extra, KEPT[self.place][was[:1]]
            elif edit == "D":
                cost, role, text = DELETE, None, None
            else:
                cost, self.place = (INSERT if edit == "I" else CHANGE + extra), NEXT[self.place]
                role = ROLE[self.place]
            yield self.name, self.steps, edit, turn, was, fault, role, text, cost
            self.steps += 1


def faults(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, fault, copy): the first fault of every row, null where it has none, and how many equal rows there are up to it."""
    plain = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    # Dealt out by conversation once: the copies' window and the final order need no further exchange.
    dealt = plain.repartition("id")
    copy = F.row_number().over(Window.partitionBy("id", "role", F.sha2("text", 256)).orderBy("turn"))
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    return dealt.withColumn("copy", copy).select(
        "id", "turn", "role", "text",
        F.when(last == "", FAULTS[0]).when(F.col("copy") > 1, FAULTS[1]).when(~last.isin(".", "!", "?"), FAULTS[2]).alias("fault"),
        "copy",
    )


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per edit of every conversation, in order.

    Columns: id, step, edit (K, R, D or I), turn, was (the role before), fault, role and text
    (after; null where the row is deleted) and cost.  The rows of a conversation
    follow one another in one partition, by step.
    """
    found = faults(rows, id_col, turn_col, role_col, text_col)
    kinds = dict(found.dtypes)
    schema = f"id {kinds['id']}, step long, edit string, turn {kinds['turn']}, was string, fault string, role string, text string, cost long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sender(types)
        held: Repair | None = None
        for batch in batches:
            types_of(batch)
            for name, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held is None or name != held.name:
                    if held is not None:
                        yield from sent.add(held.end())
                    held = Repair(name)
                yield from sent.add(held.add(*row))
        if held is not None:
            yield from sent.add(held.end())
        yield from sent.rest()

    names = ["id", "step", "edit", "turn", "was", "fault", "role", "text", "cost"]
    types = dict.fromkeys(names, pa.string()) | {"step": pa.int64(), "cost": pa.int64()}

    def types_of(batch: pa.RecordBatch) -> None:
        types["id"], types["turn"] = batch.schema.field(0).type, batch.schema.field(1).type

    ordered = found.sortWithinPartitions("id", "turn", "role", "text", "copy")
    return arrow_map(ordered, task, schema)


class _Sender:
    """Collects rows and sends them on in batches of bounded size."""

    def __init__(self, types: dict[str, pa.DataType]) -> None:
        self.types, self.rows, self.bytes = types, [], 0

    def add(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            self.rows.append(row)
            self.bytes += len(row[7] or "") if len(row) > 7 else 0
            if len(self.rows) >= SENT_ROWS or self.bytes > SENT_BYTES:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types.values())], list(self.types))
            self.rows, self.bytes = [], 0


class Summary:
    """Counts, edits and digest of one conversation, from its rows of edits."""

    def __init__(self, name) -> None:
        self.name, self.counts, self.audit, self.digest = name, dict.fromkeys(FAULTS, 0), bytearray(), hashlib.sha256()
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = self.initial = None
        self.kept = False

    def add(self, edit: str, turn, was: str | None, fault: str | None, role: str | None, text: str | None, cost: int) -> None:
        self.audit += edit.encode("ascii")
        self.cost += cost
        if edit != "I":
            if self.initial is not None and self.initial + was[:1] not in LEGAL:
                self.illegal += 1
            self.initial = was[:1]
            if fault is not None:
                self.counts[fault] += 1
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
        if role is not None:
            self.digest.update(("\n" if self.kept else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.kept = True

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.name, gaps, *self.counts.values(), self.illegal, self.cost, self.audit.decode("ascii"), self.digest.hexdigest()


def summaries(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation that has rows."""
    edits = repair(rows, id_col, turn_col, role_col, text_col)
    names = ["id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    types = dict.fromkeys(names, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, held = _Sender(types), None
        for batch in batches:
            types["id"] = batch.schema.field(0).type
            for name, *row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if held is None or name != held.name:
                    if held is not None:
                        yield from sent.add([held.row()])
                    held = Summary(name)
                held.add(*row)
        if held is not None:
            yield from sent.add([held.row()])
        yield from sent.rest()

    # No exchange in between, so every conversation arrives whole and in order.
    slim = edits.select("id", "edit", "turn", "was", "fault", "role", "text", "cost")
    schema = f"id {dict(edits.dtypes)['id']}, gaps long, " + ", ".join(f"{f} long" for f in FAULTS) + ", illegal long, cost long, audit string, repaired_sha256 string"
    return arrow_map(slim, task, schema)


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults planted by a hash of identifier and turn: dropped, emptied, without end marks, repeated, or of role user."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(id_col), F.lit(":"), part(turn_col))) % 20
    hit: list[tuple[Column, Column]] = [(kind == 1, F.lit("")), (kind == 2, F.regexp_replace(part(text_col), "[.!?]", ""))]
    text = F.when(*hit[0]).when(*hit[1]).otherwise(part(text_col))
    changed = rows.where(kind != 0).select(F.col(id_col), F.col(turn_col), F.when(kind == 4, "user").otherwise(part(role_col)).alias(role_col), text.alias(text_col), F.when(kind == 3, 2).otherwise(1).alias("copies_"))
    return changed.withColumn("copies_", F.explode(F.sequence(F.lit(1), "copies_"))).drop("copies_")
