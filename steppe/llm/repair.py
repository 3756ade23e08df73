"""Conversation structure repair: a forward Viterbi over the grammar of turns.

A conversation may be empty, or have an optional system turn and then pairs of a
user and an assistant turn: its role initials match ``(s?(ua)+)?``. Edits keep a
turn (K, free), change its role to user or assistant (R, 2), delete it (D, 3) or
insert an empty one (I, 2); a truncated turn that stays costs 1 more, blank and
repeated turns must go. Of the cheapest edits those count whose initials, read
in order, come first in ASCII.

The four states of the grammar each carry their least (cost, edits). A turn
first gets its own edit in every state; then at most two inserts close the
layer, since a third would lead back to a state that one insert reaches. Two
equally cheap edit strings of one state and turn are never prefixes of one
another (the longer would have inserts more, which cost), so what follows
can't change their order, and one string for each state is enough.

Turns come sorted in a stream. As soon as all states that can still win share
the edits of the earliest turns, these turns are settled and leave as rows:
memory holds the turns that are still open, not the conversation. Which turns
repeat an earlier one is a window in the JVM, which may spill. A conversation
is one task, as its edits depend on one another in order.

Defined results: null roles and texts count as one space; null turns come
first, equal turns are ordered by role, then text; null conversation ids form
one conversation; a role that starts with none of s, u, a can't be kept, an
empty one neither; a conversation whose turns are all dropped has one row
without an edit; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steppe.llm.shared import map_batches

SPACE = r"\x20\x09-\x0D"
EDITS = "conv_id long, seq long, edit string, fault string, turn long, old_role string, role string, text string"
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits, and of a truncated turn that stays.
COST, TRUNCATED = {"K": 0, "R": 2, "D": 3, "I": 2}, 1
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Open turns after which the stream tries to settle some; rows of a batch that goes out, and bytes of its texts.
OPEN, ROWS, BYTES = 32, 4096, 1 << 24


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults at places that ids decide: the input of ``op13``.

    crc32 of ``conv_id:turn``, modulo 20: 0 drops a turn, 1 empties its text, 2
    removes its stops, 3 repeats it, 4 makes it a user's. Dropped turns stay as
    rows marked so, which keeps every conversation.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def fault(text: Column, repeated: Column) -> Column:
    """The first fault of a turn, or null."""
    return (
        F.when(~text.rlike(f"[^{SPACE}]"), "blank")
        .when(repeated, "duplicate")
        .when(~text.rlike(rf"[.!?][{SPACE}]*\z"), "truncated")
    )


def repair(turns: DataFrame) -> DataFrame:
    """The edits of every conversation, in order (``EDITS``).

    ``turns``: conv_id, turn, role, text, and dropped where some turns only keep
    their conversation in the table. Rows of kept, changed and inserted turns
    have the role and text of the repaired conversation; deleted ones have null.
    """
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        dropped.alias("dropped"),
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("copy", F.row_number().over(same))
    rows = rows.withColumn("fault", F.when(~F.col("dropped"), fault(F.col("text"), F.col("copy") > 1)))
    rows = rows.select("conv_id", "turn", "role", F.when(~F.col("dropped"), F.col("text")).alias("text"), "dropped", "copy", "fault")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "copy"]
    return map_batches(rows.sortWithinPartitions(*order), edit_batches, EDITS)


def summarize(edits: DataFrame) -> DataFrame:
    """Counts of faults, cost, edit initials and digest of each conversation.

    It reads the rows of ``repair`` in the order in which they leave it, without
    a shuffle; the digest runs along, so no conversation is held.
    """
    return map_batches(edits, summary_batches, SUMMARY)


class Viterbi:
    """The least (cost, edits) of each grammar state, after the turns so far."""

    def __init__(self):
        self.layer = self._closed({START: (0, "")})

    @staticmethod
    def _closed(layer: dict) -> dict:
        for _ in range(2):
            for state, (cost, edits) in list(layer.items()):
                Viterbi._offer(layer, ASSISTANT if state == USER else USER, cost + COST["I"], edits + "I")
        return layer

    @staticmethod
    def _offer(layer: dict, state: int, cost: int, edits: str) -> None:
        if state not in layer or (cost, edits) < layer[state]:
            layer[state] = (cost, edits)

    def turn(self, initial: str, fault: str | None) -> None:
        fresh: dict = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for state, (cost, edits) in self.layer.items():
            self._offer(fresh, state, cost + COST["D"], edits + "D")
            if fault in ("blank", "duplicate"):
                continue
            following = ASSISTANT if state == USER else USER
            self._offer(fresh, following, cost + COST["R"] + extra, edits + "R")
            if initial == ("a" if state == USER else "u"):
                self._offer(fresh, following, cost + extra, edits + "K")
            elif initial == "s" and state == START:
                self._offer(fresh, SYSTEM, cost + extra, edits + "K")
        self.layer = self._closed(fresh)

    def settle(self) -> str:
        """Takes off the edits that all states share which can still win; the others end.

        From the assistant's state the conversation can go on as from the other
        two, but for keeping a system turn, which it deletes instead.
        """
        best = self.layer[ASSISTANT][0]
        slack = {START: COST["D"], SYSTEM: 0}
        alive = {state: path for state, path in self.layer.items() if path[0] <= best + slack.get(state, path[0])}
        done = commonprefix([edits for _, edits in alive.values()])
        self.layer = {state: (cost, edits[len(done) :]) for state, (cost, edits) in alive.items()}
        return done

    def best(self) -> str:
        return min(self.layer[s] for s in (START, ASSISTANT) if s in self.layer)[1]


class Conversation:
    """One conversation in the stream: open turns, and where the settled ones end."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.path, self.open, self.state, self.seq, self.limit = conv_id, Viterbi(), [], START, 0, OPEN

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> list[tuple]:
        self.path.turn(role[:1], fault)
        self.open.append((turn, role, text, fault))
        if len(self.open) < self.limit:
            return []
        rows = self._rows(self.path.settle())
        self.limit = OPEN + len(self.open) * 2  # nothing settled: wait longer, so that the tries stay cheap
        return rows

    def end(self) -> list[tuple]:
        return self._rows(self.path.best()) or ([] if self.seq else [(self.conv_id, 0, None, None, None, None, None, None)])

    def _rows(self, edits: str) -> list[tuple]:
        out, at = [], 0
        for edit in edits:
            turn = old = text = fault = role = None
            if edit != "I":
                turn, old, text, fault = self.open[at]
                at += 1
            if edit in "RI":
                self.state = ASSISTANT if self.state == USER else USER
                role, text = ROLES[self.state], text or ""
            elif edit == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[old[0]]
                role = old
            else:
                text = None
            out.append((self.conv_id, self.seq, edit, fault, turn, old, role, text))
            self.seq += 1
        del self.open[:at]
        return out


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, now, out, size = _schema(EDITS), None, [], 0
    names = ("conv_id", "turn", "role", "text", "dropped", "fault")
    for batch in batches:
        for conv_id, turn, role, text, dropped, fault in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now is None or conv_id != now.conv_id:
                out += now.end() if now else []
                now = Conversation(conv_id)
            if not dropped:
                size += len(text)
                out += now.add(turn, role, text, fault)
            if len(out) >= ROWS or (size >= BYTES and out):
                yield _batch(out, schema)
                out, size = [], 0
    out += now.end() if now else []
    if out:
        yield _batch(out, schema)


class Summary:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.faults, self.illegal, self.cost = conv_id, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.letters, self.digest, self.first, self.last, self.turns, self.before, self.any = [], hashlib.sha256(), None, None, 0, None, False

    def add(self, edit, fault, turn, old_role, role, text) -> None:
        if edit is None:
            return
        self.letters.append(edit)
        self.cost += COST[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if fault:
            self.faults[fault] += 1
        if edit != "I":
            if turn is not None:
                self.first = turn if self.first is None else self.first
                self.turns += turn != self.last
                self.last = turn
            initial = old_role[:1]
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
        if edit != "D":
            self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest())


def summary_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, now, out = _schema(SUMMARY), None, []
    names = ("conv_id", "edit", "fault", "turn", "old_role", "role", "text")
    for batch in batches:
        for conv_id, *edit in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now is None or conv_id != now.conv_id:
                out += [now.row()] if now else []
                now = Summary(conv_id)
            now.add(*edit)
        if len(out) >= ROWS:
            yield _batch(out, schema)
            out = []
    out += [now.row()] if now else []
    if out:
        yield _batch(out, schema)
