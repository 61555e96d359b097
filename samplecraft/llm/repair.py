"""Conversation structure repair by secondary-sorted streaming.

``damage`` makes a conversation table with known kinds of damage;
``repair`` finds each conversation's faults and the cheapest edits that give
its role initials the form ``(s?(ua)+)?``.

Edits: Keep (no cost, the role's initial must fit), Rerole to user or
assistant (2), Delete (3, the only edit of a blank or duplicate row), Insert an
empty user or assistant row (2); a truncated row that is not deleted adds 1.
What fits follows from a small automaton: start, after s, after u, after a.
Of the cheapest edits those whose initials are least in ASCII order are taken.

Rows are dealt by conversation.  Inside a partition they are sorted three
times: by (conversation, role, text, turn), so a window of one running number
marks repeated rows; by conversation and turn descending, where mapInPandas
carries the costs of the four states from the conversation's end across Arrow
batches and leaves each row with a backpointer of 12 bits (the best edit from
each state); and ascending, where mapInPandas carries the automaton's state,
the faults and the running SHA-256.  Spark's sorts spill, so a giant conversation
costs disk and time, not memory; only its audit, one letter an edit, is kept.
The choice of least letters needs no strings: edits up to and with a row's own
differ before one can be a prefix of another, so the first difference decides.
One conversation is one task's work: its edits and its SHA-256 follow one order.

The costs, less their smallest, take few values, so each (costs, kind of row)
is worked out once and looked up after that.

Nulls in role or text are one space, and so are a null id or turn in the
damage key; null turns come first; rows with a null id are one conversation with a
null id.  Rows of equal turn are ordered by role, then text.  A role without a
first character (empty) fits nothing.  An empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

GONE = "lost"  # marks a row that only says that its conversation was there

# states of the automaton: 0 start, 1 after s, 2 after u, 3 after a
_ROLES = ("s", "u", "a")
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_PUT = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after an inserted or rerolled row
_SEGMENTS = ("D", "ID", "IK", "IR", "K", "R")  # what happens up to and with a row, in ASCII order
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_FAR = 1 << 40
#: from each state: (cost, edits) at the end of a conversation
_END = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
NONE, BLANK, DUPLICATE, CUT = range(4)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 loses the row (``lost`` is true, so its conversation is still known), 1
    empties the text, 2 removes its ``. ! ?``, 3 repeats the row, 4 makes the role user.
    """
    def as_text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                as_text("role").alias("role"), as_text("text").alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
         .otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias(GONE), copies.alias("copy")).drop("copy")


def step(state: int, segment: str, role: str) -> int | None:
    """The state after a segment, or None where it does not fit."""
    if segment[0] == "I":
        state, segment = _PUT[state], segment[1:]
    return {"D": state, "K": _KEPT.get((state, role)), "R": _PUT[state]}[segment]


def segment_cost(segment: str, fault: int) -> int | None:
    if fault in (BLANK, DUPLICATE) and segment[-1] != "D":
        return None
    cost = {"D": DELETE, "K": 0, "R": REROLE}[segment[-1]] + (INSERT if segment[0] == "I" else 0)
    return cost + (TRUNCATED if fault == CUT and segment[-1] != "D" else 0)


@functools.cache
def best_edits(after: tuple[int, int, int, int], role: str, fault: int) -> tuple[tuple[int, int, int, int], int]:
    """(costs before the row, less the smallest; best segment of each state in three bits).

    ``after``: the cost from each state behind the row to the end.
    """
    costs, code = [], 0
    for q in range(4):
        best = (_FAR, 0)
        for k, seg in enumerate(_SEGMENTS):  # in ASCII order: of equal costs the first is least
            to, own = step(q, seg, role), segment_cost(seg, fault)
            if to is not None and own is not None:
                best = min(best, (own + after[to], k), key=lambda x: x[0])
        costs.append(best[0])
        code |= best[1] << (3 * q)
    low = min(costs)
    return tuple(c - low for c in costs), code


def _backpointers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with each conversation's last one first: adds ``edits``."""
    end = tuple(_END[q][0] for q in range(4))
    now, costs = object(), end
    for b in batches:
        out = np.zeros(len(b), np.int16)
        ids, gone = b["conv_id"].array, b[GONE].to_numpy()
        roles, faults = b["role"].str.slice(0, 1).to_numpy(), b["fault"].to_numpy()
        for i, conv in enumerate(ids):
            conv = None if pd.isna(conv) else int(conv)
            if conv != now:
                now, costs = conv, end
            if not gone[i]:
                costs, out[i] = best_edits(costs, roles[i] if roles[i] in _ROLES else "", int(faults[i]))
        b["edits"] = out
        yield b


class _Repair:
    """One conversation as its rows pass in order."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost, self.audit, self.sha, self.first = conv, 0, 0, bytearray(), hashlib.sha256(), True
        self.counts, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.low = self.turn = None
        self.distinct = 0

    def put(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.first = False

    def insert(self) -> None:
        self.cost += INSERT
        self.audit += b"I"
        self.state = _PUT[self.state]
        self.put("user" if self.state == 2 else "assistant", "")

    def row(self, turn: int | None, role: str, text: str, fault: int, edits: int) -> None:
        self.counts[fault] += 1
        pair = None if self.before is None else self.before + role[:1]
        self.illegal += pair not in (None, "su", "ua", "au")
        self.before = role[:1]
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.distinct = turn, self.distinct + 1
        seg = _SEGMENTS[edits >> (3 * self.state) & 7]
        if seg[0] == "I":
            self.insert()
        op = seg[-1]
        self.cost += segment_cost(op, fault)
        self.audit += op.encode()
        self.state = step(self.state, op, role[:1])
        if op == "K":
            self.put(role, text)
        elif op == "R":
            self.put("user" if self.state == 2 else "assistant", text)

    def result(self) -> tuple:
        for _ in _END[self.state][1]:
            self.insert()
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.counts[1:], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


_RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _RESULT.split(", ")]
    one = None
    for b in batches:
        done = []
        ids, turns, gone = b["conv_id"].array, b["turn"].array, b[GONE].to_numpy()
        for i, (role, text, fault, edits) in enumerate(zip(b["role"], b["text"], b["fault"], b["edits"])):
            conv = None if pd.isna(ids[i]) else int(ids[i])
            if one is None or conv != one.conv:
                if one is not None:
                    done.append(one.result())
                one = _Repair(conv)
            if not gone[i]:
                one.row(None if pd.isna(turns[i]) else int(turns[i]), role, text, int(fault), int(edits))
        yield _frame(done, names)
    if one is not None:
        yield _frame([one.result()], names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"conv_id": "Int64"} | {c: "int64" for c in names[1:7]})


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by conversation, with each row's first ``fault`` and its running number ``again`` among equal ones.

    0 none, 1 blank, 2 duplicate (role and text seen earlier), 3 truncated.
    """
    spread = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", GONE).orderBy("turn")
    return spread.withColumn("again", F.row_number().over(same)).withColumn(
        "fault", F.when(F.col(GONE), NONE).when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("again") > 1, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(NONE))


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    ``conversations``: conv_id, turn, role, text and, if there is one, ``lost``
    (such rows only name their conversation).
    """
    ship_package(conversations.sparkSession)
    gone = F.col(GONE) if GONE in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), gone.alias(GONE))
    rows = faults(rows)
    order = ["turn", "role", "text", "again", GONE]
    marked = (rows.sortWithinPartitions("conv_id", *[F.col(c).desc_nulls_last() for c in order])
              .mapInPandas(_backpointers, rows.schema.add("edits", "short")))
    return (marked.sortWithinPartitions("conv_id", *[F.col(c).asc_nulls_first() for c in order])
            .mapInPandas(_apply, _RESULT))
