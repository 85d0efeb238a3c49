"""Repair of the turn structure of conversations, by the cheapest edits.

``damaged`` plants faults by a hash of (conv_id, turn); ``repair`` finds and mends them.

1. Which (role, text) of a conversation stands at several turns is counted with partial
   sums by Spark, and only rows that may repeat meet that list in a join; so no task holds
   what a conversation has said so far.
2. Rows are repartitioned by conversation, sorted by turn and read as a stream.  Four
   states say what the kept rows can be followed by (nothing kept yet, a system row, a user
   row, an assistant row).  For each state the cheapest edits are carried across Arrow batches:
   their cost, their rank among the states in ASCII order and a SHA-256 that has read the
   repaired rows so far.  A state that another one beats whatever follows is dropped.
3. Of each row two bytes remain: the edit and the state before, for every state.  Beyond
   ``SPILL_ROWS`` rows of one conversation they go to a scratch file of the task, which is
   read backwards in blocks at the end.  Memory thus does not grow with a conversation but for
   the audit string, one letter a row, which is a result.

Edits: Keep (0), Rerole to user or assistant (3), Delete (4, required for blank rows and
duplicates), Insert an empty user or assistant row (3); a truncated row that is not deleted
costs 3 more.  The initials of the repaired roles read ``(s?(ua)+)?``.  Of the cheapest
edits those with the ASCII-least initials (D, I, K, R) are taken.

Defined results: null roles and texts, and nulls in the hashed key, read as one space; rows
are taken by turn (nulls first), rows of one turn by role and text; an empty role has no
initial, so that it is rerolled or deleted; repeated rows are duplicates of the first; rows
without a conv_id are one conversation; a conversation that loses all its rows has zeros, an
empty audit and the hash of the empty string; an empty table gives an empty result; only
the four columns are read, others of any name do not matter.  One text is held at a time.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import bounded_batches, slot_filter, stored, with_slot_flag

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
LEGAL = frozenset({"su", "ua", "au"})
SPILL_ROWS = 1 << 20
BATCH_BYTES = 1 << 20

# States: nothing kept, after a system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT_IS_USER = (NOTHING, SYSTEM, ASSISTANT)
# What it costs one state (row) at most to follow whatever another (column) goes on with.
FOLLOWS = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))
EDITS = ("D", "K", "IK", "R", "IR")
OUT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows with planted faults; no copies means dropped."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text_of("text"), ENDS, ""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(text_of("role")).alias("role"),
        text.otherwise(text_of("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def with_seen(rows: DataFrame) -> DataFrame:
    """Adds ``seen``: the role and text stood at an earlier turn of the conversation."""
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"),
        F.lit(":"), "role", "text",
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = rows.withColumn("said", F.sha2(name, 256))
    often = stored(
        rows.where("copies > 0")
        .groupBy(F.col("said").alias("often"))
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("often", "first")
    )
    flags = stored(slot_filter(often.select(F.col("often").alias("said")), ["said"]))
    rows = with_slot_flag(rows, flags, ["said"], "may_repeat")
    names = ["conv_id", "turn", "role", "text", "copies"]
    once = rows.where("not may_repeat").select(*names, F.lit(False).alias("seen"))
    again = rows.where("may_repeat").join(often, F.col("said") == F.col("often"), "left")
    return once.unionByName(again.select(*names, F.coalesce(place > F.col("first"), F.lit(False)).alias("seen")))


class Backpointers:
    """Two bytes a row; whole blocks go to a scratch file of the task."""

    def __init__(self, most: int):
        self.most, self.block, self.file, self.blocks = most, array("H"), None, 0

    def append(self, code: int) -> None:
        self.block.append(code)
        if len(self.block) >= self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.block.tofile(self.file)
            self.blocks += 1
            self.block = array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.block)
        for k in reversed(range(self.blocks)):
            self.file.seek(2 * k * self.most)
            block = array("H")
            block.fromfile(self.file, self.most)
            yield from reversed(block)

    def close(self) -> None:
        if self.file:
            self.file.close()


class Talk:
    """What is carried of the conversation that is being read."""

    def __init__(self, conv_id: int | None, spill_rows: int):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.before = None  # (turn, role, text) of the row before
        # per state: (cost, rank, SHA-256 of the repaired rows), or None
        self.paths: list[tuple | None] = [(0, 0, hashlib.sha256()), None, None, None]
        self.pointers = Backpointers(spill_rows)

    def read(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and (self.turns == 0 or turn != self.last_turn):
            self.first_turn = turn if self.turns == 0 else self.first_turn
            self.last_turn = turn
            self.turns += 1
        seen = seen or self.before == (turn, role, text)
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = (turn, role, text)
        body = text.rstrip(WHITE)
        blank = not body
        cut = not blank and not seen and body[-1] not in ENDS
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut
        self._edit(role, text, blank or seen, TRUNCATED if cut else 0)

    def _edit(self, role: str, text: str, must_go: bool, more: int) -> None:
        initial = role[:1]
        best: list[tuple | None] = [None] * 4
        for state, path in enumerate(self.paths):
            if path is None:
                continue
            cost, rank = path[0], path[1]
            options = [(cost + DELETE, rank, "D", state, state)]
            if not must_go:
                user = state in NEXT_IS_USER
                for to, fits in ((USER, user), (ASSISTANT, not user)):
                    lead, extra = ("", 0) if fits else ("I", INSERT)
                    if initial == "ua"[to - USER]:
                        options.append((cost + more + extra, rank, lead + "K", state, to))
                    else:
                        options.append((cost + more + extra + REROLE, rank, lead + "R", state, to))
                if initial == "s" and state == NOTHING:
                    options.append((cost + more, rank, "K", state, SYSTEM))
            for option in options:
                held = best[option[4]]
                if held is None or option < held:
                    best[option[4]] = option
        # a state that another follows at less cost, whatever comes, cannot win any more
        for x in range(4):
            if best[x] and any(
                best[y] and best[y][0] + FOLLOWS[y][x] < best[x][0] for y in range(4) if y != x
            ):
                best[x] = None
        order = sorted((o[1], o[2], o[4]) for o in best if o)
        ranks = {state: rank for rank, (_, _, state) in enumerate(order)}
        code = 0
        paths: list[tuple | None] = [None] * 4
        for state, option in enumerate(best):
            if option is None:
                continue
            cost, _, edit, came, _ = option
            code |= (came << 2 | "DKR".index(edit[-1])) << 4 * state
            paths[state] = (cost, ranks[state], self._hash(came, edit, role, text))
        self.paths = paths
        self.pointers.append(code)

    def _hash(self, state: int, edit: str, role: str, text: str):
        made = self.paths[state][2]
        if edit == "D":
            return made
        made = made.copy()
        if edit[0] == "I":
            state = _insert(made, state)
        if edit[-1] == "R":
            role = "user" if state in NEXT_IS_USER else "assistant"
        made.update((("" if state == NOTHING else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        return made

    def result(self) -> tuple:
        ends = []
        for state, path in enumerate(self.paths):
            if path is not None:
                inserts = (0, 2, 1, 0)[state]
                ends.append((path[0] + inserts * INSERT, path[1], state, inserts))
        cost, _, state, inserts = min(ends)
        made = self.paths[state][2].copy()
        at = state
        for _ in range(inserts):
            at = _insert(made, at)
        letters = bytearray(b"I" * inserts)
        for code in self.pointers.backwards():
            came, edit = divmod(code >> 4 * state & 15, 4)
            letters += b"DKR"[edit : edit + 1]
            # an insert stands before a row that would not fit the state it came from
            if edit and state != SYSTEM and (came in NEXT_IS_USER) != (state == USER):
                letters += b"I"
            state = came
        self.pointers.close()
        letters.reverse()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return (self.conv_id, *counts, letters.decode(), made.hexdigest())


def _insert(made, state: int) -> int:
    """Adds the empty row that may follow the state; the state after it."""
    row, after = ("user:", USER) if state in NEXT_IS_USER else ("assistant:", ASSISTANT)
    made.update((("" if state == NOTHING else "\n") + row).encode())
    return after


def repair(rows: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation from (conv_id, turn, role, text, copies, seen)."""
    bounded_batches(rows.sparkSession, BATCH_BYTES)
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        talk, key = None, None
        for batch in batches:
            done = []
            columns = (batch[c].tolist() for c in ("no_conv", "conv", "no_turn", "at", "role", "text", "copies", "seen"))
            for no_conv, conv, no_turn, at, role, text, copies, seen in zip(*columns, strict=True):
                if talk is None or key != (no_conv, conv):
                    if talk:
                        done.append(talk.result())
                    key = (no_conv, conv)
                    talk = Talk(None if no_conv else conv, spill_rows)
                for _ in range(copies):
                    talk.read(None if no_turn else at, role, text, seen)
            yield _frame(done, names)
        if talk:
            yield _frame([talk.result()], names)

    # without nulls, so that pandas keeps whole numbers
    plain = rows.select(
        F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("turn").isNull().alias("no_turn"),
        F.coalesce("turn", F.lit(0)).alias("at"),
        "role", "text", "copies", "seen",
    )
    return (
        plain.repartition("no_conv", "conv")
        .sortWithinPartitions("no_conv", "conv", F.desc("no_turn"), "at", "role", "text")
        .mapInPandas(run, OUT)
    )


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=names)
    return made.astype({c: "Int64" for c in names[:-2]} | {c: "object" for c in names[-2:]})


def repair_conversations(conversations: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """The faults, cheapest edits and repaired digest of every conversation after ``damaged``."""
    return repair(with_seen(damaged(conversations)), spill_rows)
