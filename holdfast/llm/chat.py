"""Chat formatting by columnar byte assembly.

Rows are range-partitioned by (conversation, turn), so a conversation of any length is
spread over tasks.  A task computes the lengths of all segments of a batch (header,
role, text, end mark), their cumulative offsets and scatter indices in numpy, and copies
them into one preallocated buffer, which becomes the data of an Arrow string column
without another copy: its offsets are the conversation boundaries.  A conversation that
crosses a batch or a task boundary comes as several parts with ascending ``part``.

Template, per turn:  <|im_start|>ROLE \\n TEXT <|im_end|> \\n
Control strings inside a role or text are escaped by one backslash between ``<`` and
``|`` (after those that are there already), which is undone exactly; a role's line
breaks and backslashes are escaped too, because a line break ends the header.

``loss`` has the code point ranges of the (escaped) assistant texts inside the part.

Defined results: null roles and texts are empty; rows with equal turns are ordered by
role and text, null first; rows without a conversation id form one conversation of
their own; repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.words import slices, utf8

# The template's marks, and the role whose texts are learned.
START, END, LEARNED = "<|im_start|>", "<|im_end|>\n", "assistant"
PARTS = "conv_id bigint, part bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"


def escape(column: pa.Array, is_role: bool = False) -> pa.Array:
    column = pc.fill_null(column.cast(pa.string()), "")
    if is_role:
        column = pc.replace_substring(column, "\\", "\\\\")
        column = pc.replace_substring(column, "\n", "\\n")
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str, is_role: bool = False) -> str:
    text = re.sub(r"<\\(\\*)\|", r"<\1|", text)
    if is_role:
        text = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)
    return text


def _scatter(out: np.ndarray, at: np.ndarray, column: pa.Array) -> None:
    """Copies each row's bytes to its place."""
    data, rows = utf8(column)
    if len(data):
        out[np.repeat(at - rows[:-1], np.diff(rows)) + np.arange(len(data))] = data


def assemble(batch: pa.RecordBatch, part: int) -> pa.RecordBatch:
    """The conversations of a sorted batch, as PARTS columns."""
    role = escape(batch.column("role"), is_role=True)
    text = escape(batch.column("text"))
    start = np.frombuffer(START.encode(), np.uint8)
    end = np.frombuffer(END.encode(), np.uint8)
    of_role = pc.binary_length(role).to_numpy(zero_copy_only=False).astype(np.int64)
    of_text = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = len(start) + of_role + 1 + of_text + len(end)
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    out = np.empty(at[-1], np.uint8)
    role_at = at[:-1] + len(start)
    text_at = role_at + of_role + 1
    out[at[:-1, None] + np.arange(len(start))] = start
    _scatter(out, role_at, role)
    out[text_at - 1] = ord("\n")
    _scatter(out, text_at, text)
    out[(text_at + of_text)[:, None] + np.arange(len(end))] = end

    ids = batch.column("conv_id")
    known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    empty = ids.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(known), bool)
    new[1:] = (known[1:] != known[:-1]) | (empty[1:] != empty[:-1])
    heads = np.flatnonzero(new)
    bounds = np.append(heads, len(known))
    formatted = pa.StringArray.from_buffers(
        len(heads), pa.py_buffer(at[bounds].astype(np.int32)), pa.py_buffer(out)
    )
    points = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    owner = np.cumsum(new) - 1
    learned = np.flatnonzero(pc.equal(role, LEARNED).to_numpy(zero_copy_only=False))
    base = points[at[heads]][owner[learned]]
    spans = pa.StructArray.from_arrays(
        [
            pa.array(points[text_at[learned]] - base),
            pa.array(points[(text_at + of_text)[learned]] - base),
        ],
        names=["start", "end"],
    )
    loss = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(learned, bounds).astype(np.int32)), spans
    )
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(heads)),
            pa.array(np.arange(part, part + len(heads))),
            pa.array(np.diff(bounds)),
            formatted,
            loss,
        ],
        names=["conv_id", "part", "n_turns", "formatted", "loss"],
    )


def format_chat(conversations: DataFrame) -> DataFrame:
    """Parts of formatted conversations from (conv_id, turn, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                made = assemble(batch, part)
                part += made.num_rows
                yield made

    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    order = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order).mapInArrow(run, PARTS)


def parse_part(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted part."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape(role, is_role=True), unescape(rest.removesuffix(END))))
    return turns


def conversation_digests(parts: DataFrame) -> DataFrame:
    """Reads the parts of each conversation in order, as a stream, and digests them.

    SHA-256 runs over a conversation from front to back, so one task reads one
    conversation; it holds one batch and two hash states, however long that is.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = ["bigint", "bigint", "string", "bigint", "string", "bigint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state:
                        done.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse_part(row["formatted"])
                state[1] += len(turns)
                for role, text in turns:
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(row["formatted"][span["start"] : span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(row["formatted"])
            yield _rows(done, names)
        if state:
            yield _rows([state], names)

    return (
        parts.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    )


def _rows(states: list[list], names: list[str]) -> pa.RecordBatch:
    rows = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in s] for s in states]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names
    )
