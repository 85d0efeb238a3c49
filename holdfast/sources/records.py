"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks.

A line break ends a record only outside quotes, and whether a place is inside quotes depends on
all that stands before it.  So files are read as lines, which can be split anywhere:

1. For each input split a task finds out in which state (outside or inside quotes) it would end
   from either state it may begin in: a function of two values.  The driver composes these
   along each file.  It also gets the end of a record that may be open at the start of a split,
   if that is short.
2. With its true first state known, each split puts its lines together to records.  A record
   that goes on in the next split is completed with the end found there.  Where an end is long,
   or records go over whole splits, they are handed on in parts instead, at most two per split,
   and joined.

Tasks work on whole batches of lines as arrays; no step is taken per line or per character.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTSIDE, INSIDE = 0, 1
OPENING = re.compile(r'(?:^|,)[ \t]*"')
QUOTE, COMMA, SPACE, TAB = b'", \t'
LINE_BREAK = pa.scalar("\n", pa.large_string())
# A piece of a record that has more bytes does not go to the driver with the states of its split.
PIECE_BYTES = 4096


def state_after(line: str, state: int) -> int:
    """The state at the end of a line.  A quote opens at the start of a field only; inside, a
    doubled quote is a character."""
    if '"' not in line:
        return state
    at, first = 0, state == OUTSIDE
    while True:
        if state == OUTSIDE:
            # after a closing quote the next field begins at a comma
            found = OPENING.search(line, at) if first or at else None
            if not found or (found.start() == 0 and not first):
                return OUTSIDE
            at, state = found.end(), INSIDE
        else:
            end = line.find('"', at)
            if end < 0:
                return INSIDE
            if line.startswith('""', end):
                at = end + 2
            else:
                at, state, first = end + 1, OUTSIDE, False


def line_states(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``state_after`` gives at the end of each line, for both states before the first one.

    Returns per line a state and whether it holds for either of them; where it does not, it is
    the one that follows from OUTSIDE, and INSIDE gives the other.

    Quotes that touch are one event.  An even number of them changes nothing.  An odd number
    at the start of a field opens or closes; elsewhere it closes or is text, so that the state
    is OUTSIDE after it.
    """
    count = len(lines)
    _, starts, content = lines.buffers()
    none = np.zeros(count, np.int8), np.zeros(count, bool)
    if not count or content is None:
        return none
    starts = np.frombuffer(starts, np.int64)[lines.offset : lines.offset + count + 1]
    data = np.frombuffer(content, np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    quotes = np.flatnonzero(data == QUOTE)
    if not quotes.size:
        return none
    line = np.searchsorted(starts[1:], quotes, side="right")
    heads = np.flatnonzero(np.append(True, (np.diff(quotes) != 1) | (np.diff(line) != 0)))
    odd = heads[np.diff(np.append(heads, quotes.size)) % 2 == 1]
    if not odd.size:
        return none
    line, begin, before = line[odd], starts[line[odd]], quotes[odd] - 1
    blank = (data == SPACE) | (data == TAB)
    if blank[np.maximum(before, 0)].any():
        solid = np.maximum.accumulate(np.where(blank, -1, np.arange(data.size)))
        before = np.where(before < 0, -1, solid[np.maximum(before, 0)])
    field = (before < begin) | (data[np.maximum(before, 0)] == COMMA)
    turns = np.cumsum(field)
    reset = np.maximum.accumulate(np.where(field, -1, np.arange(field.size)))
    state = (turns - np.where(reset < 0, 0, turns[np.maximum(reset, 0)])) & 1
    last = np.searchsorted(line, np.arange(count), side="right") - 1
    none_yet = last < 0
    return np.where(none_yet, 0, state[last]).astype(np.int8), ~none_yet & (reset[last] >= 0)


def _true_states(lines: pa.Array, state: int) -> np.ndarray:
    after, fixed = line_states(lines)
    return np.where(fixed, after, after ^ state)


def _joined(lines: list[pa.Array]) -> str:
    return "\n".join(line for part in lines for line in part.to_pylist())


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Each line behind the start and file of its split and a line break: one text goes to Python
    at half the cost of three columns.  The file is written as a URL, so it has no line breaks."""
    rows = spark.read.option("lineSep", "\n").text(path)
    start, file = F.col("_metadata.file_block_start").cast("string"), F.col("_metadata.file_path")
    return rows.select(F.concat(start, F.lit(" "), file, F.lit("\n"), "value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Consecutive lines of one split, batch by batch."""
    for batch in batches:
        left = batch.column(0).cast(pa.large_binary())
        while len(left):
            prefix = left[0].as_py().partition(b"\n")[0]
            start, _, file = prefix.decode().partition(" ")
            same = pc.starts_with(left, prefix + b"\n")
            mixed = not pc.all(same).as_py()
            lines = pc.binary_replace_slice(left.filter(same) if mixed else left, 0, len(prefix) + 1, b"")
            yield (file, int(start)), lines.view(pa.large_string())
            left = left.filter(pc.invert(same)) if mixed else left.slice(len(left))


class _Piece:
    """The lines of one split up to the first end of a record, unless they are long."""

    def __init__(self) -> None:
        self.held: list[pa.Array] = []
        self.size, self.open, self.text = 0, True, None

    def add(self, lines: pa.Array, states: np.ndarray) -> None:
        if not self.open:
            return
        ends = np.flatnonzero(states == OUTSIDE)
        part = lines.slice(0, int(ends[0]) + 1) if ends.size else lines
        self.held.append(part)
        self.size += pc.sum(pc.binary_length(part)).as_py() + len(part)
        self.open = self.size <= PIECE_BYTES and not ends.size
        if not self.open:
            self.text = _joined(self.held) if self.size <= PIECE_BYTES else None
            self.held = []


def _ends(lines: DataFrame) -> DataFrame:
    """(file, start, from_outside, from_inside, closes, head, rest): the last state for both first
    states, whether a record that is open at the start ends here, the first record of a file, and
    the end of a record that is open at the start.  The texts are null where they are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, closes, head, rest, out = None, [OUTSIDE, INSIDE], False, _Piece(), _Piece(), []
        for name, values in _runs(batches):
            if name != key:
                if key:
                    out.append((*key, *states, closes, head.text, rest.text))
                key, states, closes, head, rest = name, [OUTSIDE, INSIDE], False, _Piece(), _Piece()
                head.open = name[1] == 0
            after, fixed = line_states(values)
            outside, inside = (np.where(fixed, after, after ^ state) for state in states)
            head.add(values, outside)
            rest.add(values, inside)
            closes = closes or bool((inside == OUTSIDE).any())
            states = [int(outside[-1]), int(inside[-1])]
        if key:
            out.append((*key, *states, closes, head.text, rest.text))
        names = ["file", "start", "from_outside", "from_inside", "closes", "head", "rest"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "file string, start long, from_outside int, from_inside int, closes boolean, head string, rest string"
    return lines.mapInArrow(run, schema)


def first_states(splits: list[tuple]) -> tuple[dict[tuple[str, int], tuple[int, int]], list[str]]:
    """Per split its first state and the split where the record that is open there began, and
    the files that end inside quotes."""
    found, broken = {}, []
    files = defaultdict(list)
    for file, start, *rest in splits:
        files[file].append((start, *rest))
    for file, parts in files.items():
        state, owner = OUTSIDE, -1
        for start, from_outside, from_inside, closes in sorted(parts):
            found[file, start] = (state, owner)
            if state == OUTSIDE or closes:
                owner = start  # the last record that is open after this split began in it
            state = from_inside if state == INSIDE else from_outside
        if state == INSIDE:
            broken.append(file)
    return found, broken


def _whole(
    lines: DataFrame, states: dict[tuple[str, int], tuple[int, int]], rests: dict[tuple[str, int], str]
) -> DataFrame:
    """(file, first, record): the records that begin in a split and end there or with the text
    that ``rests`` has for it."""

    def made(file: str, first: bool, records: pa.Array) -> pa.RecordBatch:
        firsts = np.zeros(len(records), bool)
        firsts[:1] = first
        columns = [pa.repeat(pa.scalar(file, pa.string()), len(records)), pa.array(firsts), records.cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "first", "record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, foreign, first, held = None, OUTSIDE, False, False, []

        def last() -> Iterator[pa.RecordBatch]:
            if held and key in rests:
                yield made(key[0], first, pa.array([_joined(held) + "\n" + rests[key]], pa.large_string()))

        for name, values in _runs(batches):
            if name != key:
                yield from last()
                key, state, first, held = name, states[name][0], name[1] == 0, []
                foreign = state == INSIDE  # the open record began in a split before
            after = _true_states(values, state)
            state, ends = int(after[-1]), np.flatnonzero(after == OUTSIDE) + 1
            if not ends.size:
                if not foreign:
                    held.append(values)
                continue
            records = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), LINE_BREAK)
            if not foreign:
                begun = _joined([*held, values.slice(0, int(ends[0]))])
                records = pa.concat_arrays([pa.array([begun], pa.large_string()), records])
            if len(records):
                yield made(key[0], first and not foreign, records)
            first, foreign = False, False
            held = [values.slice(int(ends[-1]))] if ends[-1] < len(values) else []
        yield from last()

    return lines.mapInArrow(run, "file string, first boolean, record string")


def _cut(lines: DataFrame, states: dict[tuple[str, int], tuple[int, int]]) -> DataFrame:
    """(file, first, record): the records that go over the end of a split, joined from their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, owner, first, held, made = None, OUTSIDE, -1, False, [], []

        def row(group: int, first: bool) -> None:
            made.append((*key, group, first, _joined(held)))
            held.clear()

        def rows() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            columns = [pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "start", "owner", "first", "record"])

        for name, values in _runs(batches):
            if name != key:
                if held:  # goes on in the next split
                    row(key[1] if owner < 0 else owner, first)
                    yield rows()
                key, first = name, name[1] == 0
                state, owner = states[name]
                if state == OUTSIDE:
                    owner = -1
            after = _true_states(values, state)
            state, ends = int(after[-1]), np.flatnonzero(after == OUTSIDE) + 1
            if not ends.size:
                held.append(values)
                continue
            if owner >= 0:
                held.append(values.slice(0, int(ends[0])))
                row(owner, False)
                yield rows()
            first, owner = False, -1
            held = [values.slice(int(ends[-1]))] if ends[-1] < len(values) else []
        if held:
            row(key[1] if owner < 0 else owner, first)
            yield rows()

    return (
        lines.mapInArrow(run, "file string, start long, owner long, first boolean, record string")
        .groupBy("file", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("start", "first", "record"))).alias("parts"))
        .select(
            "file",
            F.exists("parts", lambda p: p["first"]).alias("first"),
            F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
        )
    )


def records_and_heads(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """The rows of ``csv_records``, and the different first records of the files."""
    lines = _lines(spark, path)
    splits = [tuple(r) for r in _ends(lines).collect()]
    states, broken = first_states([split[:-2] for split in splits])
    if broken:
        raise ValueError(f"quotes are not closed at the end of {sorted(broken)[:3]}")
    begun_before = [(file, states[file, start][1], rest) for file, start, *_, rest in splits if states[file, start][0] == INSIDE]
    if any(rest is None for *_, rest in begun_before):
        records = _whole(lines, states, {}).unionByName(_cut(lines, states))
    else:
        records = _whole(lines, states, {(file, owner): rest for file, owner, rest in begun_before})
    heads = {head for _, start, *_, head, _ in splits if start == 0}
    if None in heads:  # one is long or goes over the end of a split
        rows = records.where("first").select("record").distinct().limit(50)
        heads = {r["record"] for r in rows.collect()}
    return records, sorted(heads)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, first, record): each record as text, ``first`` for the first one of a file."""
    return records_and_heads(spark, path)[0]
