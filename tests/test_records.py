"""Files with line breaks inside quotes, cut into many splits, against the whole-file read."""

from __future__ import annotations

import csv
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.sources import csv as csv_source
from holdfast.sources import records
from holdfast.sources.contracts import schema_of

PIECES = ["plain", 'say ""hi""', "two\nlines", ",", "\n", "\n\n", '""', "ä\r\nö", "x" * 50, "a, b", "", "5 inch"]


def review_file(path, rows, ending, seed):
    rng = random.Random(seed)
    names = [f.name for f in schema_of("order_reviews").fields]
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(",".join(names) + ending)
        for k in range(rows):
            values = []
            for f in schema_of("order_reviews").fields:
                kind = f.dataType.simpleString()
                if kind == "string":
                    body = "".join(rng.choice(PIECES) for _ in range(rng.randrange(5)))
                    values.append(f'"{body}"' if body or rng.random() < 0.5 else "")
                elif kind.startswith("timestamp"):
                    values.append(f"2018-01-{1 + k % 28:02d} 10:00:00")
                else:
                    values.append(str(k % 5 + 1))
            out.write(",".join(values) + (ending if k < rows - 1 or seed % 2 else ""))


def whole(spark, path):
    contract = schema_of("order_reviews")
    reader = spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST").option("multiLine", True)
    return sorted(map(repr, reader.schema(contract).csv(path).collect()))


@pytest.mark.parametrize(("ending", "seed"), [("\n", 1), ("\n", 2), ("\r\n", 3)])
def test_many_splits_equal_the_whole_file(spark, tmp_path, ending, seed):
    path = str(tmp_path / "order_reviews.csv")
    review_file(path, 300, ending, seed)
    expected = whole(spark, path)
    assert len(expected) == 300
    for size in ("500", "2000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            found = csv_source.read_csv(spark, "order_reviews", path)
            assert sorted(map(repr, found.collect())) == expected
            if size == "2000":
                assert records._lines(spark, path).rdd.getNumPartitions() > 10
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_files_and_different_headers(spark, tmp_path):
    folder = tmp_path / "reviews"
    folder.mkdir()
    for k in range(3):
        review_file(folder / f"part{k}.csv", 40, "\n", k)
    assert csv_source.read_csv(spark, "order_reviews", str(folder)).count() == 120
    text = (folder / "part1.csv").read_text(encoding="utf-8").split("\n", 1)
    names = text[0].split(",")
    (folder / "part1.csv").write_text(",".join(reversed(names)) + "\n" + text[1], encoding="utf-8")
    with pytest.raises(ValueError, match="different headers"):
        csv_source.read_csv(spark, "order_reviews", str(folder)).count()


def test_an_open_quote_at_the_end_is_an_error(spark, tmp_path):
    path = tmp_path / "order_reviews.csv"
    review_file(path, 5, "\n", 1)
    path.write_text(path.read_text(encoding="utf-8") + '"never closed\n', encoding="utf-8")
    with pytest.raises(ValueError, match="not closed"):
        csv_source.read_csv(spark, "order_reviews", str(path)).count()


FIELD = st.sampled_from(["a", "", '"a"', '"a,b"', '"say ""x"""', '"line\nbreak"', '"\n"', '""', 'in"ch', '"a\n""\nb"'])


@given(st.lists(st.lists(FIELD, min_size=1, max_size=4), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_states_follow_the_records(rows):
    text = "\n".join(",".join(r) for r in rows)
    state, ends = records.OUTSIDE, 0
    for line in text.split("\n"):
        state = records.state_after(line, state)
        ends += state == records.OUTSIDE
    assert state == records.OUTSIDE and ends == len(rows)
    assert ends >= len(list(csv.reader(text.split("\n"))))


def test_states_compose_along_a_file():
    lines = ['a,"x', "y", 'z"', 'b,"c"', '"d', '', '",e']
    for cut in range(1, len(lines)):
        parts, start = [], 0
        for part in (lines[:cut], lines[cut:]):
            last = []
            closes = False
            for first in (records.OUTSIDE, records.INSIDE):
                state = first
                for line in part:
                    state = records.state_after(line, state)
                    closes |= first == records.INSIDE and state == records.OUTSIDE
                last.append(state)
            parts.append(("f", start, *last, closes))
            start += 100
        found, broken = records.first_states(parts)
        state = records.OUTSIDE
        for line in lines[:cut]:
            state = records.state_after(line, state)
        assert not broken and found["f", 100][0] == state


@given(st.lists(st.text('",\t \ra', max_size=9), min_size=1, max_size=6), st.integers(0, 2))
@settings(max_examples=500, deadline=None)
def test_states_of_a_batch_are_those_line_by_line(lines, before):
    batch = pa.array(['"x'] * before + lines + ['y"'], pa.large_string()).slice(before, len(lines))
    after, fixed = records.line_states(batch)
    for state in (records.OUTSIDE, records.INSIDE):
        expected, at = [], state
        for line in lines:
            at = records.state_after(line, at)
            expected.append(at)
        assert [int(a) if f else int(a) ^ state for a, f in zip(after, fixed, strict=True)] == expected


@pytest.mark.parametrize(("size", "piece"), [("300", 4096), ("700", 4096), ("300", 40), ("37", 4096)])
def test_records_over_split_ends(spark, tmp_path, monkeypatch, size, piece):
    """Ends of records that come with the states, long ones, and records over whole splits."""
    monkeypatch.setattr(records, "PIECE_BYTES", piece)
    path = tmp_path / "order_reviews.csv"
    review_file(path, 60, "\n", 5)
    expected = whole(spark, str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = csv_source.read_csv(spark, "order_reviews", str(path))
        assert sorted(map(repr, found.collect())) == expected
        firsts = records.csv_records(spark, str(path)).where("first").select("record").collect()
        assert [r["record"] for r in firsts] == [path.read_text(encoding="utf-8").split("\n")[0]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_go_to_python_twice(spark, tmp_path, monkeypatch):
    """Once for the states and once for the records, however the headers are compared."""
    path = tmp_path / "order_reviews.csv"
    review_file(path, 60, "\n", 5)
    passes, lines = [], records._lines

    def counted(*args):
        rows = lines(*args)
        send = rows.mapInArrow
        monkeypatch.setattr(rows, "mapInArrow", lambda *a: passes.append(1) or send(*a), raising=False)
        return rows

    monkeypatch.setattr(records, "_lines", counted)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = csv_source.read_csv(spark, "order_reviews", str(path))
        plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("MapInArrow") == 1 and len(passes) == 2
        assert found.count() == 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
