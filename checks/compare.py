"""Runs registered queries next to their SQL and compares every value.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import QUERIES
from checks.oracles import SQL

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf: str, name: str) -> list[str]:
    """What differs between a query and its SQL: columns, types, or rows (any order)."""
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in SQL:
        return []
    con.execute(SQL[name])
    theirs = [d[0] for d in con.description]
    if sorted(df.columns) != sorted(theirs):
        return [f"columns {sorted(df.columns)} against {sorted(theirs)}"]
    order = sorted(df.columns)
    at = [theirs.index(c) for c in order]
    mine = Counter(tuple(repr(row[c]) for c in order) for row in rows)
    other = Counter(tuple(repr(row[i]) for i in at) for row in con.fetchall())
    notes = []
    if sum(mine.values()) != sum(other.values()):
        notes.append(f"rows {sum(mine.values())} against {sum(other.values())}")
    missing, extra = other - mine, mine - other
    if missing or extra:
        notes.append(f"{sum(extra.values())} rows differ in {order}")
        notes += [f"  mine   {row}" for row in sorted(extra)[:2]]
        notes += [f"  theirs {row}" for row in sorted(missing)[:2]]
    return notes


def main(argv: list[str]) -> int:
    from holdfast.session import local_session

    sf, names = argv[0], argv[1:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in names:
        begin = time.time()
        try:
            notes = differences(spark, con, sf, name)
        except Exception as error:  # report every query, then fail
            text = str(error)
            cause = text.find("Caused by")
            notes = [text[:700], text[cause : cause + 1500] if cause > 0 else ""]
        failed += bool(notes)
        kind = "rows only" if name not in SQL else "ok"
        print(f"{name}: {'DIFFERS' if notes else kind} {time.time() - begin:.1f}s", flush=True)
        for note in notes:
            print(f"    {note}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
