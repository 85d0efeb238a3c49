"""Small frames for the edge cases."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F


def when(text: str) -> datetime:
    return datetime.fromisoformat(text)


def order_fact(spark, rows):
    """Order fact from (person, order, time, value[, items, categories])."""
    full = [(*row, 1, 1) if len(row) == 4 else row for row in rows]
    df = spark.createDataFrame(
        [(p, o, t, str(v), i, c) for p, o, t, v, i, c in full],
        "customer_unique_id string, order_id string, t string, v string, items_count long, "
        "category_diversity long",
    )
    return df.select(
        "customer_unique_id",
        "order_id",
        F.col("t").cast("timestamp_ntz").alias("order_purchase_timestamp"),
        F.col("v").cast("decimal(12,2)").alias("gross_order_value"),
        "items_count",
        "category_diversity",
    )


def as_dict(df, key, *cols):
    out = {}
    for row in df.collect():
        assert row[key] not in out, f"{row[key]} occurs twice"
        out[row[key]] = row[cols[0]] if len(cols) == 1 else tuple(row[c] for c in cols)
    return out
