"""Merging rows of one id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import quoted

#: Columns in which rows combine; in all others the last value that isn't null counts.
COMBINED = {"first_observed": F.min, "last_observed": F.max, "number_observed": F.sum}


def merged(rows: DataFrame, key: str, order: str, combine: bool = True) -> DataFrame:
    """One row for each key: one shuffle, aggregated before it. combine: False if the last value counts in all columns."""
    columns = [c for c in rows.columns if c not in (key, order)]
    last = lambda c: F.max_by(F.col(quoted(c)), F.when(F.col(quoted(c)).isNotNull(), F.col(quoted(order))))
    aggs = [(COMBINED[c](F.col(quoted(c))) if combine and c in COMBINED else last(c)).alias(c) for c in columns]
    return rows.groupBy(key).agg(*aggs) if aggs else rows.select(key).distinct()
