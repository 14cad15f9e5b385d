"""Set algebra on rows, for sets too large or too uneven to live in one array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key how many values went missing, came in and stayed.  Both inputs hold distinct rows."""
    tagged = before.select(*keys, value, F.lit(1).alias("side")).unionByName(after.select(*keys, value, F.lit(2).alias("side")))
    sides = tagged.groupBy(*keys, value).agg(F.bit_or("side").alias("sides"))
    return sides.groupBy(*keys).agg(
        F.count_if(F.col("sides") == 1).alias("missing"),
        F.count_if(F.col("sides") == 2).alias("introduced"),
        F.count_if(F.col("sides") == 3).alias("common"),
    )


def missing_values(required: DataFrame, supplied: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Required rows that are not supplied."""
    return required.join(supplied, [*keys, value], "left_anti")


def unknown_references(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` that are not known; a caller raises when there are any."""
    return rows.select(column).distinct().join(known, column, "left_anti")


def require_known(rows: DataFrame, known: DataFrame, column: str, what: str) -> None:
    unknown = [r[0] for r in unknown_references(rows, known, column).orderBy(column).limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown {what}: {', '.join(map(str, unknown))}")


def union_of_tests(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct tests per key, one row each."""
    return rows.select(*keys, "test").distinct()
