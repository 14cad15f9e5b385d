"""Ordered running values that do not put a whole key into one task.

``Window.partitionBy(key)`` sorts all rows of a key in one task, which fails once a key holds a
large share of the table.  Here the rows are cut into ranges of (key, order), each range is scanned
by itself, and what a range needs from the ranges before it comes from a table with one row per key
and range.  A key smaller than a range stays whole, so that table has about as many rows as there
are keys plus ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SAMPLES_PER_RANGE = 16


@dataclass(frozen=True)
class Running:
    """How one output is computed: within a range, per range, across ranges, and combined."""

    inner: Callable
    summary: Callable
    carry: Callable
    combine: Callable


def running_sum(value: Column, *, inclusive: bool = True) -> Running:
    last = 0 if inclusive else -1
    return Running(
        inner=lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, last)),
        summary=lambda order: F.sum(value),
        carry=lambda s, w: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        combine=lambda inner, carry: F.coalesce(inner, F.lit(0)) + F.coalesce(carry, F.lit(0)),
    )


def ordinal() -> Running:
    """1-based position of the row within its key."""
    return running_sum(F.lit(1).cast("long"))


def running_max(value: Column, *, inclusive: bool = True) -> Running:
    last = 0 if inclusive else -1
    return Running(
        inner=lambda w: F.max(value).over(w.rowsBetween(Window.unboundedPreceding, last)),
        summary=lambda order: F.max(value),
        carry=lambda s, w: F.max(s).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        combine=lambda inner, carry: F.greatest(inner, carry),
    )


def previous(value: Column) -> Running:
    """The value of the row before, NULL on the first row of a key."""
    return Running(
        inner=lambda w: F.lag(F.struct(value.alias("v"))).over(w),
        summary=lambda order: F.max_by(F.struct(value.alias("v")), order),
        carry=lambda s, w: F.lag(s).over(w),
        combine=lambda inner, carry: F.coalesce(inner, carry)["v"],
    )


def following(value: Column) -> Running:
    """The value of the row after, NULL on the last row of a key."""
    return Running(
        inner=lambda w: F.lead(F.struct(value.alias("v"))).over(w),
        summary=lambda order: F.min_by(F.struct(value.alias("v")), order),
        carry=lambda s, w: F.lead(s).over(w),
        combine=lambda inner, carry: F.coalesce(inner, carry)["v"],
    )


def last_seen(value: Column) -> Running:
    """The newest non-NULL value up to and including the row."""
    return Running(
        inner=lambda w: F.last(value, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)
        ),
        summary=lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        carry=lambda s, w: F.last(s, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)
        ),
        combine=lambda inner, carry: F.coalesce(inner, carry),
    )


def _range_count(df: DataFrame) -> int:
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_bounds(df: DataFrame, position: Column, ranges: int) -> DataFrame:
    """One row with the sorted range bounds.

    The row with the smallest hash in each of ``ranges * 16`` hash slots is a uniform sample that
    is found by a map-side minimum, so its size does not depend on the number of input partitions.
    """
    slots = ranges * _SAMPLES_PER_RANGE
    sample = (
        df.select(position.alias("position"))
        .withColumn("hash", F.xxhash64("position"))
        .groupBy(F.pmod("hash", F.lit(slots)).alias("slot"))
        .agg(F.min_by("position", "hash").alias("position"))
    )
    bounds = sample.agg(F.array_sort(F.collect_list("position")).alias("sorted"))
    return bounds.select(
        F.filter("sorted", lambda _, i: i % _SAMPLES_PER_RANGE == _SAMPLES_PER_RANGE - 1).alias("bounds")
    )


def _with_range(df: DataFrame, position: Column, bounds: Column, ranges: int) -> DataFrame:
    """Add ``_range``, the number of bounds at or below ``position``, by binary search.

    One projection per halving keeps the search inside generated code; inside a lambda the bounds
    would have to travel with every row.
    """
    step = 1 << max(0, ranges.bit_length() - 1)
    df = df.withColumn("_range", F.lit(0))
    while step:
        at = F.col("_range")
        hit = F.get(bounds, at + F.lit(step - 1)) <= position
        df = df.withColumn("_range", F.when(hit, at + F.lit(step)).otherwise(at))
        step //= 2
    return df


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, Running],
    *,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``outputs`` to ``df``, computed per ``keys`` in ascending ``order``.

    ``order`` should be unique within a key, as for any window whose result must be repeatable.
    """
    ranges = ranges or _range_count(df)
    keys, order = list(keys), list(order)
    position = F.struct(*[F.col(c) for c in [*keys, *order]])
    order_value = F.struct(*[F.col(c) for c in order])

    bounds = _range_bounds(df, position, ranges).scalar()
    cut = _with_range(df, position, bounds, ranges)

    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_range")

    per_range = cut.groupBy(*keys, "_range").agg(
        *[spec.summary(order_value).alias(f"_s_{name}") for name, spec in outputs.items()]
    )
    carried = per_range.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_k__range"),
        *[spec.carry(F.col(f"_s_{name}"), across).alias(f"_c_{name}") for name, spec in outputs.items()],
    )
    scanned = cut.select(
        "*", *[spec.inner(within).alias(f"_i_{name}") for name, spec in outputs.items()]
    )
    same = F.col("_range") == F.col("_k__range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = scanned.join(carried, same, "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in outputs],
        *[
            spec.combine(F.col(f"_i_{name}"), F.col(f"_c_{name}")).alias(name)
            for name, spec in outputs.items()
        ],
    )
