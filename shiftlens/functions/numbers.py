"""Division, rounding and small formats shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_null(part: Column, whole: Column) -> Column:
    """NULL when there is nothing to divide by, so that means skip the row."""
    return part.cast("double") / F.nullif(whole, F.lit(0))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """0.0 when there is nothing to divide by, so that means count the row."""
    return F.coalesce(ratio_or_null(part, whole), F.lit(0.0))


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding with NULL read as 0, as the report writer rounds."""
    return F.bround(F.coalesce(value, F.lit(0.0)), digits)


def passed_of_total(passed: Column, total: Column) -> Column:
    """``passed/total``, or a dash when no test ran."""
    text = F.concat(passed.cast("string"), F.lit("/"), total.cast("string"))
    return F.when(total > 0, text).otherwise(F.lit("-"))
