"""Numbers that come out the same whatever the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 1_000_000


def exact_mean(value: Column) -> Column:
    """Aggregate: mean of the non-null values, summed in millionths as whole numbers."""
    return F.sum(F.round(value * UNIT).cast("long")) / F.count(value) / F.lit(float(UNIT))


def decimal_mean(value: Column) -> Column:
    """Aggregate: mean of the non-null values, summed as decimal numbers of 18 places; keeps what millionths would cut."""
    return F.sum(value.cast("decimal(28,18)")).cast("double") / F.count(value)
