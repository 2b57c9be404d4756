"""One class of invalid values: NULL, NaN and both infinities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x as a double, NULL where it is not a finite number. Aggregates then skip what is invalid."""
    d = x.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def nan_if_null(x: Column) -> Column:
    """NaN where nothing is emitted, for callers who expect arrays without NULLs."""
    return F.coalesce(x, F.lit(float("nan")))
