"""The series that an operator works on, with its checks, frames and emission gates."""

from __future__ import annotations

import numbers
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of helper columns; they never reach a result.
OWN = "__frameflow_"


def names(columns: str | Sequence[str] | None) -> list[str]:
    return [] if columns is None else [columns] if isinstance(columns, str) else list(columns)


def whole(value, what: str, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, numbers.Integral) or value < least:
        raise ValueError(f"{what} must be an integer of at least {least}, not {value!r}")
    return int(value)


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raises before any job runs: every value column must be numeric."""
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, T.NumericType):
            raise ValueError(f"{c} is {kind.simpleString()}, not numeric")


@dataclass(frozen=True)
class Series:
    """Order and, for many series in one table, partition columns; a frame is the last window rows of a series, or all so far."""

    order_by: Sequence[str]
    partition_by: Sequence[str] = ()
    window: int | None = None
    min_periods: int | None = None

    @classmethod
    def rolling(cls, order_by, partition_by, window, min_periods) -> Series:
        if not names(order_by):
            raise ValueError("order_by is needed: rows of a table have no order of their own")
        w = whole(window, "window", 1)
        mp = w if min_periods is None or min_periods == -1 else whole(min_periods, "min_periods", 0)
        return cls(names(order_by), names(partition_by), w, mp)

    @classmethod
    def expanding(cls, order_by, partition_by, min_periods, default) -> Series:
        if not names(order_by):
            raise ValueError("order_by is needed: rows of a table have no order of their own")
        mp = default if min_periods is None or min_periods == -1 else whole(min_periods, "min_periods", 0)
        return cls(names(order_by), names(partition_by), None, mp)

    def spec(self, extra: Sequence[str] = ()) -> WindowSpec:
        return Window.partitionBy(*self.partition_by, *extra).orderBy(*self.order_by)

    def frame(self, extra: Sequence[str] = ()) -> WindowSpec:
        start = Window.unboundedPreceding if self.window is None else -(self.window - 1)
        return self.spec(extra).rowsBetween(start, 0)


def clean(m: Column, valid: Column, mp: int) -> Column:
    """Every position of the frame is valid, and there are enough of them."""
    return (valid == m) & (m >= mp)


def enough(valid: Column, mp: int) -> Column:
    """Enough valid values, and at least one; invalid ones are skipped."""
    return (valid >= mp) & (valid > 0)
