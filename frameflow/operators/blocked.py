"""Rolling aggregates whose cost does not grow with the window.

A series is cut into blocks of window rows. P aggregates a block from its start to the row, S from the row to its end; both are growing frames, which
Spark extends by one row at a time. A frame is S of the row window - 1 before, joined with P of the row itself. Both partition by block, so
they run in parallel inside a series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, nan_if_null
from ..plans.frames import OWN, Series, check_columns, clean, enough

#: name of a part -> (aggregate, join of the two sides)
Parts = dict[str, tuple[Callable[[Column], Column], Callable[..., Column]]]

_ADD = lambda p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0))


class Kind:
    """What to aggregate on each side, and the value of both sides together."""

    def __init__(self, parts: dict[str, Callable[[Column], Column]], value: Callable[[dict[str, Column], dict[str, Column], Column], Column]):
        self.parts, self.value = parts, value


total = Kind({"sum": F.sum}, lambda p, q, n: _ADD(p["sum"], q["sum"]))
mean = Kind({"sum": F.sum}, lambda p, q, n: _ADD(p["sum"], q["sum"]) / n)
least = Kind({"min": F.min}, lambda p, q, n: F.least(p["min"], q["min"]))
greatest = Kind({"max": F.max}, lambda p, q, n: F.greatest(p["max"], q["max"]))


def variance(ddof: int, root: bool) -> Kind:
    """Squared deviations of both sides, joined by the pairwise update of Chan, Golub and LeVeque."""

    def value(p, q, n):
        np_, nq = F.coalesce(p["n"], F.lit(0)), F.coalesce(q["n"], F.lit(0))
        both = (np_ > 0) & (nq > 0)
        gap = F.when(both, F.pow(q["mean"] - p["mean"], 2) * np_ * nq / (np_ + nq)).otherwise(F.lit(0.0))
        spread = F.coalesce(p["var"] * np_, F.lit(0.0)) + F.coalesce(q["var"] * nq, F.lit(0.0)) + gap
        var = F.when(n > ddof, spread / (n - ddof))
        return F.sqrt(var) if root else var

    return Kind({"mean": F.avg, "var": F.var_pop}, value)


def append(df: DataFrame, series: Series, x: str, output: str, kind: Kind, skip_nan: bool, nan_output: bool) -> DataFrame:
    check_columns(df, [x])
    w, own = series.window, lambda name: f"{OWN}{name}"
    number, block, v = own("number"), own("block"), own("x")
    rows = df.withColumn(number, F.row_number().over(series.spec()) - 1).withColumn(v, finite(F.col(f"`{x}`")))
    rows = rows.withColumn(block, F.floor(F.col(number) / w))
    ahead = Window.partitionBy(*series.partition_by, block).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*series.partition_by, block).orderBy(F.desc(number)).rowsBetween(Window.unboundedPreceding, 0)
    parts = {"n": F.count, **kind.parts}
    rows = rows.withColumns({own(f"p_{k}"): f(F.col(v)).over(ahead) for k, f in parts.items()})
    rows = rows.withColumns({own(f"s_{k}"): f(F.col(v)).over(back) for k, f in parts.items()})
    line = Window.partitionBy(*series.partition_by).orderBy(number)
    inside = F.col(number) % w == w - 1  # the frame is the block so far
    rows = rows.withColumns({own(f"q_{k}"): F.when(~inside, F.lag(own(f"s_{k}"), w - 1).over(line)) for k in parts}) if w > 1 else rows.withColumns({own(f"q_{k}"): F.lit(None).cast("double") for k in parts})
    p, q = ({k: F.col(own(f"{side}_{k}")) for k in parts} for side in "pq")
    n = F.coalesce(p["n"], F.lit(0)) + F.coalesce(q["n"], F.lit(0))
    m = F.least(F.col(number) + 1, F.lit(w))
    gate = enough(n, series.min_periods) if skip_nan else clean(m, n, series.min_periods)
    made = F.when(gate & (n > 0), kind.value(p, q, n))
    out = rows.withColumn(output, nan_if_null(made) if nan_output else made)
    return out.drop(number, block, v, *[own(f"{side}_{k}") for side in "psq" for k in parts])
