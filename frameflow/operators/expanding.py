"""Statistics of all rows of a series so far. Invalid values are always left out; a value is emitted once enough valid ones were seen."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite
from ..plans.frames import OWN, Series, check_columns, enough
from ..plans.ordered import PLACE, in_order
from ._apply import apply
from .rolling import _ddof, quantile_level


def _one(name, value, df, x, order_by, partition_by, min_periods, default, output, nan_output) -> DataFrame:
    series = Series.expanding(order_by, partition_by, min_periods, default)

    def build(columns, w):
        n = w(F.count(columns[0]))
        return {output or f"expanding_{name}_{x}": F.when(enough(n, series.min_periods), value(columns[0], n, w))}

    return apply(df, series, [x], build, nan_output)


def expanding_mean(df, x, order_by, partition_by=None, min_periods=1, output=None, nan_output=False) -> DataFrame:
    return _one("mean", lambda v, n, w: w(F.avg(v)), df, x, order_by, partition_by, min_periods, 1, output, nan_output)


def expanding_sum(df, x, order_by, partition_by=None, min_periods=1, output=None, nan_output=False) -> DataFrame:
    return _one("sum", lambda v, n, w: w(F.sum(v)), df, x, order_by, partition_by, min_periods, 1, output, nan_output)


def expanding_var(df, x, order_by, partition_by=None, min_periods=2, ddof=1, output=None, nan_output=False) -> DataFrame:
    one = _ddof(ddof)
    return _one("var", lambda v, n, w: F.when(n > one, w((F.var_samp if one else F.var_pop)(v))), df, x, order_by, partition_by, min_periods, 2, output, nan_output)


def expanding_std(df, x, order_by, partition_by=None, min_periods=2, ddof=1, output=None, nan_output=False) -> DataFrame:
    one = _ddof(ddof)
    return _one("std", lambda v, n, w: F.when(n > one, w((F.stddev_samp if one else F.stddev_pop)(v))), df, x, order_by, partition_by, min_periods, 2, output, nan_output)


def expanding_regression(df, y, order_by, partition_by=None, min_periods=2, time_as_x=True, output=None, nan_output=False) -> DataFrame:
    """y on the row's number in its series, gaps included: columns <output>_intercept, _slope, _r2. Rows with an invalid y emit too."""
    from .pairs import regression_columns

    if not time_as_x:
        raise ValueError("time_as_x must be true")
    series, name, place = Series.expanding(order_by, partition_by, min_periods, 2), output or f"expanding_reg_{y}", f"{OWN}place"

    def build(columns, w):
        v = columns[0]
        t = F.when(v.isNotNull(), F.col(place))
        n = w(F.count(v))
        made = regression_columns(n.cast("double"), w(F.avg(t)), w(F.avg(v)), w(F.var_pop(t)), w(F.var_pop(v)), w(F.covar_pop(t, v)), n >= max(series.min_periods, 2))
        return {f"{name}_{k}": c for k, c in made.items()}

    rows = df.withColumn(place, (F.row_number().over(series.spec()) - 1).cast("double"))
    return apply(rows, series, [y], build, nan_output).drop(place)


class StreamQuantile:
    """Estimate of a quantile from five markers that move with the stream (Jain and Chlamtac, CACM 28(10), 1985)."""

    def __init__(self, q: float):
        self.q, self.n, self.heights = q, 0, []
        self.at = [1.0, 2.0, 3.0, 4.0, 5.0]
        self.wanted = [1.0, 1 + 2 * q, 1 + 4 * q, 3 + 2 * q, 5.0]
        self.step = [0.0, q / 2, q, (1 + q) / 2, 1.0]

    def add(self, x: float) -> None:
        self.n += 1
        h, at, wanted, step = self.heights, self.at, self.wanted, self.step
        if self.n <= 5:
            h.append(x)
            h.sort()
            return
        if x < h[0]:
            h[0], cell = x, 0
        elif x >= h[4]:
            h[4], cell = x, 3
        else:
            cell = 0 if x < h[1] else 1 if x < h[2] else 2 if x < h[3] else 3
        for i in range(cell + 1, 5):
            at[i] += 1
        for i in (1, 2, 3, 4):
            wanted[i] += step[i]
        for i in (1, 2, 3):
            gap = wanted[i] - at[i]
            if (gap >= 1 and at[i + 1] - at[i] > 1) or (gap <= -1 and at[i - 1] - at[i] < -1):
                d = 1 if gap > 0 else -1
                curve = self._parabola(i, d)
                h[i] = curve if h[i - 1] < curve < h[i + 1] else h[i] + d * (h[i + d] - h[i]) / (at[i + d] - at[i])
                at[i] += d

    def _parabola(self, i: int, d: int) -> float:
        h, (left, here, right) = self.heights, self.at[i - 1 : i + 2]
        up = (here - left + d) * (h[i + 1] - h[i]) / (right - here)
        down = (right - here - d) * (h[i] - h[i - 1]) / (here - left)
        return h[i] + d / (right - left) * (up + down)

    def value(self) -> float | None:
        if not self.n:
            return None
        if self.n < 5:  # few values: their exact quantile
            return float(np.percentile(self.heights, 100 * self.q))
        return self.heights[2]


def _stream(df: DataFrame, x: str, series: Series, q: float, name: str) -> DataFrame:
    """Appends the estimate after each row, with the row's PLACE, the valid values so far and how many rows up to this one are valid without a gap.

    It depends on all rows before, so a series is one sequential task; only the estimate's markers are kept between rows.
    """
    check_columns(df, [x])
    v = f"{OWN}v"

    def start():
        state, run = StreamQuantile(q), 0

        def step(place: np.ndarray, values: np.ndarray):
            nonlocal state, run
            found, seen, runs = [], [], []
            for at, value in zip(place.tolist(), values.tolist(), strict=True):
                if at == 1:
                    state, run = StreamQuantile(q), 0
                if value == value:
                    state.add(value)
                    run += 1
                else:
                    run = 0
                found.append(state.value())
                seen.append(state.n)
                runs.append(run)
            return found, seen, runs

        return step

    return in_order(df.withColumn(v, finite(F.col(f"`{x}`"))), series, [v], start, [name, f"{OWN}n", f"{OWN}run"]).drop(v)


def _gated(out: DataFrame, gate: Column, name: str, nan_output: bool) -> DataFrame:
    value = F.when(gate, F.col(f"`{name}`"))
    return out.withColumn(name, F.coalesce(value, F.lit(float("nan"))) if nan_output else value).drop(PLACE, f"{OWN}n", f"{OWN}run")


def expanding_quantile_approx(df, x, order_by, q=0.5, partition_by=None, min_periods=5, output=None, nan_output=False) -> DataFrame:
    """Streaming quantile estimate; exact below five values."""
    series, name = Series.expanding(order_by, partition_by, min_periods, 5), output or f"expanding_quantile_{x}"
    return _gated(_stream(df, x, series, quantile_level(q), name), enough(F.col(f"{OWN}n"), series.min_periods), name, nan_output)


def stream_quantile(df, x, series: Series, q: float, name: str, nan_output: bool) -> DataFrame:
    """The same estimate behind a rolling frame's gate."""
    m = F.least(F.col(PLACE), F.lit(series.window))
    return _gated(_stream(df, x, series, q, name), (F.col(f"{OWN}run") >= m) & (m >= series.min_periods), name, nan_output)
