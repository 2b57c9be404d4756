"""The same statistic of several columns in one pass: all columns share one exchange, one sort and one window operator."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite, nan_if_null
from ..plans.frames import OWN, Series, check_columns, clean, enough
from ..plans.ordered import PLACE, Tail, in_order, moments
from ._apply import apply, count_rows
from .pairs import CONSTANT, correlation
from .rolling import _ddof

#: Columns that correlation matrices take.
COLUMNS = (2, 50)


def _columns(name, value, df, columns, window, order_by, partition_by, min_periods, skip_nan, nan_output, layout) -> DataFrame:
    series = Series.rolling(order_by, partition_by, window, min_periods)

    def build(cleaned, w):
        made = {}
        for c, v in zip(columns, cleaned, strict=True):
            n = w(F.count(v))
            gate = enough(n, series.min_periods) if skip_nan else clean(count_rows(w), n, series.min_periods)
            made[f"{name}_{c}"] = F.when(gate, value(v, n, w))
        return made

    return apply(df, series, list(columns), build, nan_output, layout)


def rolling_mean_2d(df, columns, window, order_by, partition_by=None, min_periods=None, nan_output=False, layout="series") -> DataFrame:
    return _columns("mean", lambda v, n, w: w(F.avg(v)), df, columns, window, order_by, partition_by, min_periods, False, nan_output, layout)


def rolling_sum_2d(df, columns, window, order_by, partition_by=None, min_periods=None, nan_output=False, layout="series") -> DataFrame:
    return _columns("sum", lambda v, n, w: w(F.sum(v)), df, columns, window, order_by, partition_by, min_periods, False, nan_output, layout)


def rolling_std_2d(df, columns, window, order_by, partition_by=None, min_periods=None, ddof=1, nan_output=False, layout="series") -> DataFrame:
    one = _ddof(ddof)
    return _columns("std", lambda v, n, w: F.when(n > one, w((F.stddev_samp if one else F.stddev_pop)(v))), df, columns, window, order_by, partition_by, min_periods, False, nan_output, layout)


def rolling_min_2d(df, columns, window, order_by, partition_by=None, min_periods=None, skip_nan=False, nan_output=False, layout="series") -> DataFrame:
    return _columns("min", lambda v, n, w: w(F.min(v)), df, columns, window, order_by, partition_by, min_periods, skip_nan, nan_output, layout)


def rolling_max_2d(df, columns, window, order_by, partition_by=None, min_periods=None, skip_nan=False, nan_output=False, layout="series") -> DataFrame:
    return _columns("max", lambda v, n, w: w(F.max(v)), df, columns, window, order_by, partition_by, min_periods, skip_nan, nan_output, layout)


def _checked(columns) -> list[str]:
    low, high = COLUMNS
    if not low <= len(columns) <= high:
        raise ValueError(f"correlations take {low} to {high} columns, not {len(columns)}")
    return list(columns)


def _pairs(cleaned, series: Series, w) -> dict[tuple[int, int], object]:
    """A frame without gaps in both columns is valid for the pair, so moments of single columns are shared by all pairs."""
    m = count_rows(w)
    open_ = [clean(m, w(F.count(v)), series.min_periods) for v in cleaned]
    return {(i, j): F.when(open_[i] & open_[j], correlation(cleaned[i], cleaned[j], m, w)) for i, j in combinations(range(len(cleaned)), 2)}


def _batched(df: DataFrame, series: Series, columns: list[str], names: dict[tuple[int, int], str]) -> DataFrame:
    """df with the correlation of each pair of columns appended. Series pass through Python in order, in batches: the window operator goes over all
    rows of a frame and all moments again for each row, at many times the cost."""
    check_columns(df, columns)
    cleaned, w, least = [f"{OWN}x{i}" for i in range(len(columns))], series.window, max(2, series.min_periods)

    def start():
        tail = Tail(w - 1, len(columns))

        def step(place: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
            m, means, cov = moments(tail.before(values), place, w)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                spread = [(m >= least) & (cov[i, i] > (cov[i, i] + mean * mean) * CONSTANT) for i, mean in enumerate(means)]
                return [np.where(spread[i] & spread[j], np.clip(cov[i, j] / np.sqrt(cov[i, i] * cov[j, j]), -1.0, 1.0), np.nan) for i, j in names]

        return step

    rows = df.withColumns({t: finite(F.col(f"`{c}`")) for t, c in zip(cleaned, columns, strict=True)})
    return in_order(rows, series, cleaned, start, list(names.values())).drop(*cleaned, PLACE)


def rolling_corr_pairs(df, columns, window, order_by, partition_by=None, min_periods=None, nan_output=False, layout="series") -> DataFrame:
    """A column corr_<a>_<b> for each pair, in the order of the columns. Layout "batches" costs far less than "series" and gives the same."""
    columns, series = _checked(columns), Series.rolling(order_by, partition_by, window, min_periods)
    if layout == "batches":
        names = {(i, j): f"corr_{columns[i]}_{columns[j]}" for i, j in combinations(range(len(columns)), 2)}
        out = _batched(df, series, columns, names)
        return out.withColumns({c: nan_if_null(F.col(f"`{c}`")) for c in names.values()}) if nan_output else out
    return apply(df, series, columns, lambda cleaned, w: {f"corr_{columns[i]}_{columns[j]}": c for (i, j), c in _pairs(cleaned, series, w).items()}, nan_output, layout)


def rolling_corr_matrix(df, columns, window, order_by, partition_by=None, min_periods=None, output="corr_matrix", nan_output=False, layout="series") -> DataFrame:
    """The symmetric matrix as array<array<double>>; its diagonal is 1 on every row. Layouts as for rolling_corr_pairs."""
    columns, series = _checked(columns), Series.rolling(order_by, partition_by, window, min_periods)

    def matrix(pairs):
        cell = lambda i, j: F.lit(1.0) if i == j else nan_if_null(pairs[min(i, j), max(i, j)]) if nan_output else pairs[min(i, j), max(i, j)]
        return {output: F.array(*[F.array(*[cell(i, j) for j in range(len(columns))]) for i in range(len(columns))])}

    if layout == "batches":
        names = {(i, j): f"{OWN}r{i}_{j}" for i, j in combinations(range(len(columns)), 2)}
        return _batched(df, series, columns, names).withColumns(matrix({k: F.col(c) for k, c in names.items()})).drop(*names.values())
    return apply(df, series, columns, lambda cleaned, w: matrix(_pairs(cleaned, series, w)), False, layout)
