"""Rolling statistics of one column over the last window rows of its series.

All take: df, the column x, window, order_by (a total order makes results deterministic), partition_by (series), min_periods (rows, or with skip_nan valid
values, that a frame needs; the window by default), output (name of the appended column), nan_output (NaN instead of NULL where nothing is
emitted) and layout ("series", or "halo" to spread one series over tasks). By default a frame with an invalid value (NULL, NaN, infinite) emits nothing;
skip_nan leaves such values out instead. layout "blocked" (sum, mean, min, max, var, std) costs the same for any window.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frames import Series, clean, enough
from . import blocked
from ._apply import Frame, apply, count_rows


def _ddof(ddof: int) -> int:
    if ddof not in (0, 1) or isinstance(ddof, bool):
        raise ValueError("ddof must be 0 or 1")
    return ddof


def _one(name: str, value, df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout, block=None) -> DataFrame:
    """Appends value(x, valid, frame), where the gate is open."""
    series = Series.rolling(order_by, partition_by, window, min_periods)
    output = output or f"{name}_{x}"
    if layout == "blocked":
        if block is None:
            raise ValueError(f"{name} has no blocked layout")
        return blocked.append(df, series, x, output, block, skip_nan, nan_output)

    def build(columns: list[Column], w: Frame) -> dict[str, Column]:
        valid = w(F.count(columns[0]))
        gate = enough(valid, series.min_periods) if skip_nan else clean(count_rows(w), valid, series.min_periods)
        return {output: F.when(gate, value(columns[0], valid, w))}

    return apply(df, series, [x], build, nan_output, layout)


def rolling_mean(df, x, window, order_by, partition_by=None, min_periods=None, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    return _one("mean", lambda v, n, w: w(F.avg(v)), df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout, blocked.mean)


def rolling_sum(df, x, window, order_by, partition_by=None, min_periods=None, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    return _one("sum", lambda v, n, w: w(F.sum(v)), df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout, blocked.total)


def rolling_min(df, x, window, order_by, partition_by=None, min_periods=None, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    return _one("min", lambda v, n, w: w(F.min(v)), df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout, blocked.least)


def rolling_max(df, x, window, order_by, partition_by=None, min_periods=None, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    return _one("max", lambda v, n, w: w(F.max(v)), df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout, blocked.greatest)


def rolling_var(df, x, window, order_by, partition_by=None, min_periods=None, ddof=1, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    """Variance; with ddof 1 a frame needs two valid values."""
    one = _ddof(ddof)
    value = lambda v, n, w: F.when(n > one, w((F.var_samp if one else F.var_pop)(v)))
    return _one("var", value, df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout, blocked.variance(one, False))


def rolling_std(df, x, window, order_by, partition_by=None, min_periods=None, ddof=1, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    one = _ddof(ddof)
    value = lambda v, n, w: F.when(n > one, w((F.stddev_samp if one else F.stddev_pop)(v)))
    return _one("std", value, df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout, blocked.variance(one, True))


def rolling_zscore(df, x, window, order_by, partition_by=None, min_periods=None, ddof=1, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    """(x - mean) / std of the frame that ends at the row; nothing where x is invalid or the frame is constant."""
    one = _ddof(ddof)

    def value(v: Column, n: Column, w: Frame) -> Column:
        var = w((F.var_samp if one else F.var_pop)(v))
        return F.when(v.isNotNull() & (n > one) & (var > 0), (v - w(F.avg(v))) / F.sqrt(var))

    return _one("zscore", value, df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout)


def rolling_skew(df, x, window, order_by, partition_by=None, min_periods=None, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    """Bias-corrected skewness; three valid values and some spread are needed."""

    def value(v: Column, n: Column, w: Frame) -> Column:
        return F.when((n >= 3) & (w(F.var_pop(v)) > 0), F.sqrt(n * (n - 1)) / (n - 2) * w(F.skewness(v)))

    return _one("skew", value, df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout)


def rolling_kurt(df, x, window, order_by, partition_by=None, min_periods=None, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    """Bias-corrected excess kurtosis; four valid values and some spread are needed."""

    def value(v: Column, n: Column, w: Frame) -> Column:
        g = w(F.kurtosis(v))
        return F.when((n >= 4) & (w(F.var_pop(v)) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))

    return _one("kurt", value, df, x, window, order_by, partition_by, min_periods, skip_nan, output, nan_output, layout)


def quantile_level(q: float) -> float:
    if not 0 < q < 1:
        raise ValueError("q must lie between 0 and 1, both excluded")
    return float(q)


def rolling_quantile(df, x, window, order_by, q=0.5, partition_by=None, min_periods=None, exact=True, output=None, nan_output=False, layout="series") -> DataFrame:
    """Exact quantile with linear interpolation. exact=False (deprecated) is the streaming estimate of all valid values so far, behind the same gate."""
    if not exact:
        warnings.warn("exact=False is deprecated; use expanding_quantile_approx", DeprecationWarning, stacklevel=2)
        from .expanding import stream_quantile

        return stream_quantile(df, x, Series.rolling(order_by, partition_by, window, min_periods), quantile_level(q), output or f"quantile_{x}", nan_output)
    level = quantile_level(q)
    return _one("quantile", lambda v, n, w: w(F.percentile(v, F.lit(level))), df, x, window, order_by, partition_by, min_periods, False, output, nan_output, layout)


__all__ = ["rolling_kurt", "rolling_max", "rolling_mean", "rolling_min", "rolling_quantile", "rolling_skew", "rolling_std", "rolling_sum", "rolling_var", "rolling_zscore"]
