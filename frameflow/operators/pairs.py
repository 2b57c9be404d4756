"""Rolling statistics of two columns on the same row, and regressions with one regressor.

A row counts where both values are valid. Parameters are those of the rolling module. Constant sides: covariance 0, correlation nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite
from ..plans.frames import OWN, Series, check_columns, clean
from ..plans.ordered import PLACE, Tail, in_order
from ._apply import Frame, apply, count_rows
from .rolling import _ddof

#: A side is constant where its variance is this little beside its mean square; sums below the second one give no regression.
CONSTANT, SINGULAR = 1e-14, 1e-12


def both_valid(x: Column, y: Column) -> tuple[Column, Column]:
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def correlation(x: Column, y: Column, n: Column, w: Frame) -> Column:
    """Pearson correlation of columns that are NULL on the same rows."""
    vx, vy = w(F.var_pop(x)), w(F.var_pop(y))
    spread = (vx > w(F.avg(x * x)) * CONSTANT) & (vy > w(F.avg(y * y)) * CONSTANT)
    return F.when((n >= 2) & spread, clamp(w(F.covar_pop(x, y)) / F.sqrt(vx * vy), -1.0, 1.0))


def _pair(df, x, y, series: Series, skip_nan: bool, nan_output: bool, layout: str, value) -> DataFrame:
    def build(columns, w):
        a, b = both_valid(*columns)
        n = w(F.count(a))
        gate = (n >= series.min_periods) if skip_nan else clean(count_rows(w), n, series.min_periods)
        return {name: F.when(gate, v) for name, v in value(a, b, n, w).items()}

    return apply(df, series, [x, y], build, nan_output, layout)


def rolling_cov(df, x, y, window, order_by, partition_by=None, min_periods=None, ddof=1, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    one = _ddof(ddof)
    series = Series.rolling(order_by, partition_by, window, min_periods)
    return _pair(df, x, y, series, skip_nan, nan_output, layout, lambda a, b, n, w: {output or f"cov_{x}_{y}": F.when(n > one, w((F.covar_samp if one else F.covar_pop)(a, b)))})


def rolling_corr(df, x, y, window, order_by, partition_by=None, min_periods=None, return_cov=False, skip_nan=False, output=None, nan_output=False, layout="series") -> DataFrame:
    """Pearson correlation; with return_cov the sample covariance too, as column <output>_cov."""
    series, name = Series.rolling(order_by, partition_by, window, min_periods), output or f"corr_{x}_{y}"

    def value(a, b, n, w):
        found = {name: correlation(a, b, n, w)}
        return found | ({f"{name}_cov": F.when(n >= 2, w(F.covar_samp(a, b)))} if return_cov else {})

    return _pair(df, x, y, series, skip_nan, nan_output, layout, value)


def _fields(prefix: str) -> dict[str, str]:
    return {k: f"{prefix}_{k}" for k in ("intercept", "slope", "r2")}


def regression_columns(n: Column, mx: Column, my: Column, vx: Column, vy: Column, cov: Column, least: Column) -> dict[str, Column]:
    """Intercept, slope and r2 from moments; sums of squares below SINGULAR count as 0, so the scale of the data matters there."""
    fits = least & (n * n * vx > SINGULAR)
    slope = F.when(fits, cov / vx)
    r2 = F.when(fits & (n * n * n * n * vx * vy > SINGULAR), clamp(cov * cov / (vx * vy), 0.0, 1.0))
    return {"intercept": my - slope * mx, "slope": slope, "r2": r2}


def rolling_regression_xy(df, y, x, window, order_by, partition_by=None, min_periods=None, output=None, nan_output=False, layout="series") -> DataFrame:
    """y on x: columns <output>_intercept, _slope, _r2. Constant x: nothing; constant y: slope 0 and no r2."""
    series, names = Series.rolling(order_by, partition_by, window, min_periods), _fields(output or f"reg_{y}_{x}")

    def value(a, b, n, w):
        d = n.cast("double")
        made = regression_columns(d, w(F.avg(a)), w(F.avg(b)), w(F.var_pop(a)), w(F.var_pop(b)), w(F.covar_pop(a, b)), n >= 2)
        return {names[k]: c for k, c in made.items()}

    return _pair(df, x, y, series, False, nan_output, layout, value)


def rolling_regression(df, y, window, order_by, partition_by=None, min_periods=None, time_as_x=True, output=None, nan_output=False, layout="series") -> DataFrame:
    """y on its place in the frame (0, 1, ...): columns <output>_intercept, _slope, _r2."""
    if not time_as_x:
        raise ValueError("time_as_x must be true; use rolling_regression_xy for another regressor")
    series, names = Series.rolling(order_by, partition_by, window, min_periods), _fields(output or f"reg_{y}")

    def build(columns, w):
        v, m = columns[0], count_rows(w)
        gate = clean(m, w(F.count(v)), series.min_periods)
        # Any counter with step 1 has the same moments about its mean as the place in the frame.
        d = m.cast("double")
        made = regression_columns(d, (d - 1) / 2, w(F.avg(v)), (d * d - 1) / 12, w(F.var_pop(v)), w(F.covar_pop(F.col(number), v)), m >= 2)
        return {names[k]: F.when(gate, c) for k, c in made.items()}

    from ..plans.halo import NUMBER

    number = NUMBER if layout == "halo" else PLACE
    rows = df if layout == "halo" else df.withColumn(PLACE, F.row_number().over(series.spec()).cast("double"))
    return apply(rows, series, [y], build, nan_output, layout).drop(PLACE)


def spearman_of_windows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spearman correlation of each row of two matrices without invalid values."""
    a, b = average_ranks(x), average_ranks(y)
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    xx, yy, xy = (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)
    n = x.shape[1]
    ok = (n * xx > SINGULAR) & (n * yy > SINGULAR)
    out = np.full(len(x), np.nan)
    out[ok] = np.clip(xy[ok] / np.sqrt(xx[ok] * yy[ok]), -1, 1)
    return out


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks along each row, ties sharing their mean."""
    order = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, order, axis=1)
    n = x.shape[1]
    place = np.broadcast_to(np.arange(n), x.shape)
    new = np.ones(x.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    ends = np.ones(x.shape, bool)
    ends[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(ends, place, n)[:, ::-1], axis=1)[:, ::-1]
    ranks = np.empty(x.shape)
    np.put_along_axis(ranks, order, (first + last) / 2 + 1, axis=1)
    return ranks


def _spearman(joined: list[np.ndarray], place: np.ndarray, w: int, mp: int, chunk: int = 1 << 20) -> np.ndarray:
    """Rolling Spearman correlation at each place; the columns begin w - 1 rows before the first one."""
    out, rows = np.full(len(place), np.nan), np.minimum(place, w)
    x, y = joined
    bad = ~(np.isfinite(x) & np.isfinite(y))
    for m in np.unique(rows[rows >= max(2, mp)]):
        wx, wy, wb = (np.lib.stride_tricks.sliding_window_view(v, m) for v in (x, y, bad))
        at, step = np.flatnonzero(rows == m), max(1, chunk // int(m))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            first = some + w - m
            good = ~wb[first].any(axis=1)
            if good.any():
                out[some[good]] = spearman_of_windows(wx[first[good]], wy[first[good]])
    return out


def rolling_spearman(df, x, y, window, order_by, partition_by=None, min_periods=None, output=None, nan_output=False, layout="series") -> DataFrame:
    """Spearman correlation with average ranks; a side that is all ties gives nothing.

    Ranks inside a frame have no built-in, so each series (with layout "halo": each block of it) passes through Python in order, in batches; the
    window - 1 rows before a batch are kept, so a task's memory is bounded whatever the length of a series. "halo" spreads a series over tasks.
    """
    from ..plans.halo import BLOCK, HALO, NUMBER, halo_blocks

    series, name = Series.rolling(order_by, partition_by, window, min_periods), output or f"spearman_{x}_{y}"
    check_columns(df, [x, y])
    w, mp, a, b = series.window, series.min_periods, f"{OWN}a", f"{OWN}b"
    rows = halo_blocks(df, series) if layout == "halo" else df
    rows = rows.withColumn(a, finite(F.col(f"`{x}`"))).withColumn(b, finite(F.col(f"`{y}`")))

    def start():
        tail = Tail(w - 1, 2)
        return lambda place, *values: [_spearman(tail.before(values), place, w, mp)]

    out = in_order(rows, series, [a, b], start, [name], [BLOCK] if layout == "halo" else [])
    if layout == "halo":
        out = out.where(~F.col(HALO))
    out = out.drop(a, b, PLACE, BLOCK, NUMBER, HALO)
    return out.withColumn(name, F.coalesce(name, F.lit(float("nan")))) if nan_output else out


__all__ = ["rolling_corr", "rolling_cov", "rolling_regression", "rolling_regression_xy", "rolling_spearman"]
