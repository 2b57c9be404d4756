"""Rolling least squares on several regressors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite
from ..plans.frames import OWN, Series, check_columns
from ..plans.ordered import PLACE, Tail, in_order, moments
from ._apply import LAYOUTS

#: Regressors that are taken, and how small a pivot beside its diagonal makes the system singular.
REGRESSORS, PIVOT, TOTAL = (1, 16), 1e-13, 1e-12


def solve(m: np.ndarray, mean: np.ndarray, cov: np.ndarray, mean_y: np.ndarray, cov_y: np.ndarray, var_y: np.ndarray):
    """Coefficients (intercept first), r2 and residual standard deviation of each row from centred moments; NaN where singular."""
    rows, k = mean.shape
    square = np.maximum(1.0, m[:, None] * (np.einsum("rii->ri", cov) + mean**2))  # diagonal of X'X
    low, a, ok = np.zeros_like(cov), m[:, None, None] * cov, np.ones(rows, bool)
    for j in range(k):  # Cholesky of the cross products about the mean, all rows at once
        pivot = a[:, j, j] - (low[:, j, :j] ** 2).sum(axis=1)
        ok &= pivot > PIVOT * square[:, j]
        low[:, j, j] = np.sqrt(np.where(ok, pivot, 1.0))
        low[:, j + 1 :, j] = (a[:, j + 1 :, j] - np.einsum("rik,rk->ri", low[:, j + 1 :, :j], low[:, j, :j])) / low[:, j, j][:, None]
    right, z, beta = m[:, None] * cov_y, np.zeros((rows, k)), np.zeros((rows, k))
    for j in range(k):
        z[:, j] = (right[:, j] - (low[:, j, :j] * z[:, :j]).sum(axis=1)) / low[:, j, j]
    for j in reversed(range(k)):
        beta[:, j] = (z[:, j] - (low[:, j + 1 :, j] * beta[:, j + 1 :]).sum(axis=1)) / low[:, j, j]
    total = m * var_y
    residual = np.maximum(0.0, total - (beta * right).sum(axis=1))
    coef = np.c_[mean_y - (beta * mean).sum(axis=1), beta]
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(ok & (total > TOTAL), np.clip(1 - residual / total, 0, 1), np.nan)
        std = np.where(ok & (m > k + 1), np.sqrt(residual / np.maximum(m - k - 1, 1)), np.nan)
    return ok, coef, r2, std


def rolling_multiple_regression(df, y, columns, window, order_by, partition_by=None, min_periods=None, output="ols", nan_output=False, layout="series", flatten=False) -> DataFrame:
    """y on the columns and an intercept: struct <output> of coef (intercept first), r2 and residual_std; flatten gives one column for each.

    A task sees its series in order, in Arrow batches, with the window - 1 rows before each kept: moments are summed over the rows of a batch lag by lag,
    and its small systems are solved together. The frame must be free of invalid values in y and all columns. Singular systems give nothing;
    residual_std needs a row more than coefficients.
    """
    from ..plans.halo import BLOCK, HALO, NUMBER, halo_blocks

    columns = list(columns)
    low, high = REGRESSORS
    if not low <= len(columns) <= high:
        raise ValueError(f"{low} to {high} regressors are taken, not {len(columns)}")
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    series, k = Series.rolling(order_by, partition_by, window, min_periods), len(columns)
    check_columns(df, [y, *columns])
    w, least = series.window, max(series.min_periods, k + 1)
    rows, extra = (halo_blocks(df, series), [BLOCK]) if layout == "halo" else (df, [])
    cleaned = [f"{OWN}x{i}" for i in range(k + 1)]
    results = [*(f"{OWN}b{i}" for i in range(k + 1)), f"{OWN}r2", f"{OWN}std"]

    def start():
        tail = Tail(w - 1, k + 1)

        def step(place: np.ndarray, *values: np.ndarray) -> np.ndarray:
            m, means, spread = moments(tail.before(values), place, w)
            out, mean = np.full((k + 3, len(place)), np.nan), np.array(means)
            at = np.flatnonzero((m >= least) & np.isfinite(mean).all(axis=0))
            if len(at):
                full = np.zeros((len(at), k + 1, k + 1))
                for (i, j), cov in spread.items():
                    full[:, i, j] = full[:, j, i] = cov[at]
                ok, coef, r2, std = solve(m[at], mean[1:, at].T, full[:, 1:, 1:], mean[0, at], full[:, 0, 1:], full[:, 0, 0])
                out[: k + 1, at], out[k + 1, at], out[k + 2, at] = np.where(ok, coef.T, np.nan), r2, std
            return out

        return step

    rows = rows.withColumns({t: finite(F.col(f"`{c}`")) for t, c in zip(cleaned, [y, *columns], strict=True)})
    out = in_order(rows, series, cleaned, start, results, extra)
    if layout == "halo":
        out = out.where(~F.col(HALO))
    lost = F.lit(float("nan")) if nan_output else F.lit(None).cast("double")
    *coef, r2, std = [F.coalesce(F.col(c), lost) for c in results]
    own = [*cleaned, *results, PLACE, BLOCK, NUMBER, HALO]
    if flatten:
        named = {f"{output}_{c}": v for c, v in zip(["intercept", *columns], coef, strict=True)}
        return out.withColumns(named | {f"{output}_r2": r2, f"{output}_residual_std": std}).drop(*own)
    coefs = F.array(*coef) if nan_output else F.when(F.col(results[0]).isNotNull(), F.array(*coef))
    return out.withColumn(output, F.struct(coefs.alias("coef"), r2.alias("r2"), std.alias("residual_std"))).drop(*own)
