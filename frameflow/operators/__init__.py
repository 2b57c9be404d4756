"""Rolling and expanding operators."""

from .expanding import expanding_mean, expanding_quantile_approx, expanding_regression, expanding_std, expanding_sum, expanding_var
from .matrix import rolling_corr_matrix, rolling_corr_pairs, rolling_max_2d, rolling_mean_2d, rolling_min_2d, rolling_std_2d, rolling_sum_2d
from .pairs import rolling_corr, rolling_cov, rolling_regression, rolling_regression_xy, rolling_spearman
from .regression import rolling_multiple_regression
from .rolling import rolling_kurt, rolling_max, rolling_mean, rolling_min, rolling_quantile, rolling_skew, rolling_std, rolling_sum, rolling_var, rolling_zscore
from .settings import get_parallelism, runtime_info, set_parallelism

__all__ = [
    "expanding_mean", "expanding_quantile_approx", "expanding_regression", "expanding_std", "expanding_sum", "expanding_var",
    "get_parallelism", "rolling_corr", "rolling_corr_matrix", "rolling_corr_pairs", "rolling_cov", "rolling_kurt", "rolling_max",
    "rolling_max_2d", "rolling_mean", "rolling_mean_2d", "rolling_min", "rolling_min_2d", "rolling_multiple_regression", "rolling_quantile",
    "rolling_regression", "rolling_regression_xy", "rolling_skew", "rolling_spearman", "rolling_std", "rolling_std_2d", "rolling_sum",
    "rolling_sum_2d", "rolling_var", "rolling_zscore", "runtime_info", "set_parallelism",
]
