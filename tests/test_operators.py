"""Goldens, brute force for each frame, layouts against each other, and validation."""

import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import frameflow as ff

ORDER = {"order_by": "t", "partition_by": "s"}
N, W, MP = 200, 7, 4


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x, y, z = rng.normal(size=N).round(1), rng.normal(size=N), rng.normal(size=N)
    y = 0.5 * x + y
    x[50:65], y[100:112] = 2.0, 1.0
    for i, bad in ((7, math.nan), (33, math.inf), (90, -math.inf), (120, math.nan)):
        x[i] = bad
    return x, y, z


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [("s", i, None if i == 120 else float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(*data, strict=True))]
    return spark.createDataFrame(rows, "s string, t long, x double, y double, z double").repartition(3).cache()


def series(spark, values):
    return spark.createDataFrame([("s", i, None if v is None else float(v)) for i, v in enumerate(values)], "s string, t long, x double")


def column(df, name="r"):
    return [r[0] for r in df.orderBy("t").select(name).collect()]


def brute(f, columns, w=W, mp=MP, skip=False):
    values = np.array([np.where(np.isfinite(c), c, np.nan) for c in columns])
    out = []
    for i in range(values.shape[1]):
        frame = values[:, max(0, i - w + 1) : i + 1]
        good = ~np.isnan(frame).any(axis=0)
        is_open = (good.sum() >= mp and good.any()) if skip else (good.all() and len(good) >= mp)
        out.append(f(*frame[:, good]) if is_open else None)
    return out


def same(found, wanted, tolerance=1e-8):
    wanted = [None if v is None or math.isnan(v) else v for v in wanted]
    assert [v is None for v in found] == [v is None for v in wanted]
    assert all(a == pytest.approx(b, abs=tolerance, rel=tolerance) for a, b in zip(found, wanted, strict=True) if a is not None)


ONE = {
    "sum": (ff.rolling_sum, np.sum), "mean": (ff.rolling_mean, np.mean), "min": (ff.rolling_min, np.min), "max": (ff.rolling_max, np.max),
    "var": (ff.rolling_var, lambda v: np.var(v, ddof=1) if len(v) > 1 else math.nan), "std": (ff.rolling_std, lambda v: np.std(v, ddof=1) if len(v) > 1 else math.nan),
}


@pytest.mark.parametrize("name", ONE)
@pytest.mark.parametrize("layout", ["series", "halo", "blocked"])
@pytest.mark.parametrize("skip", [False, True])
def test_one_column(table, data, name, layout, skip):
    f, reference = ONE[name]
    same(column(f(table, "x", W, min_periods=MP, skip_nan=skip, layout=layout, output="r", **ORDER)), brute(reference, [data[0]], skip=skip))


def test_moments(table, data):
    s = pd.Series(np.where(np.isfinite(data[0]), data[0], np.nan))
    spread = np.array([v is not None and v > 1e-20 for v in brute(np.var, [data[0]], skip=True)])
    opts = {"min_periods": MP, "skip_nan": True, "output": "r", **ORDER}
    same(column(ff.rolling_skew(table, "x", W, **opts)), s.rolling(W, MP).skew().where(spread))
    same(column(ff.rolling_kurt(table, "x", W, **opts)), s.rolling(W, MP).kurt().where(spread))
    same(column(ff.rolling_zscore(table, "x", W, **opts)), ((s - s.rolling(W, MP).mean()) / s.rolling(W, MP).std()).where(spread))


def test_pairs(table, data):
    def corr(a, b):
        return np.corrcoef(a, b)[0, 1] if a.var() > 1e-14 and b.var() > 1e-14 else math.nan

    def ranked(a, b):
        return corr(pd.Series(a).rank().to_numpy(), pd.Series(b).rank().to_numpy())

    opts = {"min_periods": MP, "output": "r", **ORDER}
    same(column(ff.rolling_corr(table, "x", "y", W, **opts)), brute(corr, data[:2]))
    same(column(ff.rolling_cov(table, "x", "y", W, skip_nan=True, **opts)), brute(lambda a, b: np.cov(a, b)[0, 1], data[:2], skip=True))
    for layout in ("series", "halo"):
        same(column(ff.rolling_spearman(table, "x", "y", W, layout=layout, **opts)), brute(ranked, data[:2]))
    slope = brute(lambda a, b: np.polyfit(a, b, 1)[0] if a.var() > 1e-12 else math.nan, data[:2])
    same(column(ff.rolling_regression_xy(table, "y", "x", W, **opts), "r_slope"), slope)
    time = brute(lambda b: np.polyfit(np.arange(len(b)), b, 1)[0], data[1:2])
    for layout in ("series", "halo"):
        same(column(ff.rolling_regression(table, "y", W, layout=layout, **opts), "r_slope"), time)


def test_multiple_regression(table, data):
    def fit(k):
        def f(a, b, c):
            x = np.c_[np.ones(len(a)), a, b]
            return np.linalg.lstsq(x, c, rcond=None)[0][k] if np.linalg.matrix_rank(x) == 3 else math.nan

        return f

    out = ff.rolling_multiple_regression(table, "y", ["x", "z"], W, min_periods=MP, output="r", flatten=True, **ORDER)
    for k, name in enumerate(("r_intercept", "r_x", "r_z")):
        same(column(out, name), brute(fit(k), [data[0], data[2], data[1]]))
    collinear = ff.rolling_multiple_regression(table.withColumn("c", F.lit(1.0)), "y", ["c", "z"], W, output="r", **ORDER)
    assert all(v["coef"] is None for v in column(collinear))


def test_matrix(table):
    m = column(ff.rolling_corr_matrix(table, ["x", "y", "z"], W, output="r", **ORDER))
    pairs = ff.rolling_corr_pairs(table, ["x", "y", "z"], W, **ORDER)
    assert all(row[i][i] == 1.0 for row in m for i in range(3))
    for (i, j), name in {(0, 1): "corr_x_y", (0, 2): "corr_x_z", (1, 2): "corr_y_z"}.items():
        assert [row[i][j] for row in m] == [row[j][i] for row in m] == column(pairs, name)
    two = ff.rolling_mean_2d(table, ["x", "z"], W, **ORDER)
    same(column(two, "mean_z"), column(ff.rolling_mean(table, "z", W, output="r", **ORDER)))


def test_expanding(table, data):
    s = pd.Series(np.where(np.isfinite(data[0]), data[0], np.nan))
    same(column(ff.expanding_mean(table, "x", output="r", **ORDER)), s.expanding(1).mean())
    same(column(ff.expanding_std(table, "x", output="r", **ORDER)), s.expanding(2).std())
    good = s.notna().to_numpy()
    slope = [np.polyfit(np.arange(i + 1)[good[: i + 1]], s[: i + 1][good[: i + 1]], 1)[0] if good[: i + 1].sum() >= 2 else None for i in range(N)]
    same(column(ff.expanding_regression(table, "x", output="r", **ORDER), "r_slope"), slope)


GOLDEN = [
    (ff.rolling_mean, [1, 2, 3, 4, 5], {"window": 3}, [None, None, 2, 3, 4]), (ff.rolling_mean, [5, 6, 7], {"window": 3, "min_periods": 1}, [5, 5.5, 6]),
    (ff.rolling_mean, [1, 2], {"window": 5}, [None, None]), (ff.rolling_var, [1, 2, 3], {"window": 3, "ddof": 0}, [None, None, 2 / 3]),
    (ff.rolling_std, [5] * 4, {"window": 3}, [None, None, 0, 0]), (ff.rolling_sum, [1, 2, 3], {"window": 4, "min_periods": 2}, [None, 3, 6]),
    (ff.rolling_min, [3, 1, 4, 1, 5, 9], {"window": 3}, [None, None, 1, 1, 1, 1]), (ff.rolling_mean, [1, None, 3, 4, 5], {"window": 3}, [None, None, None, None, 4]),
    (ff.rolling_mean, [1, None, 3, 4, 5], {"window": 3, "skip_nan": True, "min_periods": 2}, [None, None, 2, 3.5, 4]),
    (ff.rolling_skew, [3.14] * 8, {"window": 5}, [None] * 8), (ff.rolling_quantile, [5, 1, 4, 2, 3], {"window": 5}, [None] * 4 + [3]),
    (ff.rolling_quantile, [1, 2, None, 4, 5, 6, 7], {"window": 3}, [None] * 5 + [5, 6]), (ff.expanding_mean, [1, None, 3, 5], {}, [1, 1, 2, 3]),
]


@pytest.mark.parametrize("f, values, options, wanted", GOLDEN)
@pytest.mark.parametrize("bad", [None, math.nan, math.inf])
def test_goldens(spark, f, values, options, wanted, bad):
    if bad is not None and None not in values:
        pytest.skip("no invalid value")
    same(column(f(series(spark, [bad if v is None else v for v in values]), "x", output="r", **options, **ORDER)), wanted)


def test_stream_quantile(spark):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = column(ff.rolling_quantile(series(spark, [3, 1, 2]), "x", 10, exact=False, min_periods=1, output="r", **ORDER))
    assert out == [3, 2, 2] and any(w.category is DeprecationWarning for w in seen)
    rng = np.random.default_rng(1)
    values = rng.normal(size=1500) + 10
    found = column(ff.expanding_quantile_approx(series(spark, values), "x", output="r", **ORDER))
    assert found[3] is None and found[-1] == pytest.approx(np.median(values), rel=0.01)


@pytest.fixture
def small_batches(spark):
    """Series span many Arrow batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    yield
    spark.conf.set(key, before)


def passes_in_batches(df):
    """Python gets Arrow batches, not a whole series at once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" in plan and "FlatMapGroups" not in plan


@pytest.mark.parametrize("mp", [1, MP, W])
def test_spearman_in_batches(table, data, small_batches, mp):
    def ranked(a, b):
        a, b = (pd.Series(v).rank().to_numpy() for v in (a, b))
        return np.corrcoef(a, b)[0, 1] if len(a) > 1 and a.var() > 0 and b.var() > 0 else math.nan

    two = table.union(table.selectExpr("'r' AS s", "t + 1000", "x", "y", "z"))
    out = ff.rolling_spearman(two, "x", "y", W, min_periods=mp, output="r", **ORDER)
    assert passes_in_batches(out)
    same(column(out), 2 * brute(ranked, data[:2], mp=mp))


def test_stream_quantile_in_batches(table, data, small_batches):
    from frameflow.operators.expanding import StreamQuantile

    state, wanted, gated, run = StreamQuantile(0.5), [], [], 0
    for i, v in enumerate(data[0]):
        good = math.isfinite(v)
        if good:
            state.add(float(v))
        run = run + 1 if good else 0
        wanted.append(state.value() if state.n >= MP else None)
        gated.append(state.value() if i + 1 >= MP and run >= min(W, i + 1) else None)
    two = table.union(table.selectExpr("'r' AS s", "t + 1000", "x", "y", "z"))
    out = ff.expanding_quantile_approx(two, "x", min_periods=MP, output="r", **ORDER)
    assert passes_in_batches(out)
    same(column(out), 2 * wanted)
    with pytest.warns(DeprecationWarning):
        out = ff.rolling_quantile(two, "x", W, exact=False, min_periods=MP, output="r", **ORDER)
    assert passes_in_batches(out)
    same(column(out), 2 * gated)


@pytest.mark.parametrize("mp", [1, MP, W])
def test_correlations_in_batches(table, small_batches, mp):
    """As the window operator gives them, over series that span batches and batches that span series, but without it going over frames."""
    two = table.union(table.selectExpr("'r' AS s", "t + 1000", "x", "y", "z"))
    names, opts = ["x", "y", "z"], {"min_periods": mp, **ORDER}
    pairs, wanted = (ff.rolling_corr_pairs(two, names, W, layout=layout, **opts) for layout in ("batches", "series"))
    assert passes_in_batches(pairs) and "covar_pop" not in pairs._jdf.queryExecution().executedPlan().toString()
    for c in ("corr_x_y", "corr_x_z", "corr_y_z"):
        same(column(pairs, c), column(wanted, c))
    matrix, wanted = (column(ff.rolling_corr_matrix(two, names, W, layout=layout, nan_output=True, output="r", **opts)) for layout in ("batches", "series"))
    assert np.array(matrix) == pytest.approx(np.array(wanted), abs=1e-8, nan_ok=True)


@pytest.mark.parametrize("layout", ["series", "halo"])
def test_multiple_regression_in_batches(table, data, small_batches, layout):
    def slope(a, b, c):
        x = np.c_[np.ones(len(a)), a, b]
        return np.linalg.lstsq(x, c, rcond=None)[0][1] if np.linalg.matrix_rank(x) == 3 else math.nan

    two = table.union(table.selectExpr("'r' AS s", "t + 1000", "x", "y", "z"))
    out = ff.rolling_multiple_regression(two, "y", ["x", "z"], W, min_periods=MP, output="r", flatten=True, layout=layout, **ORDER)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert passes_in_batches(out) and "covar_pop" not in plan
    same(column(out, "r_x"), 2 * brute(slope, [data[0], data[2], data[1]]))


def test_validation(spark):
    df = series(spark, [1, 2])
    for options in ({"window": 0}, {"window": 2.5}, {"window": True}, {"window": 3, "min_periods": -2}, {"window": 3, "layout": "other"}):
        with pytest.raises(ValueError):
            ff.rolling_mean(df, "x", **options, **ORDER)
    for call in (
        lambda: ff.rolling_var(df, "x", 3, ddof=2, **ORDER), lambda: ff.rolling_quantile(df, "x", 3, q=1, **ORDER), lambda: ff.rolling_mean(df, "s", 3, **ORDER),
        lambda: ff.rolling_corr_pairs(df, ["x"], 3, **ORDER), lambda: ff.rolling_multiple_regression(df, "x", ["x"] * 17, 3, **ORDER),
        lambda: ff.rolling_regression(df, "x", 3, time_as_x=False, **ORDER), lambda: ff.rolling_mean(df, "x", 3, order_by=[]),
        lambda: ff.set_parallelism(spark, 0),
    ):
        with pytest.raises(ValueError):
            call()


def test_empty_and_nan_output(spark):
    assert column(ff.rolling_mean(series(spark, []), "x", 3, output="r", **ORDER)) == []
    assert math.isnan(column(ff.rolling_mean(series(spark, [1, 2]), "x", 3, output="r", nan_output=True, **ORDER))[0])


def test_partitions_do_not_matter(spark, table):
    before = ff.get_parallelism(spark)
    found = []
    for n in (1, 8):
        ff.set_parallelism(spark, n)
        found.append(column(ff.rolling_std(table, "x", W, output="r", **ORDER)))
    ff.set_parallelism(spark, before)
    assert found[0] == found[1]


def test_streaming(spark, tmp_path):
    from frameflow.streaming import rolling_stream

    for k in range(2):
        spark.createDataFrame([("a", i, float(i)) for i in range(5 * k, 5 * k + 5)], "s string, t long, x double").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, t long, x double").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    query = rolling_stream(stream, "x", 3, "t", "s", output="r").writeStream.format("memory").queryName("rolled").start()
    query.processAllAvailable()
    query.stop()
    assert [r.r for r in spark.sql("SELECT r FROM rolled ORDER BY t").collect()] == [None, None, *[float(i) for i in range(1, 9)]]


@pytest.mark.parametrize("columns", [3, 4, 10])
def test_each_moment_is_evaluated_once(spark, columns):
    """Rows, and of each column valid values, variance and mean square; of each pair the covariance."""
    df = spark.range(5).selectExpr("id AS t", *[f"rand({k}) AS c{k}" for k in range(columns)])
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    for f in (ff.rolling_corr_matrix, ff.rolling_corr_pairs):
        plan = f(df, [f"c{k}" for k in range(columns)], 4, order_by="t")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("windowspecdefinition") == 1 + 3 * columns + columns * (columns - 1) // 2
        assert plan.count("Window [") == 1


@pytest.mark.parametrize("k", [5, 16])
def test_many_regressors(spark, k):
    """Against a least-squares solver, also about a mean of a million."""
    rng = np.random.default_rng(k)
    x = rng.normal(size=(120, k)) + 1e3
    y = x @ rng.normal(size=k) + rng.normal(size=120) + 1e6
    rows = [(i, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    names = [f"x{j}" for j in range(k)]
    df = spark.createDataFrame(rows, "t long, y double, " + ", ".join(f"{c} double" for c in names))
    found = ff.rolling_multiple_regression(df, "y", names, 60, order_by="t", output="r").orderBy("t").collect()
    for i in (59, 80, 119):
        a = np.c_[np.ones(60), x[i - 59 : i + 1]]
        wanted = np.linalg.lstsq(a, y[i - 59 : i + 1], rcond=None)[0]
        assert found[i].r.coef == pytest.approx(wanted.tolist(), rel=1e-5, abs=1e-5)
    assert all(r.r.coef is None for r in found[:59])


def test_wide_matrix(spark):
    """Fifty columns, the most that correlations take, against numpy."""
    x = np.random.default_rng(2).normal(size=(12, 50))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t long, " + ", ".join(f"c{j} double" for j in range(50)))
    last = ff.rolling_corr_matrix(df, [f"c{j}" for j in range(50)], 10, order_by="t").orderBy("t").collect()[-1]
    assert np.array(last["corr_matrix"]) == pytest.approx(np.corrcoef(x[2:].T), abs=1e-9)
