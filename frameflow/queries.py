"""One query for each operator, with its SQL for DuckDB where SQL can express it.

Series: events by type, lineitem by supplier, orders by customer, and all events as one series. Invalid values are put in where id % 17 = 0. Results
are rounded alike on both sides, as the engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .sources import read_table

W, HALF = 20, 8

EVENTS = {"partition_by": ["event_type"], "order_by": ["ts", "event_id"]}
ITEMS = {"partition_by": ["l_suppkey"], "order_by": ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]}
ORDERS = {"partition_by": ["o_custkey"], "order_by": ["o_orderdate", "o_orderkey"]}

_FRAME = "ROWS BETWEEN {0} PRECEDING AND CURRENT ROW"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", gaps.alias("x"), (F.col("user_id") % 97).cast("double").alias("y"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*ITEMS["partition_by"], *ITEMS["order_by"]]
    gaps = F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity"))
    return read_table(spark, sf_dir, "lineitem").select(*keys, gaps.alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"), F.col("l_tax").alias("t"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice"))
    return read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", gaps.alias("y"))


_SOURCES = {
    "events": (_events, EVENTS, ["event_id"], "SELECT event_id, ts, event_type, CASE WHEN event_id % 17 <> 0 THEN value END AS x, CAST(user_id % 97 AS DOUBLE) AS y FROM events"),
    "items": (_items, ITEMS, ["l_suppkey", *ITEMS["order_by"]], "SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END AS x, l_extendedprice AS y, l_discount AS z, l_tax AS t FROM lineitem"),
    "orders": (_orders, ORDERS, ["o_custkey", "o_orderdate", "o_orderkey"], "SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS y FROM orders"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, source: str, run, results: list[str], sql: dict[str, str] | None = None, frame: int | None = W, digits: int = 6, whole: bool = False, rank: bool = False) -> None:
    """run(df, **order) -> DataFrame with the results; sql gives each by window w (and, with rank, the row's number n0)."""
    read, order, keys, table = _SOURCES[source]
    order = order if not whole else {"order_by": order["order_by"]}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(read(spark, sf_dir), **order)
        return out.select(*keys, *[F.round(F.col(r) + 10.0 ** -(digits + 2), digits).alias(r) for r in results])

    QUERIES[name] = query
    if sql:
        part = f"PARTITION BY {', '.join(order['partition_by'])} " if not whole else ""
        over = f"{part}ORDER BY {', '.join(order['order_by'])}"
        rows = _FRAME.format("UNBOUNDED" if frame is None else frame - 1)
        base = f"SELECT *, CAST(row_number() OVER ({over}) - 1 AS DOUBLE) AS n0 FROM ({table})" if rank else table
        made = ", ".join(f"round({sql[r]} + 1e-{digits + 2}, {digits}) AS {r}" for r in results)
        SQL[name] = f"SELECT {', '.join(keys)}, {made} FROM ({base}) WINDOW w AS ({over} {rows})"


def _prop(value: str, mp: int = W, x: str = "x", extra: str = "") -> str:
    return f"CASE WHEN count({x}) OVER w = count(*) OVER w AND count(*) OVER w >= {mp}{extra} THEN {value} END"


def _skip(value: str, mp: int, x: str = "x", least: int = 1, extra: str = "") -> str:
    return f"CASE WHEN count({x}) OVER w >= {max(mp, least)}{extra} THEN {value} END"


_SPREAD = " AND var_pop(x) OVER w > 0"
_ONE = {  # operator, SQL of the value, least valid values, further condition
    "sum": (op.rolling_sum, "sum(x) OVER w", 1, ""),
    "mean": (op.rolling_mean, "avg(x) OVER w", 1, ""),
    "min": (op.rolling_min, "min(x) OVER w", 1, ""),
    "max": (op.rolling_max, "max(x) OVER w", 1, ""),
    "var": (op.rolling_var, "var_samp(x) OVER w", 2, ""),
    "std": (op.rolling_std, "stddev_samp(x) OVER w", 2, ""),
    "zscore": (op.rolling_zscore, "(x - avg(x) OVER w) / sqrt(var_samp(x) OVER w)", 2, f"{_SPREAD} AND x IS NOT NULL"),
    "skew": (op.rolling_skew, "skewness(x) OVER w", 3, _SPREAD),
    "kurt": (op.rolling_kurt, "kurtosis(x) OVER w", 4, _SPREAD),
}
for _name, (_f, _value, _least, _more) in _ONE.items():
    _add(f"rolling_{_name}", "events", lambda df, f=_f, **o: f(df, "x", W, output="r", **o), ["r"], {"r": _prop(_value, W, extra=_more)})
    _add(f"rolling_{_name}_skip", "events", lambda df, f=_f, **o: f(df, "x", W, min_periods=HALF, skip_nan=True, output="r", **o), ["r"], {"r": _skip(_value, HALF, least=_least, extra=_more)})
    _add(f"rolling_{_name}_early", "events", lambda df, f=_f, **o: f(df, "x", W, min_periods=HALF, output="r", **o), ["r"], {"r": _prop(_value, HALF, extra=_more)})
for _name in ("var", "std"):
    _f, _sql = _ONE[_name][0], {"var": "var_pop(x) OVER w", "std": "stddev_pop(x) OVER w"}[_name]
    _add(f"rolling_{_name}_ddof0", "events", lambda df, f=_f, **o: f(df, "x", W, ddof=0, output="r", **o), ["r"], {"r": _prop(_sql)})
for _name in ("sum", "mean", "min", "max", "var", "std"):
    _f, _value, _least, _more = _ONE[_name]
    _add(f"rolling_{_name}_blocked", "events", lambda df, f=_f, **o: f(df, "x", 60, min_periods=HALF, skip_nan=True, layout="blocked", output="r", **o), ["r"], {"r": _skip(_value, HALF, least=_least)}, frame=60)
_add("rolling_mean_one_series", "events", lambda df, **o: op.rolling_mean(df, "x", W, min_periods=HALF, skip_nan=True, layout="halo", output="r", **o), ["r"], {"r": _skip("avg(x) OVER w", HALF)}, whole=True)
for _q in (0.5, 0.9):
    _add(f"rolling_quantile_{round(100 * _q)}", "events", lambda df, q=_q, **o: op.rolling_quantile(df, "x", W, q=q, output="r", **o), ["r"], {"r": _prop(f"quantile_cont(x, {_q}) OVER w")})
_add("rolling_quantile_stream", "events", lambda df, **o: op.rolling_quantile(df, "x", W, exact=False, output="r", **o), ["r"])
_add("expanding_quantile_approx", "events", lambda df, **o: op.expanding_quantile_approx(df, "x", output="r", **o), ["r"])

_X, _Y = "CASE WHEN y IS NOT NULL THEN x END", "CASE WHEN x IS NOT NULL THEN y END"
_CORR = f"greatest(-1, least(1, covar_pop({_X}, {_Y}) OVER w / sqrt(var_pop({_X}) OVER w * var_pop({_Y}) OVER w)))"
_APART = f" AND var_pop({_X}) OVER w > 1e-14 * avg(({_X}) * ({_X})) OVER w AND var_pop({_Y}) OVER w > 1e-14 * avg(({_Y}) * ({_Y})) OVER w"
_add("rolling_cov", "items", lambda df, **o: op.rolling_cov(df, "x", "y", W, output="r", **o), ["r"], {"r": _prop(f"covar_samp({_X}, {_Y}) OVER w", x=_X)}, digits=4)
_add("rolling_cov_skip", "items", lambda df, **o: op.rolling_cov(df, "x", "y", W, min_periods=HALF, ddof=0, skip_nan=True, output="r", **o), ["r"], {"r": _skip(f"covar_pop({_X}, {_Y}) OVER w", HALF, x=_X)}, digits=4)
_add("rolling_corr", "items", lambda df, **o: op.rolling_corr(df, "x", "y", W, return_cov=True, output="r", **o), ["r", "r_cov"],
     {"r": _prop(_CORR, x=_X, extra=_APART), "r_cov": _prop(f"covar_samp({_X}, {_Y}) OVER w", x=_X)}, digits=4)
_add("rolling_corr_skip", "items", lambda df, **o: op.rolling_corr(df, "x", "y", W, min_periods=HALF, skip_nan=True, output="r", **o), ["r"], {"r": _skip(_CORR, HALF, x=_X, least=2, extra=_APART)})


def _fit(mx: str, my: str, vx: str, vy: str, cov: str, n: str, gate: Callable[[str, str], str]) -> dict[str, str]:
    fits = f" AND {n} >= 2 AND {n} * {n} * {vx} > 1e-12"
    slope = f"{cov} / {vx}"
    return {
        "r_intercept": gate(f"{my} - {slope} * {mx}", fits), "r_slope": gate(slope, fits),
        "r_r2": gate(f"greatest(0, least(1, {cov} * {cov} / ({vx} * {vy})))", f"{fits} AND CAST({n} AS DOUBLE) * {n} * {n} * {n} * {vx} * {vy} > 1e-12"),
    }


_RESULTS = ["r_intercept", "r_slope", "r_r2"]
_over = lambda f: f"{f} OVER w"
_add("rolling_regression_xy", "items", lambda df, **o: op.rolling_regression_xy(df, "y", "x", W, min_periods=HALF, output="r", **o), _RESULTS,
     _fit(*map(_over, (f"avg({_X})", f"avg({_Y})", f"var_pop({_X})", f"var_pop({_Y})", f"covar_pop({_X}, {_Y})", f"count({_X})")), lambda v, e: _prop(v, HALF, x=_X, extra=e)), digits=4)
_add("rolling_regression", "orders", lambda df, **o: op.rolling_regression(df, "y", 8, min_periods=3, output="r", **o), _RESULTS,
     _fit("((count(*) OVER w - 1) / 2.0)", "avg(y) OVER w", "((count(*) OVER w * count(*) OVER w - 1) / 12.0)", "var_pop(y) OVER w", "covar_pop(n0, y) OVER w", "count(*) OVER w", lambda v, e: _prop(v, 3, x="y", extra=e)), frame=8, digits=4, rank=True)
_T = "CASE WHEN y IS NOT NULL THEN n0 END"
_add("expanding_regression", "orders", lambda df, **o: op.expanding_regression(df, "y", output="r", **o), _RESULTS,
     _fit(*map(_over, (f"avg({_T})", "avg(y)", f"var_pop({_T})", "var_pop(y)", f"covar_pop({_T}, y)", "count(y)")), lambda v, e: _skip(v, 2, x="y", extra=e)), frame=None, digits=4, rank=True)
for _name, _value, _least in (("mean", "avg(y) OVER w", 1), ("sum", "sum(y) OVER w", 1), ("var", "var_samp(y) OVER w", 2), ("std", "stddev_samp(y) OVER w", 2)):
    _f = getattr(op, f"expanding_{_name}")
    _add(f"expanding_{_name}", "orders", lambda df, f=_f, **o: f(df, "y", output="r", **o), ["r"], {"r": _skip(_value, _least, x="y")}, frame=None, digits=0 if _name == "var" else 2)
for _name, _value in (("mean", "avg({0}) OVER w"), ("std", "stddev_samp({0}) OVER w"), ("sum", "sum({0}) OVER w"), ("min", "min({0}) OVER w"), ("max", "max({0}) OVER w")):
    _f, _columns = getattr(op, f"rolling_{_name}_2d"), ["x", "y", "z"]
    _add(f"rolling_{_name}_2d", "items", lambda df, f=_f, **o: f(df, ["x", "y", "z"], W, min_periods=HALF, **o), [f"{_name}_{c}" for c in _columns],
         {f"{_name}_{c}": _prop(_value.format(c), HALF, x=c) for c in _columns}, digits=4)


def _pair_sql(a: str, b: str) -> str:
    apart = " AND ".join(f"var_pop({c}) OVER w > 1e-14 * avg({c} * {c}) OVER w AND count({c}) OVER w = count(*) OVER w" for c in (a, b))
    value = f"greatest(-1, least(1, covar_pop({a}, {b}) OVER w / sqrt(var_pop({a}) OVER w * var_pop({b}) OVER w)))"
    return f"CASE WHEN count(*) OVER w >= {HALF} AND {apart} THEN {value} END"


_PAIRS = [(a, b) for i, a in enumerate("xyzt") for b in "xyzt"[i + 1 :]]
_add("rolling_corr_pairs", "items", lambda df, **o: op.rolling_corr_pairs(df, ["x", "y", "z", "t"], W, min_periods=HALF, layout="batches", **o), [f"corr_{a}_{b}" for a, b in _PAIRS], {f"corr_{a}_{b}": _pair_sql(a, b) for a, b in _PAIRS})


def _matrix(df: DataFrame, **o) -> DataFrame:
    out = op.rolling_corr_matrix(df, ["x", "y", "z"], W, min_periods=HALF, layout="batches", output="m", **o)
    return out.withColumns({f"m{i}{j}": F.col("m")[i][j] for i in range(3) for j in range(3)})


_add("rolling_corr_matrix", "items", _matrix, [f"m{i}{j}" for i in range(3) for j in range(3)],
     {f"m{i}{j}": "1.0" if i == j else _pair_sql(*("xyz"[k] for k in sorted((i, j)))) for i in range(3) for j in range(3)})

# Two regressors by Cramer's rule.
_C = {k: f"covar_pop({a}, {b}) OVER w" for k, (a, b) in {"aa": ("x", "x"), "ab": ("x", "z"), "bb": ("z", "z"), "ay": ("x", "y"), "by": ("z", "y")}.items()}
_DET = f"({_C['aa']} * {_C['bb']} - {_C['ab']} * {_C['ab']})"
_B1, _B2 = f"(({_C['ay']} * {_C['bb']} - {_C['by']} * {_C['ab']}) / {_DET})", f"(({_C['by']} * {_C['aa']} - {_C['ay']} * {_C['ab']}) / {_DET})"
_RSS = f"greatest(0, count(*) OVER w * (var_pop(y) OVER w - {_B1} * {_C['ay']} - {_B2} * {_C['by']}))"
_ok = lambda v: f"CASE WHEN count(x) OVER w = count(*) OVER w AND count(*) OVER w >= {W} AND {_DET} > 1e-9 THEN {v} END"
_add("rolling_multiple_regression", "items", lambda df, **o: op.rolling_multiple_regression(df, "y", ["x", "z"], W, output="r", flatten=True, **o), ["r_intercept", "r_x", "r_z", "r_r2", "r_residual_std"],
     {"r_intercept": _ok(f"avg(y) OVER w - {_B1} * avg(x) OVER w - {_B2} * avg(z) OVER w"), "r_x": _ok(_B1), "r_z": _ok(_B2), "r_r2": _ok(f"1 - {_RSS} / (count(*) OVER w * var_pop(y) OVER w)"),
      "r_residual_std": _ok(f"sqrt({_RSS} / (count(*) OVER w - 3))")}, digits=3)

_add("rolling_spearman", "events", lambda df, **o: op.rolling_spearman(df, "x", "y", 12, output="r", **o), ["r"])
SQL["rolling_spearman"] = """
    WITH b AS (SELECT event_id, event_type, x, y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k
               FROM (SELECT event_id, ts, event_type, CASE WHEN event_id % 17 <> 0 THEN value END AS x, CAST(user_id % 97 AS DOUBLE) AS y FROM events)),
    f AS (SELECT a.event_id, c.x, c.y FROM b a JOIN b c ON a.event_type = c.event_type AND c.k BETWEEN a.k - 11 AND a.k WHERE a.k >= 12),
    g AS (SELECT event_id, x, y, rank() OVER (PARTITION BY event_id ORDER BY x) + (count(*) OVER (PARTITION BY event_id, x) - 1) / 2.0 AS rx,
                 rank() OVER (PARTITION BY event_id ORDER BY y) + (count(*) OVER (PARTITION BY event_id, y) - 1) / 2.0 AS ry FROM f),
    h AS (SELECT event_id, CASE WHEN count(x) = 12 AND count(y) = 12 AND var_pop(rx) > 0 AND var_pop(ry) > 0
                 THEN greatest(-1, least(1, covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)))) END AS r FROM g GROUP BY event_id)
    SELECT b.event_id, round(h.r + 1e-8, 6) AS r FROM b LEFT JOIN h USING (event_id)"""


def parallelism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_parallelism, get_parallelism and runtime_info in one row; the setting is put back."""
    before = op.get_parallelism(spark)
    op.set_parallelism(spark, 3)
    seen = op.get_parallelism(spark)
    op.set_parallelism(spark, before)
    return spark.createDataFrame([(seen, "spark" in op.runtime_info(spark))], "partitions long, has_info boolean")


QUERIES["parallelism"] = parallelism
SQL["parallelism"] = "SELECT CAST(3 AS BIGINT) AS partitions, TRUE AS has_info"
