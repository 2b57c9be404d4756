"""Rolling statistics of a stream: row frames, which Spark's own windows do not offer on streams.

The state of a series is its last window - 1 values, held in the state store. Within a micro-batch rows are taken in order; a row whose order value lies
before the latest one seen is late and is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.frames import Series, check_columns

STATISTICS = {"sum": np.sum, "mean": np.mean, "min": np.min, "max": np.max, "var": lambda v: np.var(v, ddof=1), "std": lambda v: np.std(v, ddof=1)}


def rolling_stream(df: DataFrame, x: str, window: int, order_by: str, partition_by, statistic: str = "mean", min_periods: int | None = None, output: str | None = None) -> DataFrame:
    """df with the statistic appended; frames with an invalid value, or too short, emit NULL. order_by is one numeric column."""
    series = Series.rolling(order_by, partition_by, window, min_periods)
    check_columns(df, [x, order_by])
    if statistic not in STATISTICS:
        raise ValueError(f"statistic must be one of {', '.join(STATISTICS)}")
    if not series.partition_by:
        raise ValueError("a stream needs partition_by: its state is kept by series")
    f, name, w, mp = STATISTICS[statistic], output or f"{statistic}_{x}", series.window, series.min_periods
    least = 2 if statistic in ("var", "std") else 1
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, latest = (list(state.get[0]), state.get[1]) if state.exists else ([], -math.inf)
        rows = pd.concat(list(parts)).sort_values(order_by, kind="stable")
        rows = rows[rows[order_by] >= latest]
        found = []
        for v in rows[x].to_numpy(float):
            values = [*values[-(w - 1) :], float(v)] if w > 1 else [float(v)]
            ok = len(values) >= max(mp, least) and np.isfinite(values).all()
            found.append(float(f(values)) if ok else None)
        if len(rows):
            state.update((values[-(w - 1) :] if w > 1 else [], float(rows[order_by].iloc[-1])))
            yield rows.assign(**{name: pd.array(found, dtype="Float64")})

    return df.groupBy(*series.partition_by).applyInPandasWithState(run, schema, "held array<double>, latest double", "append", GroupStateTimeout.NoTimeout)
