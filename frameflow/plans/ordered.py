"""Rows of series in order, in Arrow batches: for results that the window operator has no built-in for, or only at a great cost for each row.

A task sees its series one after another as batches of bounded size, and what it keeps between batches does not grow with a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import OWN, Series

#: A row's number in its series (or, with a halo, in its block), from 1.
PLACE = f"{OWN}place"

#: Takes the places and the value columns (NaN where invalid) of the next rows and gives the result columns (NaN for nothing).
Step = Callable[..., Sequence[np.ndarray]]


def in_order(rows: DataFrame, series: Series, values: Sequence[str], start: Callable[[], Step], results: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """rows with PLACE and the results, doubles, appended. start begins a task; its step then gets the rows of all series of the task in turn."""
    # The window operator gathers and sorts each series (it spills what memory does not hold) and hands its rows on in that order.
    placed = rows.withColumn(PLACE, F.row_number().over(series.spec(extra)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for part in batches:
            column = lambda c: part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            made = step(column(PLACE), *[column(c).astype(float) for c in values])
            arrays = [pa.array(v, pa.float64(), from_pandas=True) for v in made]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *results])

    return placed.mapInArrow(run, T.StructType([*placed.schema.fields, *[T.StructField(c, T.DoubleType()) for c in results]]))


class Tail:
    """The last rows of the batches before, put in front of the next."""

    def __init__(self, rows: int, columns: int):
        self.rows, self.kept = rows, [np.full(rows, np.nan)] * columns

    def before(self, values: Sequence[np.ndarray]) -> list[np.ndarray]:
        joined = [np.concatenate(p) for p in zip(self.kept, values, strict=True)]
        self.kept = [v[len(v) - self.rows :].copy() for v in joined]
        return joined


def moments(joined: Sequence[np.ndarray], place: np.ndarray, w: int) -> tuple[np.ndarray, list[np.ndarray], dict[tuple[int, int], np.ndarray]]:
    """Rows, means and (population) covariances of columns i <= j of the frame of each row; NaN where an invalid value is in it.

    The columns begin w - 1 rows before the first place.
    """
    n, m = len(place), np.minimum(place, w).astype(float)
    early = np.flatnonzero(place < w)

    def lagged(v: np.ndarray, lag: int, mean: np.ndarray | float) -> np.ndarray:
        out = v[w - 1 - lag : w - 1 - lag + n] - mean
        out[early[place[early] <= lag]] = 0.0  # beyond the start of the series
        return out

    with np.errstate(invalid="ignore", over="ignore"):
        means = [sum(lagged(v, lag, 0.0) for lag in range(w)) / m for v in joined]
        products = {(i, j): np.zeros(n) for i in range(len(joined)) for j in range(i, len(joined))}
        for lag in range(w):
            apart = [lagged(v, lag, mean) for v, mean in zip(joined, means, strict=True)]
            for (i, j), total in products.items():
                total += apart[i] * apart[j]
        return m, means, {k: total / m for k, total in products.items()}
