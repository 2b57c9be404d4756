"""Runs a builder of result columns over a frame, by the layout asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import finite, nan_if_null
from ..plans.frames import OWN, Series, check_columns
from ..plans.halo import BLOCK, HALO, NUMBER, halo_blocks

#: series: one task per series (hash of the partition columns). halo: blocks of one series in many tasks.
LAYOUTS = ("series", "halo")


class Frame:
    """The frame of an operator. Called with an aggregate it gives the aggregate over the frame; equal ones are one column of the window operator,
    which Spark would else evaluate once for each use."""

    def __init__(self, spec: WindowSpec):
        self.spec, self.found = spec, {}

    def __call__(self, aggregate: Column) -> Column:
        return F.col(self.found.setdefault(str(aggregate), (f"{OWN}a{len(self.found)}", aggregate))[0])

    def columns(self) -> dict[str, Column]:
        return {name: aggregate.over(self.spec) for name, aggregate in self.found.values()}


def apply(df: DataFrame, series: Series, columns: list[str], build: Callable[[list[Column], Frame], dict[str, Column]], nan_output: bool = False, layout: str = "series") -> DataFrame:
    """df with the built columns appended. build gets the cleaned value columns and the frame."""
    check_columns(df, columns)
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    rows, extra = (halo_blocks(df, series), [BLOCK]) if layout == "halo" else (df, [])
    cleaned = [f"{OWN}x{i}" for i in range(len(columns))]
    rows = rows.withColumns({t: finite(F.col(f"`{c}`")) for t, c in zip(cleaned, columns, strict=True)})
    frame = Frame(series.frame(extra))
    made = build([F.col(t) for t in cleaned], frame)
    if nan_output:
        made = {name: nan_if_null(c) for name, c in made.items()}
    out = rows.withColumns(frame.columns()).withColumns(made)
    if layout == "halo":
        out = out.where(~F.col(HALO))
    return out.drop(*cleaned, *frame.columns(), BLOCK, NUMBER, HALO)


def count_rows(w: Frame) -> Column:
    return w(F.count(F.lit(1)))
