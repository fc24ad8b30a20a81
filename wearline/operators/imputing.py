"""Filling of missing values and of the infinities that outlier steps leave."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline.frame import Frame
from wearline.functions.stats import finite, quantile
from wearline.operators.scaling import ColumnStep
from wearline.plans.graph import Step

__all__ = [
    "ApplyRollingImputer", "BackwardFillImputer", "FillImputer", "ForwardFillImputer", "MeanImputer", "MedianImputer", "NaNtoInf", "PerColumnImputer",
    "RollingMeanImputer", "RollingMedianImputer",
]

INF = float("inf")


class PerColumnImputer(ColumnStep):
    """inf to the greatest finite value, -inf to the least, NULL to the median."""

    def aggregates(self, x: Column) -> dict[str, Column]:
        x = finite(x)
        return {"low": F.min(x), "high": F.max(x), "median": quantile(x, 0.5)}

    def express(self, x: Column, p: dict) -> Column:
        return F.when(x == INF, F.lit(p["high"])).when(x == -INF, F.lit(p["low"])).when(x.isNull(), F.lit(p["median"])).otherwise(x)


class NaNtoInf(Step):
    """Infinities become missing (the name is historical)."""

    def apply(self, frame: Frame) -> Frame:
        return frame.each(finite)


class MedianImputer(ColumnStep):
    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"median": quantile(finite(x), 0.5)}

    def express(self, x: Column, p: dict) -> Column:
        return F.coalesce(x, F.lit(p["median"]))


class MeanImputer(ColumnStep):
    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"mean": F.avg(finite(x))}

    def express(self, x: Column, p: dict) -> Column:
        return F.coalesce(x, F.lit(p["mean"]))


class FillImputer(Step):
    def __init__(self, value: float, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.value = value

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: F.coalesce(x, F.lit(self.value)), frame.columns)


class ForwardFillImputer(Step):
    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: F.last(x, ignorenulls=True).over(frame.expanding), frame.columns)


class BackwardFillImputer(Step):
    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: F.first(x, ignorenulls=True).over(frame.following), frame.columns)


class _RollingImputer(ColumnStep):
    """Bad cells become an aggregate of the finite values from ``window`` rows before to ``window - 1`` after, or else the column's."""

    def __init__(self, window_size: int, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window_size = window_size

    def statistic(self, x: Column) -> Column:
        raise NotImplementedError

    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"default": F.avg(finite(x))}

    def apply(self, frame: Frame) -> Frame:
        w = frame.ordered.rowsBetween(-self.window_size, self.window_size - 1)

        def one(x: Column, p: dict) -> Column:
            good = finite(x.cast("double"))
            return F.coalesce(good, self.statistic(good).over(w), F.lit(p["default"]))

        new = frame.rows.add({n: one(frame.col(n), self.params[n]) for n in frame.numeric if n in self.params})
        return Frame(frame.rows, {n: new.get(n, h) for n, h in frame.held.items()})


class RollingMeanImputer(_RollingImputer):
    def statistic(self, x: Column) -> Column:
        return F.avg(x)


class RollingMedianImputer(_RollingImputer):
    def statistic(self, x: Column) -> Column:
        return F.percentile(x, F.lit(0.5))


class ApplyRollingImputer(_RollingImputer):
    """The same with any function of an array; earlier fills are seen by later ones, so a cycle is one pass.

    The function gets the ``2 * window`` cells around, the bad one included; where its result is not
    finite, the column's mean is taken.
    """

    def __init__(self, window_size: int, func: Callable[[np.ndarray], float], *, name: str | None = None) -> None:
        super().__init__(window_size, name=name)
        self.func = func

    def apply(self, frame: Frame) -> Frame:
        names = [n for n in frame.numeric if n in self.params]
        size, func, params = self.window_size, self.func, self.params

        def run(part: pd.DataFrame) -> pd.DataFrame:
            out = {}
            for n in part.columns:
                values = part[n].to_numpy(dtype=float, copy=True)
                for r in np.flatnonzero(~np.isfinite(values)):
                    found = func(values[max(0, r - size) : r + size])
                    values[r] = found if np.isfinite(found) else params[n]["default"]
                out[n] = values
            return pd.DataFrame(out)

        done = frame.kernel({n: "double" for n in names}, run, names)
        return Frame(frame.rows, {n: done.held.get(n, h) for n, h in frame.held.items()})


