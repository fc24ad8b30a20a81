"""Outlier removal: values beyond limits become infinities, NULL, the limit itself, or a mask."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline.frame import Frame
from wearline.functions.kernels import IsolationForest
from wearline.functions.stats import quantile
from wearline.operators.scaling import ColumnStep, clipped
from wearline.plans.graph import Step
from wearline.shipping import ship

__all__ = ["BeyondQuartileOutlierRemover", "EWMAOutOfRange", "IQROutlierRemover", "IsolationForestOutlierRemover", "RollingMeanOutlierRemover", "ZScoreOutlierRemover"]

INF = float("inf")


class IQROutlierRemover(ColumnStep):
    """Values beyond the quartiles by more than ``margin`` interquartile ranges become -inf or inf, or the limit if ``clip``."""

    def __init__(self, lower_quantile: float = 0.25, upper_quantile: float = 0.75, margin: float = 1.5, proportion_to_sample: float = 1.0, clip: bool = False, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.lower_quantile, self.upper_quantile, self.margin, self.clip = lower_quantile, upper_quantile, margin, clip
        self.proportion_to_sample = proportion_to_sample

    def learn(self, frame: Frame) -> dict:
        if self.proportion_to_sample < 1:
            # The sample is a parameter of the step; a hash of the row's place makes it repeatable.
            frame = frame.where(F.pmod(F.xxhash64(frame.cycle, frame.pos), F.lit(1_000_000)) < int(self.proportion_to_sample * 1_000_000))
        return super().learn(frame)

    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"low": quantile(x, self.lower_quantile), "high": quantile(x, self.upper_quantile)}

    def express(self, x: Column, p: dict) -> Column:
        width = p["high"] - p["low"]
        low, high = p["low"] - self.margin * width, p["high"] + self.margin * width
        if self.clip:
            return clipped(x, low, high)
        return F.when(x < low, F.lit(-INF)).when(x > high, F.lit(INF)).otherwise(x.cast("double"))


class BeyondQuartileOutlierRemover(IQROutlierRemover):
    """Values beyond the two quantiles themselves."""

    def __init__(self, lower_quantile: float = 0.25, upper_quantile: float = 0.75, subsample: float = 1.0, clip: bool = False, *, name: str | None = None) -> None:
        super().__init__(lower_quantile, upper_quantile, 0.0, subsample, clip, name=name)


class ZScoreOutlierRemover(ColumnStep):
    """z-scores (population std); those beyond the limit become NULL, and so do all without spread."""

    def __init__(self, number_of_std_allowed: float, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.number_of_std_allowed = number_of_std_allowed

    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"mean": F.avg(x), "std": F.stddev_pop(x)}

    def express(self, x: Column, p: dict) -> Column:
        if not p["std"]:
            return F.lit(None).cast("double")
        z = (x - p["mean"]) / p["std"]
        return F.when(F.abs(z) <= self.number_of_std_allowed, z)


class EWMAOutOfRange(Step):
    """Control limits mean ± 3 sqrt(λ / (2 - λ)) std; the widest over the cycles, or those of all rows.

    Values beyond become NULL, or the feature a 0/1 mask.
    """

    fitted = True

    def __init__(self, lambda_: float = 0.5, return_mask: bool = False, per_cycle: bool = False, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.lambda_, self.return_mask, self.per_cycle = lambda_, return_mask, per_cycle

    def learn(self, frame: Frame) -> dict:
        k = 3 * (self.lambda_ / (2 - self.lambda_)) ** 0.5
        limits = {}
        for n in frame.numeric:
            mean, std = F.avg(frame.col(n)), F.stddev_pop(frame.col(n))
            limits |= {f"{n}\0low": mean - k * std, f"{n}\0high": mean + k * std}
        if self.per_cycle:
            each = frame.per_cycle({str(i): c for i, c in enumerate(limits.values())})
            row = each.agg(*((F.min if key.endswith("low") else F.max)(str(i)) for i, key in enumerate(limits))).first()
            found = dict(zip(limits, row, strict=True))
        else:
            found = frame.agg(limits)
        out: dict = {}
        for key, value in found.items():
            name, side = key.split("\0")
            out.setdefault(name, {})[side] = value
        return out

    def apply(self, frame: Frame) -> Frame:
        def one(n: str) -> Column:
            x, p = frame.col(n), self.params[n]
            if p["low"] is None:
                return x
            beyond = (x < p["low"]) | (x > p["high"])
            return beyond.cast("int") if self.return_mask else F.when(~beyond, x)

        new = frame.rows.add({n: one(n) for n in frame.numeric if n in self.params})
        return Frame(frame.rows, {n: new.get(n, h) for n, h in frame.held.items()})


class RollingMeanOutlierRemover(Step):
    """Rolling median ± λ interquartile ranges: values are clipped to it, or masked 0/1."""

    def __init__(self, window: int = 15, lambda_: float = 3, return_mask: bool = False, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window, self.lambda_, self.return_mask = window, lambda_, return_mask

    def apply(self, frame: Frame) -> Frame:
        w = frame.rolling(self.window)

        def one(x: Column) -> Column:
            low, middle, high = (F.percentile(x, F.lit(q)).over(w) for q in (0.25, 0.5, 0.75))
            reach = self.lambda_ * (high - low)
            # As with pandas' rolling quantiles, only whole windows have limits.
            full = F.count(x).over(w) >= self.window
            below, above = full & (x < middle - reach), full & (x > middle + reach)
            if self.return_mask:
                return F.coalesce(below | above, F.lit(False)).cast("int")
            return F.when(below, middle - reach).when(above, middle + reach).otherwise(x)

        return frame.each(one)


def _flagger(params: dict) -> Callable[[pd.Series], pd.Series]:
    """Which values a fitted forest holds for outliers; a missing one is none."""

    def flagged(values):
        forest = IsolationForest.from_json(params)
        x = values.to_numpy(dtype=float)
        out = np.zeros(len(x), dtype=bool)
        good = np.isfinite(x)
        out[good] = forest.outliers(x[good])
        return pd.Series(out)

    flagged.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return flagged


class IsolationForestOutlierRemover(Step):
    """An isolation forest for each feature, fitted on a bounded sample; outliers become NULL.

    ``max_rows`` bounds the sample: rows are chosen by a hash of their place.
    """

    fitted = True

    def __init__(self, n_estimators: int = 100, max_rows: int = 10_000, seed: int = 0, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.n_estimators, self.max_rows, self.seed = n_estimators, max_rows, seed

    def learn(self, frame: Frame) -> dict:
        n = frame.rows.df.count()
        share = min(1.0, self.max_rows / max(1, n))
        sample = frame.where(F.pmod(F.xxhash64(frame.cycle, frame.pos), F.lit(1_000_000)) < int(share * 1_000_000))
        data = sample.df.orderBy(frame.cycle, frame.pos).limit(2 * self.max_rows).toPandas()
        out = {}
        for name in frame.numeric:
            values = data[name].dropna().to_numpy(dtype=float)
            if len(values):
                out[name] = IsolationForest.fit(values, self.n_estimators, self.seed).to_json()
        return out

    def apply(self, frame: Frame) -> Frame:
        ship(frame.rows.df.sparkSession)
        new = {}
        for name in frame.numeric:
            if name in self.params:
                flag = F.pandas_udf(_flagger(self.params[name]), "boolean")
                new[name] = F.when(~flag(frame.col(name).cast("double")), frame.col(name))
        held = frame.rows.add(new)
        return Frame(frame.rows, {n: held.get(n, h) for n, h in frame.held.items()})
