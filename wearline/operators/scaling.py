"""Scalers and centring: one aggregation to fit, an expression to apply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline.frame import Frame
from wearline.functions.quantiles import Quantile
from wearline.functions.stats import quantile
from wearline.plans.graph import Step

__all__ = [
    "MeanCentering", "MedianCentering", "MinMaxScaler", "PerCategoricalMinMaxScaler", "RobustMinMaxScaler", "RobustStandardScaler", "ScaleInvRUL", "StandardScaler",
]

#: Spreads up to this count as none.
NO_SPREAD = 1e-12


class ColumnStep(Step):
    """Learns some aggregates of each numeric feature and applies an expression of them."""

    fitted = True

    def aggregates(self, x: Column) -> dict[str, Column]:
        raise NotImplementedError

    def express(self, x: Column, p: dict) -> Column:
        raise NotImplementedError

    def learn(self, frame: Frame) -> dict:
        found = frame.agg({f"{n}\0{k}": c for n in frame.numeric for k, c in self.aggregates(frame.col(n)).items()})
        out: dict = {}
        for key, value in found.items():
            name, k = key.split("\0")
            out.setdefault(name, {})[k] = float(value) if value is not None else None
        return out

    def apply(self, frame: Frame) -> Frame:
        """Features that were not there when fitting stay as they are."""
        known = [n for n in frame.numeric if n in self.params]
        new = frame.rows.add({n: self.express(frame.col(n), self.params[n]) if None not in self.params[n].values() else frame.col(n) for n in known})
        return Frame(frame.rows, {n: new.get(n, h) for n, h in frame.held.items()})


def clipped(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


class MinMaxScaler(ColumnStep):
    """Linear map of [min, max] to a range; features of no width stay (or become ``fillna``)."""

    def __init__(self, range: tuple[float, float] = (0, 1), clip: bool = True, fillna: float | None = None, *, name: str | None = None) -> None:  # noqa: A002
        super().__init__(name=name)
        self.range, self.clip, self.fillna = range, clip, fillna

    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"low": F.min(x), "high": F.max(x)}

    def _scaled(self, x: Column, low: Column, width: Column) -> Column:
        a, b = map(float, self.range)
        still = F.lit(float(self.fillna)) if self.fillna is not None else x.cast("double")
        out = F.when(width > NO_SPREAD, (x - low) / width * (b - a) + a).otherwise(still)
        return clipped(out, a, b) if self.clip else out

    def express(self, x: Column, p: dict) -> Column:
        return self._scaled(x, F.lit(p["low"]), F.lit(p["high"] - p["low"]))


class RobustMinMaxScaler(MinMaxScaler):
    """The same between two quantiles; features of no width become 0."""

    def __init__(self, range: tuple[float, float] = (0, 1), clip: bool = True, lower_quantile: float = 0.25, upper_quantile: float = 0.75, *, name: str | None = None) -> None:  # noqa: A002
        super().__init__(range, clip, 0.0, name=name)
        self.lower_quantile, self.upper_quantile = lower_quantile, upper_quantile

    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"low": quantile(x, self.lower_quantile), "high": quantile(x, self.upper_quantile)}


class StandardScaler(ColumnStep):
    """(x - mean) / std of all rows; features of no spread are only centred."""

    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"mean": F.avg(x), "std": F.stddev_samp(x)}

    def express(self, x: Column, p: dict) -> Column:
        return (x - p["mean"]) / (p["std"] if p["std"] > NO_SPREAD else 1.0)


class RobustStandardScaler(ColumnStep):
    """(x - median) / interquartile range."""

    def __init__(self, quantile_range: tuple[float, float] = (0.25, 0.75), *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.quantile_range = quantile_range

    def aggregates(self, x: Column) -> dict[str, Column]:
        low, high = self.quantile_range
        return {"median": quantile(x, 0.5), "low": quantile(x, low), "high": quantile(x, high)}

    def express(self, x: Column, p: dict) -> Column:
        width = p["high"] - p["low"]
        return (x - p["median"]) / (width if width > NO_SPREAD else 1.0)


class ScaleInvRUL(Step):
    """Binary features times 1 / median(1 + RUL / max RUL) where they are positive."""

    fitted = True

    def __init__(self, rul_column: str, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.rul_column = rul_column

    def _names(self, frame: Frame) -> list[str]:
        return [n for n in frame.numeric if n != self.rul_column]

    def learn(self, frame: Frame) -> dict:
        rul = frame.col(self.rul_column)
        most = frame.agg({"most": F.max(rul)})["most"] or 1.0
        share = 1 + rul / F.lit(float(most))
        return {n: (1 / v if v else None) for n, v in frame.agg({n: quantile(F.when(frame.col(n) > 0, share), 0.5) for n in self._names(frame)}).items()}

    def apply(self, frame: Frame) -> Frame:
        new = frame.rows.add({n: frame.col(n) * F.lit(self.params.get(n) or 1.0) for n in self._names(frame)})
        return Frame(frame.rows, {n: new[n] for n in self._names(frame)})


class MeanCentering(ColumnStep):
    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"mean": F.avg(x)}

    def express(self, x: Column, p: dict) -> Column:
        return x - p["mean"]


class MedianCentering(ColumnStep):
    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"median": quantile(x, 0.5)}

    def express(self, x: Column, p: dict) -> Column:
        return x - p["median"]


class PerCategoricalMinMaxScaler(Step):
    """A scaler for each category, and one of all rows for unseen ones: one aggregation by category.

    The categories are a small table that becomes literals; more than ``MAX_LITERALS`` are refused.
    """

    fitted = True
    MAX_LITERALS = 1000

    def __init__(self, categorical_feature: str, scaler: type[ColumnStep] = MinMaxScaler, scaler_params: dict | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.categorical_feature = categorical_feature
        self.scaler = scaler(**{"range": (-1, 1), **(scaler_params or {})} if issubclass(scaler, MinMaxScaler) else scaler_params or {})

    def _names(self, frame: Frame) -> list[str]:
        return [n for n in frame.numeric if n != self.categorical_feature]

    def learn(self, frame: Frame) -> dict:
        names, category = self._names(frame), frame.col(self.categorical_feature).cast("string")
        keys = [(n, k, c) for n in names for k, c in self.scaler.aggregates(frame.col(n)).items()]
        columns = [(c.column if isinstance(c, Quantile) else c).alias(f"_{i}") for i, (_, _, c) in enumerate(keys)]
        rows = [(r[0], r[1:]) for r in frame.rows.df.filter(category.isNotNull()).groupBy(category).agg(*columns).limit(self.MAX_LITERALS + 1).collect()]
        if len(rows) > self.MAX_LITERALS:
            raise ValueError(f"more than {self.MAX_LITERALS} categories")
        rows.append((None, tuple(frame.rows.df.agg(*columns).first())))
        out: dict = {"categories": [], "names": names}
        for category_value, values in sorted(rows, key=lambda r: (r[0] is None, r[0] or "")):
            params: dict = {}
            for (n, k, _), v in zip(keys, values, strict=True):
                params.setdefault(n, {})[k] = float(v) if v is not None else None
            out["categories"].append([category_value, params])
        return out

    def apply(self, frame: Frame) -> Frame:
        category = frame.col(self.categorical_feature).cast("string")
        new = {}
        for n in self.params["names"]:
            x, value = frame.col(n), None
            for key, params in self.params["categories"]:
                if key is not None:
                    scaled = self.scaler.express(x, params[n]) if None not in params[n].values() else x.cast("double")
                    value = F.when(category == key, scaled) if value is None else value.when(category == key, scaled)
            rest = self.params["categories"][-1][1][n]
            other = self.scaler.express(x, rest) if None not in rest.values() else x.cast("double")
            new[n] = other if value is None else value.otherwise(other)
        held = frame.rows.add(new)
        return Frame(frame.rows, {n: held.get(n, h) for n, h in frame.held.items() if n != self.categorical_feature})
