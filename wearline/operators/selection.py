"""Choice of columns and rows, order of columns, casts."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.frame import NUMERIC, TEMPORAL, Frame
from wearline.plans.graph import Step

__all__ = [
    "ByNameFeatureSelector", "ByTypeFeatureSelector", "CastTo", "DiscardByNameFeatureSelector", "IdentityTransformerStep", "MatchFeatureSelector",
    "NullProportionSelector", "PandasToNumpy", "PandasVarianceThreshold", "PositionFeatures", "RelativePosition", "RelativeToEnd", "RelativeToStart", "SliceRows",
    "ToDateTime", "column_names_window", "find_feature",
]


def find_feature(columns: Sequence[str], name: str) -> str | None:
    """The first column whose name contains ``name``."""
    return next((c for c in columns if name in c), None)


def column_names_window(columns: Sequence[str], window: int) -> list[str]:
    """Names of the cells of a window, row by row."""
    return [f"w_{i + 1}_{c}" for i in range(window) for c in columns]


class IdentityTransformerStep(Step):
    def apply(self, frame: Frame) -> Frame:
        return frame


class PandasToNumpy(Step):
    """All features as one array of double."""

    def apply(self, frame: Frame) -> Frame:
        return frame.compute({"values": F.array(*(frame.col(c).cast("double") for c in frame.columns))})


class ByNameFeatureSelector(Step):
    """The listed features that exist, in the order asked for; all if none is listed."""

    def __init__(self, features: Sequence[str] = (), *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.features = list(features)

    def apply(self, frame: Frame) -> Frame:
        return frame.select([f for f in self.features if f in frame.held]) if self.features else frame


class DiscardByNameFeatureSelector(Step):
    def __init__(self, features: Sequence[str] = (), *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.features = list(features)

    def apply(self, frame: Frame) -> Frame:
        return frame.drop(self.features)


class PositionFeatures(Step):
    """Swap features into the given places."""

    def __init__(self, features: dict[str, int], *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.features = features

    def apply(self, frame: Frame) -> Frame:
        names = frame.columns
        for feature, place in self.features.items():
            now = names.index(feature)
            names[place], names[now] = names[now], names[place]
        return frame.select(names)


class MatchFeatureSelector(Step):
    """Features whose name contains a text."""

    def __init__(self, pattern: str, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.pattern = pattern

    def apply(self, frame: Frame) -> Frame:
        return frame.select(c for c in frame.columns if self.pattern in c)


class ByTypeFeatureSelector(Step):
    """Features of a kind: number, datetime, boolean, or category (all the rest); several may be named."""

    _KINDS = {"number": NUMERIC, "datetime": TEMPORAL, "bool": (T.BooleanType,), "object": (T.StringType,), "category": (T.StringType, T.BooleanType)}

    def __init__(self, type_: str | Sequence[str] = "number", *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.types = tuple(t for k in ([type_] if isinstance(type_, str) else type_) for t in self._KINDS[k])

    def apply(self, frame: Frame) -> Frame:
        return frame.select(c for c in frame.columns if isinstance(frame.type_of(c), self.types))


class _Threshold(Step):
    """Keep features that pass a test: in every cycle, or over all rows if ``per_cycle`` is off."""

    fitted = True

    def __init__(self, *, per_cycle: bool = True, name: str | None = None) -> None:
        super().__init__(name=name)
        self.per_cycle = per_cycle

    def _value(self, frame: Frame, name: str) -> Column:
        raise NotImplementedError

    def _passes(self, value: Column) -> Column:
        raise NotImplementedError

    def _candidates(self, frame: Frame) -> list[str]:
        return frame.columns

    def learn(self, frame: Frame) -> dict:
        names = self._candidates(frame)
        values = frame.per_cycle({n: self._value(frame, n) for n in names}) if self.per_cycle else frame.rows.df.agg(*(self._value(frame, n).alias(n) for n in names))
        row = values.agg(*(F.min(F.coalesce(self._passes(F.col(f"`{n}`")), F.lit(False)).cast("int")).alias(n) for n in names)).first() if names else {}
        kept = [n for n in names if row[n]]
        if len(kept) < len(names) / 2:
            warnings.warn(f"{self.name} keeps {len(kept)} of {len(names)} features", stacklevel=2)
        return {"features": kept}

    def apply(self, frame: Frame) -> Frame:
        return frame.select(self.params["features"])


class PandasVarianceThreshold(_Threshold):
    """Numeric features whose sample variance is above a limit."""

    def __init__(self, min_variance: float, **kwargs) -> None:
        super().__init__(**kwargs)
        self.min_variance = min_variance

    def _candidates(self, frame: Frame) -> list[str]:
        return frame.numeric

    def _value(self, frame: Frame, name: str) -> Column:
        return F.var_samp(frame.col(name))

    def _passes(self, value: Column) -> Column:
        return value > self.min_variance


class NullProportionSelector(_Threshold):
    """Features whose share of NULL is below a limit."""

    def __init__(self, max_null_proportion: float, **kwargs) -> None:
        super().__init__(**kwargs)
        self.max_null_proportion = max_null_proportion

    def _value(self, frame: Frame, name: str) -> Column:
        return F.avg(frame.col(name).isNull().cast("double"))

    def _passes(self, value: Column) -> Column:
        return value < self.max_null_proportion


class RelativePosition:
    """A row position that depends on the cycle's length."""

    def __init__(self, i: int) -> None:
        self.i = i

    def at(self, size: Column) -> Column:
        raise NotImplementedError


class RelativeToStart(RelativePosition):
    def at(self, size: Column) -> Column:
        return F.lit(self.i)


class RelativeToEnd(RelativePosition):
    def at(self, size: Column) -> Column:
        return F.greatest(size - self.i, F.lit(0))


class SliceRows(Step):
    """Rows from one position up to another; positions stay."""

    def __init__(self, initial: RelativePosition | None = None, final: RelativePosition | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.initial, self.final = initial or RelativeToStart(0), final or RelativeToEnd(0)

    def apply(self, frame: Frame) -> Frame:
        relative = any(isinstance(p, RelativeToEnd) for p in (self.initial, self.final))
        held = frame.rows.add({"size": F.count("*").over(frame.whole)})["size"] if relative else None
        size = F.col(held) if held else F.lit(0)
        pos = F.col(frame.pos)
        return frame.where((pos >= self.initial.at(size)) & (pos < self.final.at(size)))


class CastTo(Step):
    """All features to one type, by its SQL or NumPy name."""

    _NAMES = {"float32": "float", "float64": "double", "float": "double", "int": "bigint", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "str": "string", "bool": "boolean"}

    def __init__(self, type: str, *, name: str | None = None) -> None:  # noqa: A002
        super().__init__(name=name)
        self.type = self._NAMES.get(type, type)

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda c: c.cast(self.type), frame.columns)


class ToDateTime(Step):
    """Numbers since the epoch (in ``units``) or texts to timestamps."""

    _UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1, "m": 60_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000, "d": 86_400_000_000}

    def __init__(self, units: str = "s", columns: Sequence[str] | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        if units not in self._UNITS:
            raise ValueError(f"unknown unit {units}")
        if not columns:
            raise ValueError("columns must be given")
        self.units, self.chosen = units, list(columns)

    def _convert(self, frame: Frame, name: str) -> Column:
        c = frame.col(name)
        if isinstance(frame.type_of(name), T.StringType):
            return F.to_timestamp(c)
        return F.timestamp_micros(F.round(c * self._UNITS[self.units]).cast("bigint"))

    def apply(self, frame: Frame) -> Frame:
        new = frame.rows.add({n: self._convert(frame, n) for n in self.chosen})
        return Frame(frame.rows, {**frame.held, **new})
