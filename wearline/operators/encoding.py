"""Categories to numbers, and targets from RUL."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.frame import Frame
from wearline.functions.kernels import integer_bytes, murmur3
from wearline.functions.stats import quantile
from wearline.operators.scaling import clipped
from wearline.plans.graph import Step
from wearline.shipping import ship

__all__ = ["HashingEncodingCategorical", "OneHotCategorical", "PicewiseRUL", "PicewiseRULQuantile", "RULBinarizer", "SimpleEncodingCategorical", "TargetToClasses"]

#: Categories become literals and columns: more are a mistake.
MAX_CATEGORIES = 10_000


class _Categories(Step):
    fitted = True

    def __init__(self, feature: str | None = None, categories: Sequence[str] | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.feature, self.categories = feature, categories

    def _feature(self, frame: Frame) -> str:
        return self.feature or frame.columns[0]

    def learn(self, frame: Frame) -> dict:
        if self.categories is not None:
            return {"categories": list(self.categories)}
        column = frame.col(self._feature(frame))
        rows = frame.rows.df.select(column.alias("c")).filter("c IS NOT NULL").distinct().limit(MAX_CATEGORIES + 1).collect()
        if len(rows) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} categories")
        return {"categories": sorted(r[0] for r in rows)}


class OneHotCategorical(_Categories):
    """A 0/1 column for each category, named by it; unseen categories are 0 everywhere."""

    def apply(self, frame: Frame) -> Frame:
        x = frame.col(self._feature(frame))
        return frame.compute({str(c): F.coalesce(x == F.lit(c), F.lit(False)).cast("int") for c in self.params["categories"]})


class SimpleEncodingCategorical(_Categories):
    """The place of a category among the sorted ones, -1 for unseen ones; column ``encoding``."""

    def apply(self, frame: Frame) -> Frame:
        known = self.params["categories"]
        x = frame.col(self._feature(frame))
        place = F.array_position(F.array(*map(F.lit, known)), x) - 1 if known else F.lit(-1).cast("long")
        return frame.compute({"encoding": F.coalesce(place, F.lit(-1).cast("long"))})


class HashingEncodingCategorical(Step):
    """murmur3 (32 bits, seed 0) of a category, modulo the number of bins; NULL stays NULL."""

    def __init__(self, nbins: int, feature: str | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.nbins, self.feature = nbins, feature

    def apply(self, frame: Frame) -> Frame:
        ship(frame.rows.df.sparkSession)
        name = self.feature or frame.columns[0]
        whole = isinstance(frame.type_of(name), T.IntegralType)
        nbins = self.nbins

        def encode(values: pd.Series) -> pd.Series:
            known: dict = {}
            out = []
            for v in values:
                if v not in known:
                    known[v] = None if v is None else murmur3(integer_bytes(int(v)) if whole else v.encode()) % nbins
                out.append(known[v])
            return pd.Series(out, dtype="Int64")

        encode.__annotations__ = {"values": pd.Series, "return": pd.Series}
        # Integers travel as text, so that NULL does not turn them to floats.
        return frame.compute({"encoding": F.pandas_udf(encode, "long")(frame.col(name).cast("string"))})


class TargetToClasses(Step):
    """The number of bin limits up to a value; columns keep their names with ``_class``."""

    def __init__(self, bins: Sequence[float], *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.bins = list(bins)

    def apply(self, frame: Frame) -> Frame:
        count = lambda x: sum(((x >= float(b)).cast("int") for b in self.bins), F.lit(0))
        return frame.compute({f"{n}_class": count(frame.col(n)) for n in frame.numeric})


class PicewiseRUL(Step):
    """RUL between 0 and a longest life."""

    def __init__(self, max_life: float = float("inf"), *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.max_life = max_life

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: clipped(x, 0, self.max_life))


class PicewiseRULQuantile(Step):
    """The same, with a quantile of the RUL as the longest life."""

    fitted = True

    def __init__(self, quantile: float, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.quantile = quantile

    def learn(self, frame: Frame) -> dict:
        return frame.agg({n: quantile(frame.col(n), self.quantile) for n in frame.numeric})

    def apply(self, frame: Frame) -> Frame:
        return frame.compute({n: clipped(frame.col(n), 0, self.params[n]) for n in frame.numeric if self.params.get(n) is not None})


class RULBinarizer(Step):
    """1 where the RUL is above a limit."""

    def __init__(self, t: float, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.t = t

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: (x > self.t).cast("int"))
