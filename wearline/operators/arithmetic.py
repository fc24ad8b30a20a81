"""Arithmetic of features and of whole branches."""

from __future__ import annotations

import copy
import itertools
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wearline.frame import Frame, Rows
from wearline.functions.stats import ratio
from wearline.operators.scaling import clipped
from wearline.operators.selection import find_feature
from wearline.plans.graph import Step

__all__ = [
    "Apply", "Clip", "ColumnWiseSum", "Concatenate", "Difference", "Divide", "Interactions", "Literal", "Scale", "Sqrt", "Square", "StringConcatenate", "Sum",
    "TransformerLambda", "SKLearnTransformerWrapper",
]


class Literal(Step):
    """A constant, as a branch."""

    def __init__(self, value: float | str, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.value = value

    def apply(self, frame: Frame) -> Frame:
        return frame.compute({"literal": F.lit(self.value)})


class Square(Step):
    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: x * x)


class Sqrt(Step):
    """NULL below 0."""

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: F.when(x >= 0, F.sqrt(x)))


class Scale(Step):
    def __init__(self, scale_factor: float, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.scale_factor = scale_factor

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: x * self.scale_factor)


class Clip(Step):
    def __init__(self, lower: float, upper: float, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.lower, self.upper = lower, upper

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: clipped(x, self.lower, self.upper))


class ColumnWiseSum(Step):
    """The sum of each row's features; NULLs add nothing."""

    def __init__(self, column_name: str, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.column_name = column_name

    def apply(self, frame: Frame) -> Frame:
        return frame.compute({self.column_name: reduce(lambda a, b: a + b, (F.coalesce(frame.col(n).cast("double"), F.lit(0.0)) for n in frame.numeric), F.lit(0.0))})


class Difference(Step):
    """Differences of pairs of features, found by part of their name; columns keep the first one's name."""

    def __init__(self, feature_set1: Sequence[str], feature_set2: Sequence[str], *, name: str | None = None) -> None:
        super().__init__(name=name)
        if len(feature_set1) != len(feature_set2):
            raise ValueError("the two sets must have as many features")
        self.pairs = list(zip(feature_set1, feature_set2, strict=True))

    def apply(self, frame: Frame) -> Frame:
        out = {}
        for a, b in self.pairs:
            first, second = find_feature(frame.columns, a), find_feature(frame.columns, b)
            if first is None or second is None:
                raise ValueError(f"no such features: {a}, {b}")
            out[first] = frame.col(first) - frame.col(second)
        return frame.compute(out)


class Interactions(Step):
    """Products of all pairs of features, ``{a}_{b}``."""

    def apply(self, frame: Frame) -> Frame:
        return frame.compute({f"{a}_{b}": frame.col(a) * frame.col(b) for a, b in itertools.combinations(frame.numeric, 2)})


class StringConcatenate(Step):
    """All features of a row as text, joined by "-"; NULLs are left out."""

    def apply(self, frame: Frame) -> Frame:
        return frame.compute({"concatenation": F.concat_ws("-", *(frame.col(n).cast("string") for n in frame.columns))})


class Apply(Step):
    """A function of a Column, for each feature; or, with ``types``, of a pandas Series of a whole cycle."""

    def __init__(self, fun: Callable, types: str | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.fun, self.types = fun, types

    def apply(self, frame: Frame) -> Frame:
        if self.types is None:
            return frame.each(self.fun, frame.columns)
        fun = self.fun
        return frame.kernel({n: self.types for n in frame.columns}, lambda part: part.apply(fun))


class TransformerLambda(Step):
    """Any function from frame to frame, or, with ``schema``, from a cycle's pandas frame to another with these columns."""

    def __init__(self, callback: Callable, schema: dict[str, str] | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.callback, self.schema = callback, schema

    def apply(self, frame: Frame) -> Frame:
        return self.callback(frame) if self.schema is None else frame.kernel(self.schema, self.callback)


class SKLearnTransformerWrapper(Step):
    """Any object with ``fit`` and ``transform`` of an array; it is fitted on all rows.

    Up to ``max_rows`` rows go to ``fit`` at once. Beyond, a copy of the object as it was given gets all
    rows in order by ``partial_fit``, as many at a time; an object without it raises, and nothing is sampled.
    """

    fitted = True

    def __init__(self, transformer: object, max_rows: int = 100_000, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.transformer, self.max_rows = transformer, max_rows
        self.given = copy.deepcopy(transformer)

    def learn(self, frame: Frame) -> dict:
        names = frame.numeric
        n = frame.rows.df.count()
        data = frame.df.orderBy(frame.cycle, frame.pos).select(*names)
        if n <= self.max_rows:
            self.transformer.fit(data.toPandas().to_numpy(dtype=float))
        elif hasattr(self.given, "partial_fit"):
            self.transformer = copy.deepcopy(self.given)
            for part in itertools.batched(data.toLocalIterator(), self.max_rows):
                self.transformer.partial_fit(np.array(part, dtype=float))
        else:
            raise ValueError(f"{type(self.transformer).__name__} has no partial_fit and must get {n} rows at once; max_rows is {self.max_rows}")
        return {"features": names}

    def apply(self, frame: Frame) -> Frame:
        names, transformer = self.params["features"], self.transformer
        run = lambda part: pd.DataFrame(transformer.transform(part.to_numpy(dtype=float)), columns=part.columns)
        return frame.kernel({n: "double" for n in names}, run, names)


def _aligned(frames: Sequence[Frame]) -> list[Frame]:
    """Frames of the same rows: as they are if they share them, else after a full join on (cycle, pos)."""
    first = frames[0]
    if all(f.rows is first.rows for f in frames):
        return list(frames)
    joined, out = None, []
    for i, f in enumerate(frames):
        names = {n: f"_j{i}_{k}" for k, n in enumerate(f.columns)}
        part = f.rows.df.select(f.cycle, f.pos, *(f.col(n).alias(names[n]) for n in f.columns))
        joined = part if joined is None else joined.join(part, [first.cycle, first.pos], "full")
        out.append(names)
    rows = Rows(joined, first.cycle, first.pos)
    return [Frame(rows, names) for names in out]


class Sum(Step):
    """The sum of branches, feature by feature; what one branch lacks counts as 0, and NULL where all lack it."""

    def apply(self, *frames: Frame) -> Frame:
        literals = [F.lit(p.value) for p in self.previous if isinstance(p, Literal)]
        frames = _aligned([f for f, p in itertools.zip_longest(frames, self.previous) if not isinstance(p, Literal)])
        out = {}
        for n in dict.fromkeys(n for f in frames for n in f.columns):
            parts = [f.col(n) for f in frames if n in f.held] + literals
            some = reduce(lambda a, b: a | b, (p.isNotNull() for p in parts))
            out[n] = F.when(some, reduce(lambda a, b: a + b, (F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts)))
        return frames[0].compute(out)


class Divide(Step):
    """The first branch over the second; a missing numerator is 0, a missing or zero denominator gives NULL."""

    def apply(self, *frames: Frame) -> Frame:
        divisor = self.previous[1] if len(self.previous) > 1 else None
        if isinstance(divisor, Literal):
            return frames[0].each(lambda x: ratio(x.cast("double"), F.lit(float(divisor.value))))
        top, bottom = _aligned(frames)
        return top.compute({n: ratio(F.coalesce(top.col(n).cast("double"), F.lit(0.0)), bottom.col(n).cast("double")) for n in top.columns if n in bottom.held})


class Concatenate(Step):
    """All features of the branches side by side, named ``{step}_{i}_{feature}`` if prefixes are wanted."""

    def __init__(self, add_prefix: bool = True, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.add_prefix = add_prefix

    def apply(self, *frames: Frame) -> Frame:
        names = [p.name for p in self.previous] or [str(i) for i in range(len(frames))]
        held: dict[str, str] = {}
        aligned = _aligned(frames)
        for i, (f, step) in enumerate(zip(aligned, names, strict=False)):
            for n, h in f.held.items():
                held[f"{step}_{i}_{n}" if self.add_prefix else n] = h
        return Frame(aligned[0].rows, held)


