"""Filters by value, sub-pipelines for each category, and putting rows together again."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline.frame import Frame, Rows
from wearline.functions.quantiles import Quantile
from wearline.operators.scaling import ColumnStep
from wearline.plans.graph import Pipeline, Step
from wearline.shipping import checkpoint_dir

__all__ = ["CATEGORY_ALL", "Filter", "Joiner", "SplitByCategory"]

#: A value that filters nothing.
CATEGORY_ALL = "__category_all__"


class Filter(Step):
    """Rows in which columns have given values; the columns are dropped."""

    def __init__(self, values: Sequence, columns: Sequence[str], *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.values, self.chosen = list(values), list(columns)

    def apply(self, frame: Frame) -> Frame:
        wanted = [frame.col(c) == F.lit(v) for c, v in zip(self.chosen, self.values, strict=True) if v != CATEGORY_ALL]
        kept = frame.where(reduce(lambda a, b: a & b, wanted)) if wanted else frame
        return kept.drop(self.chosen)


class Joiner(Step):
    """The rows of all later branches, and those of the first that no other has."""

    def apply(self, first: Frame, *others: Frame) -> Frame:
        if not others:
            return first
        parts = [f.df for f in others]
        rest = first.df
        keys = [first.cycle, first.pos]
        own = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rest = rest.join(own.select(keys), keys, "left_anti")
        df = own.unionByName(rest, allowMissingColumns=True)
        return Frame(Rows(df, first.cycle, first.pos), {n: n for n in df.columns if n not in keys})


class SplitByCategory(Step):
    """A sub-pipeline fitted for each combination of categories, and one on all rows for unseen ones.

    ``pipeline`` is a step, a pipeline, or a function that makes one. A scaler (a step that learns plain
    aggregates) is fitted for all categories by one aggregation and applied as one expression. Other
    pipelines are fitted and applied branch by branch, on rows that are written once, and joined again.
    """

    fitted = True
    MAX_CATEGORIES = 100

    def __init__(self, features: str | Sequence[str], pipeline: Step | Pipeline | Callable[[], Step | Pipeline], add_default: bool = True, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.features = [features] if isinstance(features, str) else list(features)
        self.pipeline, self.add_default = pipeline, add_default
        self.branches: list[tuple[list, Pipeline]] = []

    def _new(self) -> Pipeline:
        made = self.pipeline() if callable(self.pipeline) and not isinstance(self.pipeline, Step) else copy.deepcopy(self.pipeline)
        return made if isinstance(made, Pipeline) else Pipeline(made)

    def _plain(self, frame: Frame) -> ColumnStep | None:
        """The branches' step, if plain aggregates by category are all that it learns."""
        made = self._new()
        step = made.final if len(made.nodes()) == 1 and isinstance(made.final, ColumnStep) else None
        own = [a for n in frame.numeric if n not in self.features for a in step.aggregates(frame.col(n)).values()] if step else []
        return None if any(isinstance(a, Quantile) for a in own) else step

    def _learn_at_once(self, frame: Frame, step: ColumnStep) -> dict:
        keys = [frame.col(f).alias(f"_k{i}") for i, f in enumerate(self.features)]
        wanted = [(n, k, a) for n in frame.numeric if n not in self.features for k, a in step.aggregates(frame.col(n)).items()]
        columns = [a.alias(f"_{i}") for i, (_, _, a) in enumerate(wanted)]
        found = frame.rows.df.groupBy(*keys).agg(*columns).dropna(subset=[f"_k{i}" for i in range(len(keys))]).limit(self.MAX_CATEGORIES + 1).collect()
        if len(found) > self.MAX_CATEGORIES:
            raise ValueError(f"more than {self.MAX_CATEGORIES} categories")
        rows = [(list(r[: len(keys)]), r[len(keys) :]) for r in sorted(map(tuple, found))]
        if self.add_default:
            rows.insert(0, ([CATEGORY_ALL] * len(keys), tuple(frame.rows.df.agg(*columns).first()) if columns else ()))
        self.branches = []
        for values, numbers in rows:
            pipeline = self._new()
            params: dict = {}
            for (n, k, _), v in zip(wanted, numbers, strict=True):
                params.setdefault(n, {})[k] = float(v) if v is not None else None
            pipeline.final.params = params
            self.branches.append((values, pipeline))
        return {"categories": [v for v, _ in self.branches]}

    def _apply_at_once(self, frame: Frame) -> Frame:
        """Every category's expression under its condition."""
        own = self.branches[1:] if self.add_default else self.branches
        is_in = [reduce(lambda a, b: a & b, [frame.col(f) == F.lit(v) for f, v in zip(self.features, values, strict=True)]) for values, _ in own]
        if not self.add_default:
            frame = frame.where(reduce(lambda a, b: a | b, is_in, F.lit(False)))

        def scaled(step: ColumnStep, n: str) -> Column:
            p = step.params.get(n)
            return step.express(frame.col(n), p) if p is not None and None not in p.values() else frame.col(n)

        new = {}
        for n in frame.numeric:
            if n not in self.features:
                out = scaled(self.branches[0][1].final, n) if self.add_default else F.lit(None)
                for condition, (_, pipeline) in zip(is_in, own, strict=True):
                    out = F.when(condition, scaled(pipeline.final, n)).otherwise(out)
                new[n] = out
        held = frame.rows.add(new)
        return Frame(frame.rows, {n: held.get(n, h) for n, h in frame.held.items() if n not in self.features})

    @staticmethod
    def _written(frame: Frame) -> Frame:
        checkpoint_dir(frame.rows.df.sparkSession)
        return Frame(Rows(frame.rows.df.checkpoint(), frame.cycle, frame.pos), frame.held)

    def learn(self, frame: Frame) -> dict:
        if step := self._plain(frame):
            return self._learn_at_once(frame, step)
        frame = self._written(frame)
        keys = [frame.col(f).alias(f) for f in self.features]
        rows = sorted(tuple(r) for r in frame.rows.df.select(*keys).dropna().distinct().limit(self.MAX_CATEGORIES + 1).collect())
        if len(rows) > self.MAX_CATEGORIES:
            raise ValueError(f"more than {self.MAX_CATEGORIES} categories")
        self.branches = []
        if self.add_default:
            self.branches.append(([CATEGORY_ALL] * len(self.features), self._new()))
        self.branches += [(list(r), self._new()) for r in rows]
        for values, pipeline in self.branches:
            pipeline.fit(Filter(values, self.features).apply(frame))
        return {"categories": [v for v, _ in self.branches]}

    def apply(self, frame: Frame) -> Frame:
        if self._plain(frame):
            return self._apply_at_once(frame)
        frame = self._written(frame)
        parts = [pipeline.transform(Filter(values, self.features).apply(frame)) for values, pipeline in self.branches]
        if self.add_default:
            return Joiner().apply(*parts)
        empty = Frame(Rows(parts[0].rows.df.limit(0), frame.cycle, frame.pos), parts[0].held)
        return Joiner().apply(empty, *parts)
