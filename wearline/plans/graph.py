"""Steps wired into a graph, fitted and applied as one Spark plan.

``b(a)`` or ``a >> b`` makes b read a; ``a + b`` and ``a / b`` (also with numbers) make nodes. A graph
is fitted node by node in topological order: a node that has something to learn runs one aggregation
over its lazy input; nodes at one depth with nothing to learn cost nothing. Applying a fitted graph
runs no job: it only adds columns to the plan.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.frame import CycleSet, Frame, Rows


class Step:
    """A node: ``learn`` returns what fitting finds (JSON-like), ``apply`` uses it."""

    #: Whether ``learn`` needs data.
    fitted = False

    def __init__(self, *, name: str | None = None) -> None:
        self.name = name or type(self).__name__
        self.previous: list[Step] = []
        self.params: dict | None = None

    def learn(self, *frames: Frame) -> dict:
        return {}

    def apply(self, *frames: Frame) -> Frame:
        raise NotImplementedError

    # Wiring --------------------------------------------------------------------------------------
    def __call__(self, *previous: Step | Pipeline | Sequence[Step]) -> Step:
        for p in previous:
            for q in p if isinstance(p, list | tuple) else [p]:
                self.previous.append(q.final if isinstance(q, Pipeline) else q)
        return self

    def __rshift__(self, following: Step) -> Step:
        return following(self)

    def __add__(self, other: Step | float) -> Step:
        from wearline.operators.arithmetic import Sum

        return Sum()(self, as_step(other))

    def __truediv__(self, other: Step | float) -> Step:
        from wearline.operators.arithmetic import Divide

        return Divide()(self, as_step(other))

    # Alone ---------------------------------------------------------------------------------------
    def fit(self, *frames: Frame) -> Step:
        self.params = self.learn(*frames) if self.fitted else {}
        return self

    def transform(self, *frames: Frame) -> Frame:
        if self.fitted and self.params is None:
            raise ValueError(f"{self.name} is not fitted")
        return self.apply(*frames)

    def fit_transform(self, *frames: Frame) -> Frame:
        return self.fit(*frames).transform(*frames)

    def description(self) -> dict:
        return {"name": self.name, "type": type(self).__name__, "params": self.params}


def as_step(value: Step | float | str) -> Step:
    from wearline.operators.arithmetic import Literal

    return value if isinstance(value, Step) else Literal(value)


class Source(Step):
    """The raw features; a graph may start with it or with any other step."""

    def apply(self, *frames: Frame) -> Frame:
        return frames[0]


class Pipeline:
    """The graph that ends in a step."""

    def __init__(self, final: Step) -> None:
        self.final = final

    def nodes(self) -> list[Step]:
        """Every node after all that it reads."""
        sorter: TopologicalSorter = TopologicalSorter()
        seen, waiting = set(), [self.final]
        while waiting:
            node = waiting.pop()
            if id(node) in seen:
                continue
            seen.add(id(node))
            sorter.add(node, *node.previous)
            waiting += node.previous
        return list(sorter.static_order())

    def edges(self) -> Iterator[tuple[Step, Step]]:
        return ((p, n) for n in self.nodes() for p in n.previous)

    def find_node(self, name: str) -> Step | None:
        return next((n for n in self.nodes() if n.name == name), None)

    def _run(self, start: Frame, learning: bool) -> Frame:
        found: dict[int, Frame] = {}
        for node in self.nodes():
            inputs = [found[id(p)] for p in node.previous] or [start]
            if learning:
                node.fit(*inputs)
            found[id(node)] = node.transform(*inputs)
        return found[id(self.final)]

    def fit(self, data: CycleSet | Frame) -> Pipeline:
        self._run(_frame(data), learning=True)
        return self

    partial_fit = fit

    def transform(self, data: CycleSet | Frame) -> Frame:
        return self._run(_frame(data), learning=False)

    def fit_transform(self, data: CycleSet | Frame) -> Frame:
        # Fitting builds the very plan that transforming would.
        return self._run(_frame(data), learning=True)

    def description(self) -> list[dict]:
        return [n.description() for n in self.nodes()]

    # Persistence ---------------------------------------------------------------------------------
    def get_params(self) -> dict[str, dict | None]:
        return {f"{i}:{n.name}": n.params for i, n in enumerate(self.nodes())}

    def set_params(self, params: dict[str, dict | None]) -> Pipeline:
        for i, n in enumerate(self.nodes()):
            n.params = params[f"{i}:{n.name}"]
        return self

    def save(self, path: str) -> None:
        with open(path, "w") as out:
            json.dump(self.get_params(), out)

    def load(self, path: str) -> Pipeline:
        with open(path) as held:
            return self.set_params(json.load(held))


def make_pipeline(*steps: Step) -> Pipeline:
    """A chain of steps."""
    for a, b in zip(steps, steps[1:], strict=False):
        b(a)
    return Pipeline(steps[-1])


def _frame(data: CycleSet | Frame) -> Frame:
    return data.frame() if isinstance(data, CycleSet) else data


def _pipeline(part: Step | Pipeline | None) -> Pipeline | None:
    return Pipeline(part) if isinstance(part, Step) else part


@dataclasses.dataclass
class Transformed:
    """X, y and metadata of a set: three projections of one plan."""

    x: Frame
    y: Frame | None
    metadata: Frame | None

    def df(self) -> DataFrame:
        """cycle, pos, the features of X, and those of y and the metadata; a clash of names is an error of the caller."""
        if self.y is not None and self.y.rows is not self.x.rows:
            keys = [self.x.cycle, self.x.pos]
            return self.x.df.join(self.y.df, keys)
        parts = [p for p in (self.x, self.y, self.metadata) if p is not None]
        held = {n: h for p in parts for n, h in p.held.items()}
        return Frame(self.x.rows, held).df


    def of_cycle(self, cycle: object) -> DataFrame:
        """One cycle's rows, in order."""
        return self.df().filter(F.col(self.x.cycle).eqNullSafe(F.lit(cycle))).orderBy(self.x.pos)

    def preload(self) -> DataFrame:
        """The rows, computed once and cached."""
        df = self.df().persist()
        df.count()
        return df

    def save(self, path: str, transformer: Transformer | None = None) -> None:
        """Rows in folders by cycle, and the fitted parameters as JSON beside them."""
        df = self.df()
        df.repartition(self.x.cycle).sortWithinPartitions(self.x.cycle, self.x.pos).write.mode("overwrite").partitionBy(self.x.cycle).parquet(f"{path}/rows")
        held = {"x": self.x.columns, "y": self.y.columns if self.y else [], "cycle": self.x.cycle, "pos": self.x.pos}
        held["params"] = transformer.get_params() if transformer else {}
        df.sparkSession.createDataFrame([(json.dumps(held),)], "held string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_transformed(spark: SparkSession, path: str) -> tuple[Transformed, dict]:
    """What :meth:`Transformed.save` has stored: frames of X and y over the same rows, and the parameters."""
    held = json.loads(spark.read.text(f"{path}/params").first()[0])
    rows = Rows(spark.read.parquet(f"{path}/rows"), held["cycle"], held["pos"])
    frames = [Frame(rows, {n: n for n in held[k]}) for k in ("x", "y")]
    return Transformed(frames[0], frames[1] if held["y"] else None, None), held["params"]


class Transformer:
    """A pipeline for X, one for y and one for metadata."""

    def __init__(self, pipelineX: Step | Pipeline, pipelineY: Step | Pipeline | None = None, pipelineMetadata: Step | Pipeline | None = None) -> None:
        self.x, self.y, self.m = _pipeline(pipelineX), _pipeline(pipelineY), _pipeline(pipelineMetadata)
        self.columns: list[str] | None = None

    def _all(self, data: CycleSet | Frame, method: str) -> Transformed:
        start = _frame(data)
        parts = [getattr(p, method)(start) if p else None for p in (self.x, self.y, self.m)]
        self.columns = parts[0].columns
        return Transformed(*parts)

    def fit(self, data: CycleSet | Frame) -> Transformer:
        self._all(data, "fit_transform")
        return self

    def transform(self, data: CycleSet | Frame) -> Transformed:
        return self._all(data, "transform")

    def fit_map(self, data: CycleSet | Frame) -> Transformed:
        return self._all(data, "fit_transform")

    def get_params(self) -> dict:
        return {k: p.get_params() for k, p in (("x", self.x), ("y", self.y), ("metadata", self.m)) if p}

    def set_params(self, params: dict) -> Transformer:
        for k, p in (("x", self.x), ("y", self.y), ("metadata", self.m)):
            if p:
                p.set_params(params[k])
        return self

    @property
    def n_features(self) -> int:
        if self.columns is None:
            raise ValueError("the transformer is not fitted")
        return len(self.columns)

    def description(self) -> dict:
        return {k: p.description() if p else "Missing" for k, p in (("X", self.x), ("y", self.y), ("metadata", self.m))}


class IdentityTransformer(Transformer):
    """All features as X, the RUL as y."""

    def __init__(self, rul_column: str) -> None:
        from wearline.operators.selection import ByNameFeatureSelector

        super().__init__(Source(), ByNameFeatureSelector([rul_column]))
