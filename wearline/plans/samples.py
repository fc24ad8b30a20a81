"""Windows of cycles as samples for models: one row per sample, in an order, with weights, in batches.

A sample is the row at whose position its window ends. Windows are built from ``lag`` and ``lead`` of
one window specification, so a cycle is sorted once whatever the window's length; the samples' order
is a sort key, and nothing is gathered on the driver.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.frame import Frame, Rows, numbered
from wearline.operators.selection import RelativePosition, RelativeToStart

FORECAST, SEQ_TO_SEQ = "forecast", "seq_to_seq"


def hash_random(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the row only: the same in every run and partitioning."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


class Shuffler:
    """The order of samples: sort keys, of columns cycle, pos and size."""

    #: A condition of (pos, size) for the rows that are samples, instead of every ``step``-th one.
    chosen: Callable[[Column, Column], Column] | None = None

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed

    def keys(self, cycle: str, pos: str) -> list[Column]:
        return [F.col(cycle), F.col(pos)]


class NotShuffled(Shuffler):
    """Cycles in order, rows in order."""


class AllShuffled(Shuffler):
    """Rows of all cycles at random: evenly spaced ones, or ones whose distances from the end are powers of the cycle's size.

    Of those powers (as many as there are steps in the cycle) the whole part counts; a row that several of them meet is taken once.
    """

    def __init__(self, seed: int = 0, evenly_sampled: bool = True, step: int = 1) -> None:
        super().__init__(seed)
        self.step = step
        if not evenly_sampled:
            self.chosen = self._powers

    def _powers(self, pos: Column, size: Column) -> Column:
        size = size.cast("double")
        left, last = size - pos, F.ceil(size / self.step) - 1
        # The exponent i / last gives this row where left <= size ^ (i / last) < left + 1.
        i = F.ceil(last * F.log(left) / F.log(size) - 1e-9)
        return F.when((size <= 1) | (last < 1), pos == 0).otherwise((i <= last) & (F.pow(size, i / last) < left + 1 - 1e-9))

    def keys(self, cycle: str, pos: str) -> list[Column]:
        return [hash_random(self.seed, cycle, pos), F.col(cycle), F.col(pos)]


class IntraTimeSeriesShuffler(Shuffler):
    """Cycles in order, their rows at random."""

    def keys(self, cycle: str, pos: str) -> list[Column]:
        return [F.col(cycle), hash_random(self.seed, cycle, pos), F.col(pos)]


class TimeSeriesOrderShuffling(Shuffler):
    """Cycles at random, their rows in order."""

    def keys(self, cycle: str, pos: str) -> list[Column]:
        return [hash_random(self.seed, cycle), F.col(cycle), F.col(pos)]


class TimeSeriesOrderIntraSignalShuffling(Shuffler):
    """Cycles at random, and their rows."""

    def keys(self, cycle: str, pos: str) -> list[Column]:
        return [hash_random(self.seed, cycle), F.col(cycle), hash_random(self.seed + 1, cycle, pos), F.col(pos)]


class InverseOrder(Shuffler):
    """Always the last unused row of the cycle that has most left, the first such cycle on ties; then ``step`` rows less are left."""

    def __init__(self, step: int = 1) -> None:
        super().__init__()
        self.step = step

    def keys(self, cycle: str, pos: str) -> list[Column]:
        return [F.col(pos).desc(), F.col(cycle)]

    def grid(self, pos: str) -> Column:
        return (F.col("size") - 1 - F.col(pos)) % self.step == 0


# Weights -------------------------------------------------------------------------------------------


def not_weighted(y: Column) -> Column:
    return F.lit(1.0)


def rul_inverse_weighted(y: Column) -> Column:
    return 1 / (y + 1)


class InverseToLengthWeighted:
    """One over the cycle's first target."""

    of_cycle = True

    def __call__(self, first: Column) -> Column:
        return F.when(first != 0, 1 / first)


class ExponentialDecay:
    """exp(-y² / α), so that the weight of ``near_0_at`` is a millionth."""

    def __init__(self, near_0_at: float) -> None:
        self.alpha = -(near_0_at**2) / math.log(1e-6)

    def __call__(self, y: Column) -> Column:
        return F.exp(-(y * y) / self.alpha)


# Samples -------------------------------------------------------------------------------------------


@dataclasses.dataclass
class WindowedDatasetIterator:
    """Look-back windows over transformed cycles.

    ``x`` and ``y`` are frames of the same rows. A forecast's y is the target from the sample's row
    on, ``horizon`` rows; in seq_to_seq it faces the window. With padding, windows that begin before
    the cycle get zeros there; without, such samples are left out (``valid_sample`` may decide
    otherwise, by a condition of the position and size).
    """

    x: Frame
    y: Frame
    window_size: int
    step: int = 1
    horizon: int = 1
    shuffler: Shuffler = dataclasses.field(default_factory=NotShuffled)
    sample_weight: Callable[[Column], Column] = not_weighted
    right_closed: bool = True
    padding: bool = False
    iteration_type: str = FORECAST
    start_index: int | RelativePosition = 0
    end_index: int | RelativePosition | None = None
    valid_sample: Callable[[Column, Column], Column] | None = None
    last_point: bool = True

    def __post_init__(self) -> None:
        if self.y.rows is not self.x.rows:
            raise ValueError("x and y must be frames of the same rows")
        if self.iteration_type not in (FORECAST, SEQ_TO_SEQ):
            raise ValueError(f"unknown iteration type {self.iteration_type}")

    @property
    def n_features(self) -> int:
        return len(self.x.columns)

    @property
    def shape(self) -> tuple[int, int]:
        return (self.window_size, self.n_features)

    @staticmethod
    def _at(position: int | RelativePosition, size: Column) -> Column:
        return (RelativeToStart(position) if isinstance(position, int) else position).at(size)

    def _cells(self, frame: Frame, offsets: range) -> Column:
        """Rows at offsets from the sample, as arrays of features; zeros where the cycle has none."""
        order = frame.ordered
        values = F.array(*(frame.col(n).cast("float") for n in frame.columns))
        zeros = F.array(*(F.lit(0.0).cast("float") for _ in frame.columns))
        held = F.col(frame.rows.add({"row": values})["row"])
        # One lag or lead for each offset: they share the sort and evaluate in one pass.
        cells = [held if o == 0 else F.lag(held, -o).over(order) if o < 0 else F.lead(held, o).over(order) for o in offsets]
        return F.array(*(F.coalesce(c, zeros) for c in cells))

    def samples(self) -> DataFrame:
        """cycle, pos, X (rows of features), y (rows of targets, or numbers if there is one target) and weight; unordered."""
        x, pos = self.x, F.col(self.x.pos)
        size = F.col(x.rows.add({"size": F.count("*").over(x.whole)})["size"])
        start = self._at(self.start_index, size)
        end = size if self.end_index is None else F.least(self._at(self.end_index, size), size)
        grid = (pos - start) % self.step == 0
        if self.shuffler.chosen is not None:
            grid = self.shuffler.chosen(pos, size)
        elif isinstance(self.shuffler, InverseOrder):
            grid = (end - 1 - pos) % self.shuffler.step == 0
        elif self.last_point:
            grid = grid | (pos == end - 1)
        wanted = (pos >= start) & (pos < end) & grid
        w = self.window_size
        if self.valid_sample is not None:
            wanted &= self.valid_sample(pos, size)
        elif not self.padding:
            wanted &= pos >= w - 1
        # A left-open window ends one row before the sample.
        last = 0 if self.right_closed else -1
        first = 1 - w
        cells_x = self._cells(x, range(first, last + 1))
        if self.iteration_type == SEQ_TO_SEQ:
            cells_y = self._cells(self.y, range(first, last + 1))
        else:
            cells_y = self._cells(self.y, range(0, self.horizon))
        target = self.y.col(self.y.columns[0])
        if getattr(self.sample_weight, "of_cycle", False):
            target = F.first(target).over(x.expanding)
        out = self.x.rows.add({"X": cells_x, "y": cells_y, "weight": self.sample_weight(target), "wanted": wanted, "n": size})
        y = F.col(out["y"])
        if len(self.y.columns) == 1:
            y = F.transform(y, lambda r: r[0])
        return x.rows.df.filter(F.col(out["wanted"])).select(
            x.cycle, x.pos, F.col(out["n"]).alias("size"), F.col(out["X"]).alias("X"), y.alias("y"), F.col(out["weight"]).cast("float").alias("weight")
        )

    def ordered(self) -> DataFrame:
        """The samples in the shuffler's order: a range-partitioned sort."""
        return self.samples().orderBy(*self.shuffler.keys(self.x.cycle, self.x.pos))

    def flattened(self) -> DataFrame:
        """X as one array per sample, row by row."""
        return self.ordered().withColumn("X", F.flatten("X"))

    def __len__(self) -> int:
        return self.samples().count()

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        return _arrays(self.ordered())

    def get_data(self, flatten: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All samples as float32 arrays on the driver: for sets that fit there."""
        rows = (self.flattened() if flatten else self.ordered()).toPandas()
        shape = (0, self.window_size * self.n_features) if flatten else (0, *self.shape)
        cells = [np.array([list(r) for r in v], dtype=np.float32) if not flatten else np.array(v, dtype=np.float32) for v in rows["X"]]
        return np.stack(cells) if cells else np.zeros(shape, np.float32), np.array([list(map(_plain, v)) for v in rows["y"]], np.float32), rows["weight"].to_numpy(np.float32)

    def batches(self, batch_size: int) -> DataFrame:
        """The samples with a batch number, in order; the last batch may be short and none is empty.

        The order is global: :func:`wearline.frame.numbered` has the places.
        """
        placed = numbered(self.samples(), self.shuffler.keys(self.x.cycle, self.x.pos), "place")
        return placed.withColumn("batch", F.floor(F.col("place") / batch_size).cast("long"))


def _arrays(rows: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    for row in rows.toLocalIterator():
        yield np.array(row["X"], dtype=np.float32), np.array(row["y"], dtype=np.float32), row["weight"]


def _plain(value: object) -> object:
    return list(value) if isinstance(value, list | tuple | np.ndarray) else value


class Batcher:
    """Stacked samples, ``batch_size`` at a time, streamed to the driver partition by partition."""

    def __init__(self, iterator: WindowedDatasetIterator, batch_size: int) -> None:
        self.iterator, self.batch_size = iterator, batch_size

    @classmethod
    def new(cls, x: Frame, y: Frame, window: int, batch_size: int, step: int = 1, **kwargs) -> Batcher:
        return cls(WindowedDatasetIterator(x, y, window, step, **kwargs), batch_size)

    def __len__(self) -> int:
        return -(-len(self.iterator) // self.batch_size)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return self.of(self.iterator.ordered())

    def of(self, ordered: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The batches of samples that are in order already."""
        held: list = []
        for sample in _arrays(ordered):
            held.append(sample)
            if len(held) == self.batch_size:
                yield self._stack(held)
                held = []
        if held:
            yield self._stack(held)

    @staticmethod
    def _stack(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.stack([x for x, _, _ in held]), np.stack([y for _, y, _ in held]), np.array([w for _, _, w in held], np.float32)


def true_values(iterator: WindowedDatasetIterator) -> np.ndarray:
    """The targets of all samples in order."""
    return np.array([y for y in iterator.ordered().select("y").toPandas()["y"].map(list)], dtype=np.float32)


def frame_of(df: DataFrame, cycle: str, pos: str, names: list[str]) -> Frame:
    return Frame(Rows(df, cycle, pos), {n: n for n in names})


