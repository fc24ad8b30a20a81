"""The data model: run-to-failure cycles as one long DataFrame.

A cycle is the rows that share ``cycle``, ordered by ``pos`` (0, 1, ...). Missing values are NULL;
NaN becomes NULL on the way in; infinities stay, as marks that outlier steps leave for imputers.

``Rows`` holds the DataFrame of one set of rows. Steps that keep the rows add columns to it, under
names of their own, and a ``Frame`` says which of them are its features. Branches that start at the
same rows thus share one plan: putting them together again is a projection and needs no join, and
all their windows share one shuffle and sort. Catalyst drops the columns that nobody reads.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wearline.functions import quantiles
from wearline.functions.quantiles import Quantile
from wearline.shipping import checkpoint_dir, ship

NUMERIC = (T.NumericType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)
_names = itertools.count()


def by_group(df: DataFrame, keys: Sequence[str], order: str, function: Callable[..., pd.DataFrame], schema: T.StructType | str, together: bool = False) -> DataFrame:
    """Apply a function to the rows of each group, in order.

    Groups meet in partitions by one shuffle and follow each other there after a sort that can spill,
    so a task holds one group and one batch, and thousands of small groups cost one Arrow stream.
    With ``together`` the function gets all whole groups of a batch, and where each starts.
    """
    ship(df.sparkSession)
    keys = list(keys)
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            number = batch.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(batch)]
            parts = [batch.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            if held and not _same_group(held[-1], parts[0], keys):
                yield function(pd.concat(held, ignore_index=True))
                held = []
            held.append(parts[0])
            if len(parts) > 1:
                done = [pd.concat(held, ignore_index=True), *(p.reset_index(drop=True) for p in parts[1:-1])]
                yield pd.concat([function(p) for p in done], ignore_index=True)
                held = [parts[-1]]
        if held:
            yield function(pd.concat(held, ignore_index=True))

    def run_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def whole() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            return function(rows, _starts(rows, keys))

        for batch in batches:
            if not len(batch):
                continue
            last = int(_starts(batch, keys)[-1])
            if held and (last or not _same_group(held[-1], batch, keys)):
                # All before the batch's last group is whole.
                held.append(batch.iloc[:last])
                yield whole()
                held = []
            elif last:
                held = [batch.iloc[:last]]
                yield whole()
                held = []
            held.append(batch.iloc[last:])
        if held:
            yield whole()

    return dealt.mapInPandas(run_together if together else run, schema)


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups start, in rows whose groups follow each other."""
    number = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    return np.append(0, np.flatnonzero(np.diff(number)) + 1)


def _same_group(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    x, y = a[keys].iloc[-1], b[keys].iloc[0]
    return all(u == v or pd.isna(u) and pd.isna(v) for u, v in zip(x, y, strict=True))


def _series(column: pa.ChunkedArray) -> pd.Series:
    """An Arrow column in pandas; times are the session's, without a zone."""
    out = column.to_pandas(date_as_object=True)
    return out.dt.tz_localize(None) if isinstance(out.dtype, pd.DatetimeTZDtype) else out


def numbered(df: DataFrame, keys: Sequence[Column | str], name: str) -> DataFrame:
    """The rows with their number (from 0) in the order of ``keys``.

    The sorted rows are written once, each with its partition and its place there; the numbers come
    from the counts of the partitions before, a table of one row a partition.
    """
    checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*keys).withColumn("_id", F.monotonically_increasing_id()).checkpoint().withColumn("_part", F.shiftright("_id", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_id", "_part", "_before")


class Rows:
    """One set of rows and all columns computed for it so far.

    ``unit`` may name a column that the cycle determines and by which the rows are partitioned
    already (the log that cycles were cut from): windows and groups by (unit, cycle) then need no
    shuffle of their own.
    """

    def __init__(self, df: DataFrame, cycle: str, pos: str, unit: str | None = None) -> None:
        self.df, self.cycle, self.pos, self.unit = df, cycle, pos, unit

    @property
    def by(self) -> list[str]:
        return [self.cycle] if self.unit is None else [self.unit, self.cycle]

    def add(self, columns: dict[str, Column]) -> dict[str, str]:
        """Compute columns; returns the name under which each is held."""
        held = {name: f"_c{next(_names)}" for name in columns}
        self.df = self.df.withColumns({held[name]: c for name, c in columns.items()})
        return held

    def kernel(self, inputs: dict[str, str], outputs: dict[str, str], function: Callable, together: bool = False) -> dict[str, str]:
        """Add columns by a function of a whole cycle (rows in order, inputs by their logical names).

        ``outputs`` has the SQL type of each new column. Only the inputs become pandas; rows and other
        columns go through as Arrow data. With ``together`` the function gets all whole cycles of a
        batch, and where each starts, and returns arrays by name: short cycles then cost no call each.
        """
        ship(self.df.sparkSession)
        held = {name: f"_c{next(_names)}" for name in outputs}
        added = T.StructType.fromDDL(", ".join(f"{held[n]} {t}" for n, t in outputs.items())).fields
        kinds = {n: to_arrow_type(f.dataType) for n, f in zip(outputs, added, strict=True)}
        # The window asks for a cycle's rows together and in order; where they are so already, nothing is moved.
        dealt = self.df.withColumn("_place", F.row_number().over(Window.partitionBy(*self.by).orderBy(self.pos)))

        def computed(rows: pa.Table, starts: list[int]) -> pa.RecordBatch:
            """Whole cycles, each from one start to the next: their columns as they are, and the new ones."""
            read = pd.DataFrame({n: _series(rows.column(h)) for n, h in inputs.items()})
            parts: dict[str, list[pa.Array]] = {n: [] for n in kinds}
            if together:
                found = function(read, np.array(starts, dtype=np.int64))
                parts = {n: [v if isinstance(v := found[n], pa.Array) else pa.array(v, kind, from_pandas=True)] for n, kind in kinds.items()}
            for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True) if not together else ():
                found = function(read.iloc[a:b].reset_index(drop=True))
                for n, kind in kinds.items():
                    parts[n].append(pa.array(found[n].to_numpy(), kind, from_pandas=True))
            whole = rows.drop_columns(["_place"]).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*whole.columns, *(pa.concat_arrays(p) for p in parts.values())], [*whole.schema.names, *(held[n] for n in kinds)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[pa.RecordBatch] = []
            starts: list[int] = []
            n = 0
            for batch in batches:
                here = np.flatnonzero(batch.column("_place").to_numpy() == 1)
                if len(here):
                    # All before the batch's last start is whole.
                    starts += (here[:-1] + n).tolist()
                    last = int(here[-1])
                    waiting.append(batch.slice(0, last))
                    if starts:
                        yield computed(pa.Table.from_batches(waiting), starts)
                    waiting, starts, n = [], [0], 0
                    batch = batch.slice(last)
                waiting.append(batch)
                n += batch.num_rows
            if starts:
                yield computed(pa.Table.from_batches(waiting), starts)

        self.df = dealt.mapInArrow(run, T.StructType([*self.df.schema.fields, *added]))
        return held


class Frame:
    """Features of a set of rows: logical names, in order, and where their values are held."""

    def __init__(self, rows: Rows, held: dict[str, str]) -> None:
        self.rows, self.held = rows, dict(held)

    # Columns -------------------------------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return list(self.held)

    @property
    def cycle(self) -> str:
        return self.rows.cycle

    @property
    def pos(self) -> str:
        return self.rows.pos

    def col(self, name: str) -> Column:
        return F.col(self.held[name])

    def type_of(self, name: str) -> T.DataType:
        return self.rows.df.schema[self.held[name]].dataType

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.columns if isinstance(self.type_of(c), NUMERIC)]

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.columns if not isinstance(self.type_of(c), (*NUMERIC, *TEMPORAL))]

    # Windows -------------------------------------------------------------------------------------
    @property
    def whole(self) -> Window:
        return Window.partitionBy(*self.rows.by)

    @property
    def ordered(self) -> Window:
        return self.whole.orderBy(self.pos)

    @property
    def expanding(self) -> Window:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def following(self) -> Window:
        return self.ordered.rowsBetween(0, Window.unboundedFollowing)

    def rolling(self, size: int, center: bool = False) -> Window:
        after = (size - 1) // 2 if center else 0
        return self.ordered.rowsBetween(after - size + 1, after)

    # Making further frames -----------------------------------------------------------------------
    def select(self, names: Iterable[str]) -> Frame:
        return Frame(self.rows, {n: self.held[n] for n in names})

    def drop(self, names: Iterable[str]) -> Frame:
        gone = set(names)
        return self.select(c for c in self.columns if c not in gone)

    def renamed(self, names: dict[str, str]) -> Frame:
        return Frame(self.rows, {names.get(n, n): h for n, h in self.held.items()})

    def compute(self, columns: dict[str, Column], keep: bool = False) -> Frame:
        """A frame of computed columns of the same rows, after the present ones if ``keep``."""
        new = self.rows.add(columns)
        return Frame(self.rows, {**self.held, **new} if keep else new)

    def each(self, function: Callable[[Column], Column], names: Sequence[str] | None = None) -> Frame:
        """Apply a function of one column to these columns (numeric ones by default); others stay as they are."""
        chosen = self.numeric if names is None else list(names)
        new = self.rows.add({n: function(self.col(n)) for n in chosen})
        return Frame(self.rows, {n: new.get(n, h) for n, h in self.held.items()})

    def where(self, condition: Column) -> Frame:
        """The rows that satisfy a condition, as rows of their own (positions stay)."""
        return Frame(Rows(self.rows.df.filter(condition), self.cycle, self.pos, self.rows.unit), self.held)

    def renumbered(self) -> Frame:
        """The same rows with positions 0, 1, ... again."""
        df = self.rows.df.withColumn(self.pos, F.row_number().over(self.ordered).cast("long") - 1)
        return Frame(Rows(df, self.cycle, self.pos, self.rows.unit), self.held)

    def kernel(self, outputs: dict[str, str], function: Callable, inputs: Sequence[str] | None = None, keep: bool = False, together: bool = False) -> Frame:
        chosen = {n: self.held[n] for n in (self.columns if inputs is None else inputs)}
        new = self.rows.kernel(chosen, outputs, function, together)
        return Frame(self.rows, {**self.held, **new} if keep else new)

    # Results -------------------------------------------------------------------------------------
    @property
    def df(self) -> DataFrame:
        """cycle, pos and the features under their logical names."""
        return self.rows.df.select(self.cycle, self.pos, *(F.col(f"`{h}`").alias(n) for n, h in self.held.items()))

    def agg(self, columns: dict[str, Column | Quantile]) -> dict:
        """One row of aggregates over all cycles: a job of its own, and for quantiles another or a few."""
        plain = {n: c for n, c in columns.items() if not isinstance(c, Quantile)}
        found: dict = quantiles.exact(self.rows.df, {n: c for n, c in columns.items() if isinstance(c, Quantile)})
        if plain:
            row = self.rows.df.agg(*(c.alias(f"_{i}") for i, c in enumerate(plain.values()))).first()
            found |= {name: row[i] for i, name in enumerate(plain)}
        return {name: found[name] for name in columns}

    def per_cycle(self, columns: dict[str, Column]) -> DataFrame:
        found = self.rows.df.groupBy(*self.rows.by).agg(*(c.alias(n) for n, c in columns.items()))
        return found.drop(self.rows.unit) if self.rows.unit else found


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in all floating columns, which become double."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n).cast("double")) for n in floats}) if floats else df


class CycleSet:
    """A dataset of cycles: a DataFrame with a cycle column, an order and a RUL column.

    ``order`` must be total within a cycle; positions are numbered once, here. ``columns_of`` may say
    which features each cycle has, where cycles differ; by default all have all.
    """

    def __init__(
        self, df: DataFrame, cycle: str = "cycle_id", order: Sequence[str] | str = "pos", rul: str = "RUL", features: Sequence[str] | None = None,
        columns_of: dict[object, Sequence[str]] | None = None, positions: bool = True, unit: str | None = None,
    ) -> None:
        self.cycle, self.rul, self.columns_of, self.unit = cycle, rul, columns_of, unit
        order = [order] if isinstance(order, str) else list(order)
        df = no_nan(df)
        self.pos = "pos"
        if positions and order != ["pos"]:
            df = df.withColumn("pos", F.row_number().over(Window.partitionBy(cycle).orderBy(*order)).cast("long") - 1)
        self.df = df
        self.features = list(features) if features is not None else [c for c in df.columns if c not in (cycle, "pos", unit)]

    @property
    def rul_column(self) -> str:
        return self.rul

    def frame(self, names: Sequence[str] | None = None) -> Frame:
        names = self.features if names is None else list(names)
        return Frame(Rows(self.df, self.cycle, self.pos, self.unit), {n: n for n in names})

    def _with(self, df: DataFrame) -> CycleSet:
        return CycleSet(df, self.cycle, "pos", self.rul, self.features, self.columns_of, positions=False, unit=self.unit)

    # Schema --------------------------------------------------------------------------------------
    def common_features(self) -> list[str]:
        """The features that every cycle has, by name."""
        if not self.columns_of:
            return sorted(self.features)
        return sorted(set.intersection(*map(set, self.columns_of.values())) & set(self.features))

    def numeric_features(self, include_rul: bool = True) -> list[str]:
        return [c for c in self.frame(self.common_features()).numeric if include_rul or c != self.rul]

    def categorical_features(self) -> list[str]:
        return self.frame(self.common_features()).categorical

    # Cycles --------------------------------------------------------------------------------------
    def cycles(self) -> DataFrame:
        """(cycle, ordinal): cycles by id, numbered from 0; a small table of one row each."""
        return numbered(self.df.select(self.cycle).distinct(), [self.cycle], "ordinal")

    @property
    def n_time_series(self) -> int:
        return self.df.select(self.cycle).distinct().count()

    def sizes(self) -> DataFrame:
        return self.df.groupBy(self.cycle).agg(F.count("*").alias("n"))

    def durations(self) -> DataFrame:
        """The largest RUL of each cycle."""
        return self.df.groupBy(self.cycle).agg(F.max(self.rul).alias("duration"))

    def duration(self, cycle: object) -> float | None:
        return self.cycle_frame(cycle).agg(F.max(self.rul)).first()[0]

    def number_of_samples(self) -> int:
        return self.df.count()

    def cycle_frame(self, cycle: object) -> DataFrame:
        return self.df.filter(F.col(self.cycle).eqNullSafe(F.lit(cycle)))

    def fold(self, cycles: Sequence[object]) -> FoldedSet:
        """The cycles with these ids, in this order."""
        return FoldedSet(self, list(cycles))

    def __getitem__(self, key: int | slice | Iterable[int]) -> DataFrame | FoldedSet:
        """A cycle by its ordinal (a DataFrame), or a fold of several."""
        known = self.cycles()
        if isinstance(key, int):
            place = key if key >= 0 else key + known.count()
            found = known.filter(F.col("ordinal") == place).first()
            if found is None:
                raise IndexError(key)
            return self.cycle_frame(found[0]).orderBy("pos")
        size = known.count()
        places = list(range(*key.indices(size))) if isinstance(key, slice) else [i if i >= 0 else i + size for i in key]
        # Only the ids that are asked for come to the driver.
        ids = {r[1]: r[0] for r in known.filter(F.col("ordinal").isin(places)).collect()}
        return self.fold([ids[i] for i in places])

    def __len__(self) -> int:
        return self.n_time_series

    def map(self, transformer: object) -> DataFrame:
        return transformer.transform(self)

    def sampled(self, proportion_of_lives: float = 1.0, subsample_proportion: float = 1.0, seed: int = 0) -> DataFrame:
        """The common features of a share of the cycles, and of those every n-th row."""
        df = self.df.select(self.cycle, "pos", *self.common_features())
        if proportion_of_lives < 1:
            df = df.filter(F.pmod(F.xxhash64(F.col(self.cycle), F.lit(seed)), F.lit(1_000_000)) < int(proportion_of_lives * 1_000_000))
        stride = max(1, round(1 / subsample_proportion)) if subsample_proportion > 0 else 1
        return df.filter(F.col("pos") % stride == 0) if stride > 1 else df

    def to_pandas(self, proportion_of_lives: float = 1.0, subsample_proportion: float = 1.0, seed: int = 0) -> pd.DataFrame:
        return self.sampled(proportion_of_lives, subsample_proportion, seed).orderBy(self.cycle, "pos").toPandas()

    # Metadata ------------------------------------------------------------------------------------
    def metadata(self, columns: dict[str, str] | None = None) -> DataFrame:
        """Per cycle: number of samples, duration, and the first value of each chosen column."""
        missing = [c for c in (columns or {}).values() if c not in self.df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        first = [F.min_by(c, "pos").alias(n) for n, c in (columns or {}).items()]
        found = self.df.groupBy(*self.frame([]).rows.by).agg(F.count("*").alias("n_samples"), F.max(self.rul).alias("duration"), *first)
        return found.drop(self.unit) if self.unit else found


class FoldedSet(CycleSet):
    """Some cycles of a set, by a semi-join with their (few) ids; folds of folds lead back to the first set."""

    def __init__(self, base: CycleSet, cycles: list) -> None:
        self.base, self.ids = base, cycles
        kind = base.df.schema[base.cycle].dataType.simpleString()
        ids = base.df.sparkSession.createDataFrame([(c,) for c in cycles], f"{base.cycle} {kind}") if cycles else base.df.select(base.cycle).limit(0)
        super().__init__(base.df.join(ids.distinct(), base.cycle, "left_semi"), base.cycle, "pos", base.rul, base.features, base.columns_of, positions=False, unit=base.unit)

    def original(self) -> list:
        """The ids in the set at the bottom."""
        return list(self.ids)

    def __getitem__(self, key: int | slice | Iterable[int]) -> DataFrame | FoldedSet:
        if isinstance(key, int):
            return self.cycle_frame(self.ids[key]).orderBy("pos")
        return FoldedSet(self, self.ids[key] if isinstance(key, slice) else [self.ids[i] for i in key])


def from_cycles(spark, frames: Sequence[pd.DataFrame], rul: str = "RUL") -> CycleSet:
    """An in-memory set from one pandas frame a cycle; a column that a cycle lacks is NULL there."""
    parts, columns_of = [], {}
    for i, frame in enumerate(frames):
        columns_of[i] = list(frame.columns)
        parts.append(frame.reset_index(drop=True).assign(cycle_id=i, pos=range(len(frame))))
    joined = pd.concat(parts, ignore_index=True)
    joined = joined.astype({c: object for c in joined.columns if joined[c].dtype == object})
    df = spark.createDataFrame(joined)
    return CycleSet(df, "cycle_id", "pos", rul, [c for c in joined.columns if c not in ("cycle_id", "pos")], columns_of)
