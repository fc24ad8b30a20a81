"""From raw logs to cycles with RUL.

A splitter adds the cycle's ordinal within its unit by window functions partitioned by the unit: one
shuffle by the unit, and the RUL of a cycle reuses it. Units are the machines, files or pairs that
raw rows come from.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.frame import CycleSet, no_nan
from wearline.shipping import ship
from wearline.sources.readers import load_cycles, load_dataframe

__all__ = [
    "CycleRULColumn", "CyclesSplitter", "DatasetBuilder", "DatasetFormat", "DatetimeRULColumn", "FailureDataCycleSplitter", "InMemoryOutputMode",
    "IncreasingFeatureCycleSplitter", "LifeEndIndicatorCycleSplitter", "LifeIdCycleSplitter", "LocalStorageOutputMode", "NumberOfRowsRULColumn", "OutputMode",
    "RULColumn", "asof_forward",
]

UNIT, ORDER, CYCLE = "_unit", "_order", "_cycle"


def asof_forward(left: DataFrame, right: DataFrame, on: tuple[str, str], by: Sequence[str] = (), columns: Sequence[str] = ()) -> DataFrame:
    """Each left row with ``columns`` of the first right row whose time is not before its own; NULL where there is none.

    Both sides go through one window as one table: a shuffle by ``by``, no join. ``columns`` must not
    clash with columns of the left side.
    """
    right_time = "_right_time"
    wanted = F.struct(F.col(on[1]).alias(right_time), *(F.col(c) for c in columns))
    a = left.withColumns({"_t": F.col(on[0]), "_side": F.lit(0)})
    b = right.filter(F.col(on[1]).isNotNull()).select(*by, F.col(on[1]).cast(left.schema[on[0]].dataType).alias("_t"), F.lit(1).alias("_side"), wanted.alias("_found"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    # A left row without a time finds nothing.
    found = both.withColumn("_found", F.when(F.col("_t").isNotNull(), F.first("_found", ignorenulls=True).over(w)))
    times = [] if on[1] in left.columns else [F.col(f"_found.{right_time}").alias(on[1])]
    return found.filter("_side = 0").select(*left.columns, *times, *(F.col(f"_found.{c}").alias(c) for c in columns))


class CyclesSplitter:
    """Adds ``_cycle``, the ordinal of each row's cycle in its unit; rows with NULL there belong to none."""

    def split(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    @staticmethod
    def ordered() -> Window:
        return Window.partitionBy(UNIT).orderBy(ORDER)


class IncreasingFeatureCycleSplitter(CyclesSplitter):
    """A cycle ends where a feature that grows within cycles falls."""

    def __init__(self, increasing_feature: str) -> None:
        self.feature = increasing_feature

    def split(self, df: DataFrame) -> DataFrame:
        fell = F.coalesce(F.col(self.feature) < F.lag(self.feature).over(self.ordered()), F.lit(False))
        df = df.withColumn("_fell", fell.cast("long"))
        return df.withColumn(CYCLE, F.sum("_fell").over(self.ordered().rowsBetween(Window.unboundedPreceding, 0))).drop("_fell")


class LifeIdCycleSplitter(CyclesSplitter):
    """One cycle for each id, in order of first appearance."""

    def __init__(self, life_id_feature: str) -> None:
        self.feature = life_id_feature

    def split(self, df: DataFrame) -> DataFrame:
        first = F.min(ORDER).over(Window.partitionBy(UNIT, self.feature))
        df = df.withColumn("_first", F.when(F.col(self.feature).isNotNull(), first))
        numbered = F.dense_rank().over(Window.partitionBy(UNIT).orderBy(F.col("_first").asc_nulls_last())).cast("long") - 1
        return df.withColumn(CYCLE, F.when(F.col("_first").isNotNull(), numbered)).drop("_first")


class LifeEndIndicatorCycleSplitter(CyclesSplitter):
    """A row with the end value closes its cycle; the rows after the last one make a last cycle."""

    def __init__(self, life_end_indicator_feature: str, end_value: object = 1) -> None:
        self.feature, self.end_value = life_end_indicator_feature, end_value

    def split(self, df: DataFrame) -> DataFrame:
        ended = F.coalesce((F.col(self.feature) == F.lit(self.end_value)).cast("long"), F.lit(0).cast("long"))
        before = self.ordered().rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(CYCLE, F.coalesce(F.sum(ended).over(before), F.lit(0).cast("long")))


class FailureDataCycleSplitter(CyclesSplitter):
    """A cycle is what leads up to a fault: sensor rows with the first fault not before them.

    Faults of one time count once; rows after the last fault belong to no cycle. Columns of faults
    come along, with ``_data`` and ``_fault`` after names that both have.
    """

    def __init__(self, data_time_column: str, fault_time_column: str) -> None:
        self.data_time, self.fault_time = data_time_column, fault_time_column

    def split_pairs(self, data: DataFrame, faults: DataFrame) -> DataFrame:
        faults = faults.dropDuplicates([UNIT, self.fault_time]).filter(F.col(self.fault_time).isNotNull())
        faults = faults.withColumn(CYCLE, F.row_number().over(Window.partitionBy(UNIT).orderBy(self.fault_time)).cast("long") - 1)
        clash = [c for c in data.columns if c in faults.columns and c != UNIT]
        data = data.withColumnsRenamed({c: f"{c}_data" for c in clash})
        faults = faults.withColumnsRenamed({c: f"{c}_fault" for c in clash})
        times = tuple(f"{t}{s}" if t in clash else t for t, s in ((self.data_time, "_data"), (self.fault_time, "_fault")))
        rest = [c for c in faults.columns if c not in (UNIT, times[1])]
        return asof_forward(data, faults, times, [UNIT], rest)

    def split(self, df: DataFrame) -> DataFrame:
        raise ValueError("faults are needed: build from pairs of data and faults")


class RULColumn:
    """An expression over a window of the whole cycle."""

    def column(self, whole: Window, pos: Column) -> Column:
        raise NotImplementedError


class NumberOfRowsRULColumn(RULColumn):
    """Rows left."""

    def column(self, whole: Window, pos: Column) -> Column:
        return F.count("*").over(whole) - 1 - pos


class CycleRULColumn(RULColumn):
    """The greatest value of a column, less its own."""

    def __init__(self, cycle_column: str) -> None:
        self.name = cycle_column

    def column(self, whole: Window, pos: Column) -> Column:
        return F.max(self.name).over(whole) - F.col(self.name)


class DatetimeRULColumn(RULColumn):
    """Time left, in days, hours, minutes, seconds or milliseconds."""

    _MICROS = {"d": 86_400e6, "h": 3_600e6, "m": 60e6, "min": 60e6, "s": 1e6, "ms": 1e3}

    def __init__(self, datetime_column: str, units: str = "h") -> None:
        if units not in self._MICROS:
            raise ValueError(f"unknown unit {units}")
        self.name, self.units = datetime_column, units

    def column(self, whole: Window, pos: Column) -> Column:
        micros = F.unix_micros(F.col(self.name).cast("timestamp"))
        return (F.max(micros).over(whole) - micros) / F.lit(self._MICROS[self.units])


class DatasetFormat:
    CSV = "csv"
    PARQUET = "parquet"
    FEATHER = "feather"


class OutputMode:
    """Where cycles go; ``set_metadata_columns`` names columns whose first value describes a cycle."""

    def __init__(self) -> None:
        self.metadata_columns: dict[str, str] = {}

    def set_metadata_columns(self, columns: dict[str, str]) -> OutputMode:
        self.metadata_columns = dict(columns)
        return self

    def store(self, cycles: CycleSet) -> CycleSet:
        raise NotImplementedError


class InMemoryOutputMode(OutputMode):
    """Cached rows; a lost executor's part is computed again."""

    def store(self, cycles: CycleSet) -> CycleSet:
        cycles.metadata(self.metadata_columns)
        return cycles._with(cycles.df.cache())


class LocalStorageOutputMode(OutputMode):
    """A folder with the rows, in folders by cycle, and a table of metadata."""

    def __init__(self, path: str, output_format: str = DatasetFormat.PARQUET) -> None:
        super().__init__()
        self.path, self.format = path.rstrip("/"), output_format

    def store(self, cycles: CycleSet) -> CycleSet:
        where, cycle = f"{self.path}/cycles", cycles.cycle
        metadata = cycles.metadata(self.metadata_columns)
        if self.format == DatasetFormat.FEATHER:
            self._feather(cycles, where)
        else:
            # All rows of a cycle meet in one task, and so in one file.
            dealt = cycles.df.select(cycle, "pos", *cycles.features).repartition(cycle).sortWithinPartitions(cycle, "pos")
            writer = dealt.write.mode("overwrite").partitionBy(cycle)
            writer.option("header", "true").csv(where) if self.format == DatasetFormat.CSV else writer.parquet(where)
        metadata.withColumns({"format": F.lit(self.format), "cycle_column": F.lit(cycle)}).write.mode("overwrite").parquet(f"{self.path}/metadata")
        return load_cycles(cycles.df.sparkSession, self.path, cycles.rul)

    def _feather(self, cycles: CycleSet, where: str) -> None:
        """One file per cycle, written by the tasks: the folder must be one that all of them share."""
        import os

        master = cycles.df.sparkSession.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("feather files are written to one machine's folder: use Parquet or CSV on a cluster")
        ship(cycles.df.sparkSession)
        os.makedirs(where, exist_ok=True)
        cycle = cycles.cycle
        names = [cycle, "pos", *cycles.features]

        def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            path = f"{where}/cycle_{key[0]}.feather"
            # A task that runs twice writes the same file; readers see it whole or not at all.
            part[names].sort_values("pos").reset_index(drop=True).to_feather(f"{path}.part")
            os.replace(f"{path}.part", path)
            return pd.DataFrame({"path": [path]})

        cycles.df.groupBy(cycle).applyInPandas(write, "path string").count()


class DatasetBuilder:
    """Raw tables to a set of cycles; set a splitter, a RUL and an output, then build.

    ``order`` names the columns by which raw rows are in time order (Spark tables have no order of
    their own); the machine column makes units within a table.
    """

    def __init__(self, loader: Callable[[SparkSession, str], DataFrame] = load_dataframe) -> None:
        self.loader = loader
        self.splitter: CyclesSplitter | None = None
        self.rul: RULColumn | None = None
        self.output: OutputMode | None = None
        self.machine: str | None = None
        self.index: str | None = None
        self.order: list[str] = []

    def set_splitting_method(self, splitter: CyclesSplitter) -> DatasetBuilder:
        self.splitter = splitter
        return self

    def set_rul_column_method(self, rul: RULColumn) -> DatasetBuilder:
        self.rul = rul
        return self

    def set_output_mode(self, output: OutputMode) -> DatasetBuilder:
        self.output = output
        return self

    def set_machine_id_feature(self, name: str) -> DatasetBuilder:
        self.machine = name
        return self

    def set_index_column(self, name: str) -> DatasetBuilder:
        self.index = name
        return self

    def set_order(self, *columns: str) -> DatasetBuilder:
        self.order = list(columns)
        return self

    def _validate(self) -> None:
        if self.output is None:
            raise ValueError("set an output mode")
        if self.splitter is None:
            raise ValueError("set a splitting method")
        if not (self.order or self.index):
            raise ValueError("set the order of rows, or an index column")

    def _united(self, frames: Sequence[DataFrame]) -> DataFrame:
        """All tables as one, with a unit for each table (and machine)."""
        out = None
        for i, df in enumerate(frames):
            machine = F.col(self.machine).cast("string") if self.machine and self.machine in df.columns else F.lit("")
            part = no_nan(df).withColumn(UNIT, F.concat_ws(":", F.lit(str(i + 1)), machine))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _ordered(self, df: DataFrame) -> DataFrame:
        order = self.order or [self.index]
        return df.withColumn(ORDER, F.row_number().over(Window.partitionBy(UNIT).orderBy(*order)).cast("long") - 1)

    def cycles(self, frames: DataFrame | Sequence[DataFrame]) -> CycleSet:
        """The cycles, lazily."""
        frames = [frames] if isinstance(frames, DataFrame) else list(frames)
        return self._labelled(self.splitter.split(self._ordered(self._united(frames))))

    def _labelled(self, df: DataFrame) -> CycleSet:
        df = df.filter(F.col(CYCLE).isNotNull())
        within = Window.partitionBy(UNIT, CYCLE)
        df = df.withColumn("pos", F.row_number().over(within.orderBy(ORDER)).cast("long") - 1)
        rul = (self.rul or NumberOfRowsRULColumn()).column(within, F.col("pos"))
        df = df.withColumn("RUL", rul).withColumn("cycle_id", F.concat_ws("_", F.lit("Cycle"), F.rtrim(F.col(UNIT), F.lit(":")), F.col(CYCLE) + 1))
        # The unit stays beside the features: the rows are partitioned by it.
        df = df.drop(ORDER, CYCLE)
        return CycleSet(df, "cycle_id", "pos", "RUL", [c for c in df.columns if c not in ("cycle_id", "pos", UNIT)], positions=False, unit=UNIT)

    def build_from_df(self, data: DataFrame | Sequence[DataFrame]) -> CycleSet:
        self._validate()
        return self.output.store(self.cycles(data))

    def build_from_single_files(self, spark: SparkSession, paths: str | Sequence[str]) -> CycleSet:
        self._validate()
        paths = [paths] if isinstance(paths, str) else list(paths)
        frames = [self.loader(spark, p).withColumn("Raw Data Filename", F.lit(p)) for p in paths]
        self.output.metadata_columns.setdefault("Raw Data Filename", "Raw Data Filename")
        return self.output.store(self.cycles(frames))

    def pair_cycles(self, pairs: Sequence[tuple[DataFrame, DataFrame]]) -> CycleSet:
        if not isinstance(self.splitter, FailureDataCycleSplitter):
            raise ValueError("pairs need a splitter by failure data")
        data = self._ordered(self._united([d for d, _ in pairs]))
        faults = self._united([f for _, f in pairs])
        return self._labelled(self.splitter.split_pairs(data, faults))

    def build_from_data_fault_pairs(self, pairs: tuple[DataFrame, DataFrame] | Sequence[tuple[DataFrame, DataFrame]]) -> CycleSet:
        self._validate()
        pairs = [pairs] if isinstance(pairs, tuple) else list(pairs)
        return self.output.store(self.pair_cycles(pairs))

    def build_from_data_fault_pairs_files(self, spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> CycleSet:
        loaded = [(self.loader(spark, a).withColumn("Raw Data Filename", F.lit(a)), self.loader(spark, b)) for a, b in pairs]
        return self.build_from_data_fault_pairs(loaded)

