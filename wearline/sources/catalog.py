"""Published run-to-failure datasets, from files that are already there (nothing is downloaded)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.frame import CycleSet
from wearline.sources.builder import DatasetBuilder, FailureDataCycleSplitter, NumberOfRowsRULColumn

__all__ = ["CMAPSS_COLUMNS", "FAULTS", "faults_that_start_with", "read_cmapss", "read_cmapss_cycles", "read_ncmapss", "read_tool_logs", "rul_of_test", "rul_of_train", "store_ncmapss"]

# The columns of the turbofan files, and the fault names of the etching tools.
CMAPSS_COLUMNS = ("UnitNumber", "Cycle", "OpSet1", "OpSet2", "OpSet3", *(f"SensorMeasure{i}" for i in range(1, 22)))
OPERATION_MODES = {"FD001": 0, "FD002": 1, "FD003": 2, "FD004": 3}
FAULTS = (
    "FlowCool Pressure Dropped Below Limit",
    "Flowcool Pressure Too High Check Flowcool Pump",
    "Flowcool leak",
    "Flowcool Pressure Too High Check Flowcool Pump [NoWaferID]",
)


def faults_that_start_with(text: str) -> list[str]:
    return [f for f in FAULTS if f.startswith(text)]


def read_cmapss(spark: SparkSession, path: str) -> DataFrame:
    """A turbofan file: 26 numbers a line, split at white space; lines with other counts are NULL beyond theirs."""
    parts = F.split(F.trim("value"), r"\s+")
    columns = [F.get(parts, F.lit(i)).cast("int" if i < 2 else "double").alias(n) for i, n in enumerate(CMAPSS_COLUMNS)]
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(*columns)


def rul_of_train(df: DataFrame) -> DataFrame:
    """Cycles left to each unit's last."""
    return df.withColumn("RUL", F.max("Cycle").over(Window.partitionBy("UnitNumber")) - F.col("Cycle"))


def rul_of_test(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Cycles left, where ``truth`` (UnitNumber, truth) says how many remain after each unit's last row."""
    elapsed = df.withColumn("Elapsed", F.max("Cycle").over(Window.partitionBy("UnitNumber")))
    joined = elapsed.join(truth.select("UnitNumber", "truth"), "UnitNumber", "left")
    return joined.withColumn("RUL", F.col("Elapsed") + F.col("truth") - F.col("Cycle"))


def read_cmapss_cycles(spark: SparkSession, folder: str, train: bool = True, models: Sequence[str] = ("FD001", "FD002", "FD003", "FD004")) -> CycleSet:
    """All units of the chosen models as cycles ``{model}_{unit}``."""
    unknown = [m for m in models if m not in OPERATION_MODES]
    if unknown:
        raise ValueError(f"unknown models {unknown}")
    out = None
    for model in models:
        df = read_cmapss(spark, f"{folder}/{'train' if train else 'test'}_{model}.txt")
        if train:
            df = rul_of_train(df)
        else:
            lines = spark.read.text(f"{folder}/RUL_{model}.txt").select("value", F.monotonically_increasing_id().alias("_line"))
            # A line for each unit, in order: a few hundred.
            truth = lines.filter(F.length(F.trim("value")) > 0).select(F.trim("value").cast("int").alias("truth"), F.row_number().over(Window.orderBy("_line")).alias("UnitNumber"))
            df = rul_of_test(df, truth)
        part = df.withColumns({"Engine": F.lit(model), "OpMode": F.lit(OPERATION_MODES[model]), "cycle_id": F.concat_ws("_", F.lit(model), "UnitNumber")})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return CycleSet(out, "cycle_id", "Cycle", "RUL")


def store_ncmapss(spark: SparkSession, path: str, target: str) -> DataFrame:
    """An HDF5 flight file to Parquet by unit: blocks W, X_s, X_v and T side by side, with RUL and auxiliaries.

    Needs h5py, which reads on the driver block by block: the format has no splits.
    """
    import h5py
    import numpy as np
    import pandas as pd

    text = lambda names: [n.decode() if isinstance(n, bytes) else str(n) for n in np.ravel(names)]
    step = 500_000
    with h5py.File(path, "r") as held:
        for kind in ("dev", "test"):
            total = held[f"Y_{kind}"].shape[0]
            for start in range(0, total, step):
                rows = slice(start, min(start + step, total))
                blocks = [pd.DataFrame(held[f"{b}_{kind}"][rows], columns=text(held[f"{b}_var"])) for b in ("W", "X_s", "X_v", "T", "A")]
                part = pd.concat([*blocks, pd.DataFrame({"RUL": np.ravel(held[f"Y_{kind}"][rows])})], axis=1)
                part["Train"], part["row"] = kind == "dev", np.arange(rows.start, rows.stop)
                part["cycle_id"] = part["unit"].astype(int).astype(str) + "_" + kind
                spark.createDataFrame(part).write.mode("append").partitionBy("Train", "cycle_id").parquet(target)
    return spark.read.parquet(target)


def read_ncmapss(spark: SparkSession, target: str, train: bool | None = None) -> CycleSet:
    """Stored flights as cycles; the choice of train or test prunes folders."""
    df = spark.read.parquet(target)
    return CycleSet(df if train is None else df.filter(F.col("Train") == train), "cycle_id", "row", "RUL")


def read_tool_logs(spark: SparkSession, pairs: Sequence[tuple[str, str]], failure_types: Sequence[str] | None = None, tools: Sequence[str] | None = None) -> CycleSet:
    """Sensor and fault logs of etching tools: cycles lead up to faults, RUL counts rows."""
    loaded = [tuple(spark.read.options(header="true", inferSchema="true").csv(p) for p in pair) for pair in pairs]
    builder = DatasetBuilder().set_splitting_method(FailureDataCycleSplitter("time", "time")).set_rul_column_method(NumberOfRowsRULColumn()).set_order("time")
    cycles = builder.pair_cycles(loaded)
    df = cycles.df
    if failure_types:
        df = df.filter(F.col("fault_name").isin(list(failure_types)))
    if tools:
        df = df.filter(F.col("Tool_data" if "Tool_data" in df.columns else "Tool").isin(list(tools)))
    return cycles._with(df)

