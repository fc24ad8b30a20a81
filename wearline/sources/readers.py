"""Raw tables and stored cycles, by file format.

CSV and Parquet are Spark's own readers. Formats that only pandas or Arrow reads (feather, Excel, HDF,
pickle) are read by tasks, one file each, from the bytes that Spark's ``binaryFile`` source brings, so
any store that Spark reaches will do.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wearline.frame import CycleSet
from wearline.shipping import ship

__all__ = ["load_cycle_files", "load_cycles", "load_dataframe", "read_file"]

_CSV = {"header": "true", "inferSchema": "true"}


def _suffix(path: str) -> str:
    return path.rstrip("/").rpartition(".")[2].lower()


def read_file(data: bytes, suffix: str) -> pd.DataFrame:
    """A pandas frame from the bytes of a file."""
    held = io.BytesIO(data)
    if suffix == "csv":
        return pd.read_csv(held)
    if suffix == "parquet":
        return pd.read_parquet(held)
    if suffix == "feather":
        return pd.read_feather(held)
    if suffix in ("xls", "xlsx"):
        return pd.read_excel(held)
    if suffix in ("pkl", "pickle"):
        return pd.read_pickle(held)
    if suffix in ("h5", "hdf5"):
        import tempfile

        # HDF readers want a path: a file of this task's own, gone afterwards.
        with tempfile.NamedTemporaryFile(suffix=".h5") as copy:
            copy.write(data)
            copy.flush()
            return pd.read_hdf(copy.name)
    raise ValueError(f"unknown format {suffix}")


def load_dataframe(spark: SparkSession, path: str) -> DataFrame:
    """A raw table from a csv, Parquet or xlsx file or folder; a missing path is Spark's own error."""
    suffix = _suffix(path)
    if suffix == "csv":
        return spark.read.options(**_CSV).csv(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("xls", "xlsx", "feather"):
        return _by_pandas(spark, path, suffix)
    raise ValueError(f"unknown format {suffix}")


def _by_pandas(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").first()
    if first is None:
        raise FileNotFoundError(path)
    schema = spark.createDataFrame(read_file(bytes(first[0]), suffix).head(100)).schema
    names = schema.names

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield read_file(bytes(content), suffix)[names]

    return files.select("content").mapInPandas(run, schema)


def load_cycles(spark: SparkSession, path: str, rul: str = "RUL") -> CycleSet:
    """A stored set: ``path/cycles`` holds the rows (Parquet, CSV or feather) and ``path/metadata`` one row per cycle.

    Filters on the cycle id prune folders before any file is opened.
    """
    metadata = spark.read.parquet(f"{path}/metadata")
    kind = metadata.select("format", "cycle_column").first()
    if kind is None:
        raise ValueError(f"{path} holds no cycles")
    where = f"{path}/cycles"
    if kind["format"] == "feather":
        df = _by_pandas(spark, f"{where}/*.feather", "feather")
    elif kind["format"] == "csv":
        df = spark.read.options(**_CSV).csv(where)
    else:
        df = spark.read.parquet(where)
    cycle = kind["cycle_column"]
    df = df.withColumn(cycle, F.col(cycle).cast(metadata.schema[cycle].dataType))
    return CycleSet(df, cycle, "pos", rul, [c for c in df.columns if c not in (cycle, "pos")], positions=False)


def load_cycle_files(spark: SparkSession, path: str, rul: str = "RUL", schema: StructType | str | None = None) -> CycleSet:
    """A set stored as one file a cycle: ``path/processed/cycles/cycles.csv`` lists them, in order, in its column Filename.

    Files are csv, xls(x), parquet, feather, HDF or pickle, also mixed; each is read whole by one task. A
    cycle's id is its place in the list, and a file that is listed twice is two cycles. Relative names
    start at ``path``. Without a schema the columns are those of the first file of each format; a
    column that a file lacks is NULL, others are left out.
    """
    ship(spark)
    listed = spark.read.option("header", "true").csv(f"{path}/processed/cycles/cycles.csv").select("Filename")
    # The list itself is needed here: Spark is told which files to read.
    names = [r[0] if r[0].startswith("/") or "://" in r[0] else f"{path.rstrip('/')}/{r[0]}" for r in listed.collect()]
    if not names:
        raise ValueError(f"{path} lists no cycles")
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(_local(name), []).append(i)
    of_kind: dict[str, list[str]] = {}
    for name in dict.fromkeys(names):
        of_kind.setdefault(_suffix(name), []).append(name)
    files = {suffix: spark.read.format("binaryFile").load(some).select("path", "content") for suffix, some in of_kind.items()}
    if schema is None:
        first = [_nulls(read_file(bytes(df.first()["content"]), suffix)) for suffix, df in files.items()]
        fields = {f.name: f for own in first for f in spark.createDataFrame(own.head(100)).schema.fields}
        schema = StructType(list(fields.values()))
    features = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*StructType.fromDDL("cycle_id long, pos long").fields, *features.fields])

    def reader(suffix: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for name, content in zip(part["path"], part["content"], strict=True):
                    own = _nulls(read_file(bytes(content), suffix).reindex(columns=features.names))
                    for i in places[_local(name)]:
                        yield own.assign(cycle_id=i, pos=range(len(own)))[whole.names]

        return run

    found = [df.mapInPandas(reader(suffix), whole) for suffix, df in files.items()]
    return CycleSet(reduce(DataFrame.unionByName, found), "cycle_id", "pos", rul, features.names, positions=False)


def _local(name: str) -> str:
    """A path without its scheme, as Spark and a list may write it differently."""
    return "/" + re.sub(r"^[a-z][a-z0-9+.-]*:", "", unquote(name)).lstrip("/")


def _nulls(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns of other than numbers, truth values and times as plain objects, with None for what is missing."""
    own = [c for c in frame.columns if not isinstance(frame[c].dtype, np.dtype) or frame[c].dtype.kind not in "biufmM" or frame[c].isna().all()]
    plain = {c: frame[c].astype(object).where(frame[c].notna(), None) for c in own}
    return frame.assign(**plain).reset_index(drop=True)
