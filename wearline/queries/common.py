"""The test tables as cycles, and what queries share.

``events`` is the log of many units (users): an error event closes a cycle, the RUL is the time left
in hours, the sensors are ``value`` and ``k``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.frame import CycleSet, Frame
from wearline.sources import DatasetBuilder, DatetimeRULColumn, InMemoryOutputMode, LifeEndIndicatorCycleSplitter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The cycles of ``events`` in SQL: ``d`` has cycle_id, pos, ts, event_id, event_type, value, k, rul, and u, o, cyc.
BASE = """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS u, event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o FROM events),
c AS (
  SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
    OVER (PARTITION BY u ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cyc FROM e),
d AS (
  SELECT 'Cycle_1:' || u || '_' || CAST(cyc + 1 AS BIGINT) AS cycle_id, row_number() OVER (PARTITION BY u, cyc ORDER BY o) - 1 AS pos,
    ts, event_id, event_type, value, k, u, o, cyc, (epoch_us(max(ts) OVER (PARTITION BY u, cyc)) - epoch_us(ts)) / 3.6e9 AS rul FROM c)
"""

#: Windows of a cycle.
WINDOWS = """
WINDOW wc AS (PARTITION BY cycle_id ORDER BY pos), whole AS (PARTITION BY cycle_id),
  r5 AS (PARTITION BY cycle_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  m5 AS (PARTITION BY cycle_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
  ex AS (PARTITION BY cycle_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  fw AS (PARTITION BY cycle_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, and its SQL (after BASE where it reads ``d``)."""

    def register(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


SHIFT = 1.3e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded, without a negative zero; other columns as they are.

    Means of decimals often lie on a tie, where the last bit of a sum would decide; a shift far below
    the digits shown, the same in SQL, takes them off it.
    """
    scale = 10.0**digits

    def one(name: str) -> Column:
        x = F.col(f"`{name}`").cast("double") + F.lit(SHIFT)
        # As DuckDB does it; by way of a decimal's text it takes longer than most of what is rounded. Beyond 2^52 there are no digits left.
        return F.when(F.abs(x) * scale < 2.0**52, F.rint(x * scale) / scale).otherwise(F.round(x, digits)) + F.lit(0.0)

    return df.select(*(one(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields))


def r(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE) + {SHIFT}, {digits}) + 0e0)"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table's times have no zone: they are read as UTC, whatever the session's zone is.
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.timestamp_micros(micros))
    return events.select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def builder() -> DatasetBuilder:
    return (
        DatasetBuilder()
        .set_splitting_method(LifeEndIndicatorCycleSplitter("event_type", "error"))
        .set_rul_column_method(DatetimeRULColumn("ts", "h"))
        .set_machine_id_feature("user_id")
        .set_order("ts", "event_id")
        .set_output_mode(InMemoryOutputMode())
    )


def cycles(spark: SparkSession, sf_dir: str) -> CycleSet:
    return builder().cycles(raw_events(spark, sf_dir))


def sensors(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("value",)) -> Frame:
    return cycles(spark, sf_dir).frame(list(names))


def gaps(frame: Frame) -> Frame:
    """The first feature with holes: NULL at every seventh event id."""
    name = frame.columns[0]
    return frame.select([name]).compute({name: F.when(F.col("event_id") % 7 != 0, frame.col(name))})
