"""What the corpus operators share: reading, Arrow batches, reading texts as bytes."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wearline.shipping import checkpoint_dir, ship

Held = TypeVar("Held")

#: Rows and bytes of an Arrow batch at most (Spark ends a batch after the row that passes the bytes).
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: Text bytes that an operator works on at once, where texts are shorter than that.
BATCH_TEXT = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package, set the checkpoint folder and bound the session's Arrow batches.

    The bounds stay set: plans run after the operator has returned. A caller's smaller bounds are kept.
    """
    ship(spark)
    checkpoint_dir(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder of checkpoints: lineage ends there, and their size is known to the planner."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows (of a few hundred bytes at most) that are broadcast; more go through a shuffle.
MAX_BROADCAST_ROWS = 100_000


def small(rows: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has so many at most."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def extended(docs: DataFrame, ddl: str) -> StructType:
    """The schema of a table with further columns."""
    return StructType([*docs.schema.fields, *StructType.fromDDL(ddl).fields])


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], Held]) -> Held:
    """What a worker keeps from task to task: the state of the operator it ran last, and no other.

    Workers live as long as the application; tables and memos of all operators would add up in them.
    What the last one held goes back to the system, where the C library can do that.
    """
    if key not in _HELD:
        _HELD.clear()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            gc.collect()
            trim(0)
        _HELD[key] = make()
    return _HELD[key]


def vocabulary_file(name: str) -> str:
    """The file of a public vocabulary on this machine; a path is taken as it is."""
    return name if os.sep in name else public_tokenizers.path(name)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow string column; null as empty."""
    return [x or "" for x in column.to_pylist()]


def bounded(batches: Iterator[pa.RecordBatch], column: int, limit: int = BATCH_TEXT) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts pass ``limit`` bytes only where one text does.

    Arrow batches are bounded in rows, not bytes; what an operator makes of a batch is bounded by this.
    """
    for batch in batches:
        if batch.num_rows <= 1 or batch.column(column).nbytes <= limit:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for i, one in enumerate(sizes):
            if i > start and size + one > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += one
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Join small batches until their text passes ``limit`` bytes (one batch is never split)."""
    some: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        some.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield from _joined(some)
            some, size = [], 0
    if some:
        yield from _joined(some)


def _joined(some: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """One batch, or more where one would be beyond Arrow's 2 GB."""
    return some if len(some) == 1 else pa.Table.from_batches(some).combine_chunks().to_batches()
