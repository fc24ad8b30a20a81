"""Mergeable quantile sketches (KLL), for fits over more rows than exact quantiles should sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QuantileEstimator:
    """Sketches of columns: built by partial aggregation, merged across tables, asked for quantiles.

    ``size`` bounds a sketch's values and so its error, whatever the number of rows; NULLs are left out.
    """

    def __init__(self, size: int = 200) -> None:
        self.size = size

    def sketch(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """One row with a binary sketch of each column."""
        return df.agg(*(F.kll_sketch_agg_double(F.col(c).cast("double"), self.size).alias(c) for c in columns))

    def merge(self, *sketches: DataFrame) -> DataFrame:
        both = reduce(lambda a, b: a.unionByName(b), sketches)
        return both.agg(*(F.kll_merge_agg_double(c, self.size).alias(c) for c in both.columns))

    def quantile(self, sketches: DataFrame, q: float) -> dict[str, float]:
        row = sketches.select(*(F.kll_sketch_get_quantile_double(c, F.lit(float(q))).alias(c) for c in sketches.columns)).first()
        return row.asDict()
