"""Fewer or other rows of a cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from wearline.frame import Frame, Rows
from wearline.plans.graph import Step

__all__ = ["IndexMeanResampler", "IntegerIndexResamplerTransformer", "Subsample", "SubsamplerTransformer"]


class Subsample(Step):
    """Every k-th row; positions stay."""

    def __init__(self, steps: int, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.steps = steps

    def apply(self, frame: Frame) -> Frame:
        return frame.where(F.col(frame.pos) % self.steps == 0)


def _regrouped(frame: Frame, keys: dict[str, Column], order: Column, values: dict[str, Column]) -> Frame:
    """Means by cycle and key, numbered by the first row of each group."""
    df = frame.rows.df.groupBy(*frame.rows.by, *(c.alias(n) for n, c in keys.items())).agg(order.alias("_order"), *(c.alias(n) for n, c in values.items()))
    number = F.row_number().over(Window.partitionBy(*frame.rows.by).orderBy("_order")).cast("long") - 1
    return Frame(Rows(df.withColumn(frame.pos, number), frame.cycle, frame.pos, frame.rows.unit), {n: n for n in [*keys, *values]})


class IndexMeanResampler(Step):
    """Means of numeric features in time bins of ``rule`` (such as "1 minute"); bins with a missing mean are dropped."""

    def __init__(self, rule: str, time_feature: str, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.rule, self.time_feature = rule, time_feature

    def apply(self, frame: Frame) -> Frame:
        names = [n for n in frame.numeric if n != self.time_feature]
        start = F.window(frame.col(self.time_feature).cast("timestamp"), self.rule)["start"]
        # The bin is a column of its own first: window() may stand alone only.
        held = frame.rows.add({"bin": start})["bin"]
        found = _regrouped(frame, {self.time_feature: F.col(held)}, F.min(held), {n: F.avg(frame.col(n)) for n in names})
        kept = found.rows.df.dropna(subset=names)
        return Frame(Rows(kept, frame.cycle, frame.pos, frame.rows.unit), found.held).renumbered()


class SubsamplerTransformer(Step):
    """Means by ``time // steps``, in order of first appearance."""

    def __init__(self, time_feature: str, steps: float, drop_time_feature: bool = True, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.time_feature, self.steps, self.drop_time_feature = time_feature, steps, drop_time_feature

    def apply(self, frame: Frame) -> Frame:
        names = [n for n in frame.numeric if not (self.drop_time_feature and n == self.time_feature)]
        bin_ = F.floor(frame.col(self.time_feature) / self.steps)
        found = _regrouped(frame, {"_bin": bin_}, F.min(frame.pos), {n: F.avg(frame.col(n)) for n in names})
        return found.select(names)


class IntegerIndexResamplerTransformer(Step):
    """Linear interpolation on the grid min, min + steps, ... below max of a numeric time; other kinds take the nearest sample.

    Grid points join the samples of their cycle as rows of one window: the last sample at or before
    and the first at or after each grid point give the line.
    """

    def __init__(self, time_feature: str, steps: float, drop_time_feature: bool = True, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.time_feature, self.steps, self.drop_time_feature = time_feature, steps, drop_time_feature

    def _between(self, names: Sequence[str], numeric: set[str]) -> dict[str, Column]:
        out = {}
        t, a, b = F.col("_t"), F.col("_before._t"), F.col("_after._t")
        share = F.when(b > a, (t - a) / (b - a)).otherwise(F.lit(0.0))
        for n in names:
            x, y = F.col(f"_before.{n}"), F.col(f"_after.{n}")
            out[n] = x + (y - x) * share if n in numeric else F.when(F.coalesce(t - a <= b - t, F.lit(True)), x).otherwise(y)
        return out

    def apply(self, frame: Frame) -> Frame:
        names = [n for n in frame.columns if n != self.time_feature]
        numeric = set(frame.numeric)
        t = frame.col(self.time_feature).cast("double")
        by = frame.rows.by
        samples = frame.rows.df.filter(t.isNotNull()).select(*by, t.alias("_t"), F.struct(t.alias("_t"), *(frame.col(n).alias(n) for n in names)).alias("_s"))
        span = samples.groupBy(*by).agg(F.min("_t").alias("a"), F.max("_t").alias("b"))
        count = F.greatest(F.ceil((F.col("b") - F.col("a")) / self.steps), F.lit(0)).cast("int")
        grid = span.select(*by, "a", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("_k"))
        grid = grid.select(*by, (F.col("a") + F.col("_k") * float(self.steps)).alias("_t"), F.col("_k").cast("long").alias(frame.pos))
        both = samples.withColumn(frame.pos, F.lit(None).cast("long")).unionByName(grid, allowMissingColumns=True)
        w = Window.partitionBy(*by).orderBy("_t")
        seen = both.withColumn("_before", F.last("_s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
        seen = seen.withColumn("_after", F.first("_s", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)))
        found = seen.filter(F.col(frame.pos).isNotNull())
        values = self._between(names, numeric)
        if not self.drop_time_feature:
            values = {self.time_feature: F.col("_t"), **values}
        df = found.select(*by, frame.pos, *(c.alias(n) for n, c in values.items()))
        return Frame(Rows(df, frame.cycle, frame.pos, frame.rows.unit), {n: n for n in values})
