"""Statistics of windows and of whole cycles, and other expressions along a cycle."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from wearline.frame import Frame, Rows
from wearline.functions import stats
from wearline.plans.graph import Step

__all__ = [
    "Accumulate", "ChangesDetector", "Diff", "DoG", "EWMAFilter", "ExpandingCentering", "ExpandingNormalization", "ExpandingStatistics", "GaussianFilter",
    "LifeStatistics", "LocalEntropyMeasures", "MeanFilter", "MedianFilter", "RollingCentering", "RollingStatistics", "SampleNumber", "SubstractLinebase",
    "TimeToPreviousBinaryValue", "apply_rolling_data", "rolling_kurtosis",
]


def at_least(x: Column, points: int, over: Callable[[Column], Column], value: Column) -> Column:
    """A value, or NULL where the window has fewer values than ``points``."""
    return F.when(over(F.count(x)) >= points, value)


def rolling_kurtosis(frame: Frame, name: str, window: int, min_periods: int) -> Column:
    over = lambda c: c.over(frame.rolling(window))
    x = frame.col(name)
    return at_least(x, min_periods, over, stats.kurtosis(x, over))


class _WindowStatistics(Step):
    DEFAULT: Sequence[str] = ()

    def __init__(self, min_points: int = 2, to_compute: Sequence[str] | None = None, specific: dict[str, Sequence[str]] | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        if to_compute is not None and specific is not None:
            raise ValueError("give to_compute or specific, not both")
        unknown = [s for s in [*(to_compute or ()), *(s for v in (specific or {}).values() for s in v)] if s not in stats.WINDOWED]
        if unknown:
            raise ValueError(f"unknown statistics: {unknown}")
        self.min_points, self.to_compute, self.specific = min_points, to_compute, specific

    def _window(self, frame: Frame) -> Window:
        raise NotImplementedError

    def apply(self, frame: Frame) -> Frame:
        window = self._window(frame)
        over = lambda c: c.over(window)
        chosen = self.specific or {n: self.to_compute or self.DEFAULT for n in frame.numeric}
        out = {}
        for name, wanted in chosen.items():
            x = frame.col(name).cast("double")
            for statistic in wanted:
                out[f"{name}_{statistic}"] = at_least(x, self.min_points, over, stats.WINDOWED[statistic](x, over))
        return frame.compute(out)


class RollingStatistics(_WindowStatistics):
    """Statistics of the last ``window`` rows; columns ``{feature}_{statistic}``."""

    DEFAULT = tuple(stats.WINDOWED)

    def __init__(self, window: int = 15, min_points: int = 2, to_compute: Sequence[str] | None = None, specific: dict[str, Sequence[str]] | None = None, *, name: str | None = None) -> None:
        super().__init__(min_points, to_compute, specific, name=name)
        self.window = window

    def _window(self, frame: Frame) -> Window:
        return frame.rolling(self.window)


class ExpandingStatistics(_WindowStatistics):
    """Statistics of all rows so far; a running aggregate, linear in the rows."""

    DEFAULT = tuple(s for s in stats.WINDOWED if s not in ("energy", "deviance"))

    def _window(self, frame: Frame) -> Window:
        return frame.expanding


class LifeStatistics(Step):
    """One row per cycle: statistics of each numeric feature."""

    def __init__(self, to_compute: Sequence[str] | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.to_compute = list(to_compute or stats.OF_LIFE)

    def apply(self, frame: Frame) -> Frame:
        columns = {f"{n}_{s}": stats.OF_LIFE[s](frame.col(n).cast("double")) for n in frame.numeric for s in self.to_compute}
        df = frame.per_cycle(columns).withColumn(frame.pos, F.lit(0).cast("long"))
        return Frame(Rows(df, frame.cycle, frame.pos), {n: n for n in columns})


class MeanFilter(Step):
    def __init__(self, window: int, center: bool = True, min_periods: int = 15, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window, self.center, self.min_periods = window, center, min_periods

    def apply(self, frame: Frame) -> Frame:
        w = frame.rolling(self.window, self.center)
        return frame.each(lambda x: at_least(x, self.min_periods, lambda c: c.over(w), F.avg(x).over(w)))


class MedianFilter(Step):
    def __init__(self, window: int, min_periods: int = 15, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window, self.min_periods = window, min_periods

    def apply(self, frame: Frame) -> Frame:
        w = frame.rolling(self.window)
        return frame.each(lambda x: at_least(x, self.min_periods, lambda c: c.over(w), F.percentile(x, F.lit(0.5)).over(w)))


def _gaussian(x: Column, frame: Frame, size: int, std: float, points: int, center: bool) -> Column:
    """The weighted mean of a window; NULLs weigh nothing. Each row's offset in the window has its weight."""
    after = (size - 1) // 2 if center else 0
    weight = [math.exp(-0.5 * ((i - (size - 1) / 2) / std) ** 2) for i in range(size)]
    top, bottom, count = F.lit(0.0), F.lit(0.0), F.lit(0)
    for i, w in enumerate(weight):
        offset = i - (size - 1) + after
        value = x if offset == 0 else F.lag(x, -offset).over(frame.ordered) if offset < 0 else F.lead(x, offset).over(frame.ordered)
        top += F.coalesce(value * w, F.lit(0.0))
        bottom += F.when(value.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
        count += value.isNotNull().cast("int")
    return F.when((count >= points) & (bottom != 0), top / bottom)


class GaussianFilter(Step):
    """Rolling mean with gaussian weights around the window's middle."""

    def __init__(self, window_size: int, std: float, min_points: int = 1, center: bool = False, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window_size, self.std, self.min_points, self.center = window_size, std, min_points, center

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: _gaussian(x.cast("double"), frame, self.window_size, self.std, self.min_points, self.center))


class DoG(Step):
    """The difference of two gaussian filters."""

    def __init__(self, window_size: int, std: Sequence[float], min_points: int = 1, center: bool = False, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window_size, self.std, self.min_points, self.center = window_size, tuple(std), min_points, center

    def apply(self, frame: Frame) -> Frame:
        one = lambda x, s: _gaussian(x.cast("double"), frame, self.window_size, s, self.min_points, self.center)
        return frame.each(lambda x: one(x, self.std[0]) - one(x, self.std[1]))


class EWMAFilter(Step):
    """Exponentially weighted mean by span, adjusted, with NULLs left out of the decay, as window sums.

    With r = 1 - 2 / (span + 1) and k the number of values before, the mean is the sum of x r^(k - k_i)
    over that of r^(k - k_i). The sum runs over r^-k_i within blocks of values short enough for that to
    stay in range; of what comes before a block only the block before counts: r^(a block) is below 1e-130.
    """

    def __init__(self, span: float, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.span = span

    def apply(self, frame: Frame) -> Frame:
        r, rows = 1 - 2 / (self.span + 1), frame.rows
        if r <= 0:
            return frame.each(lambda x: F.last(x.cast("double"), ignorenulls=True).over(frame.expanding))
        size = max(1, int(-300 / math.log(r)))
        out = {}
        for name in frame.numeric:
            x = frame.col(name).cast("double")
            k = F.col(rows.add({"k": F.count(x).over(frame.expanding) - 1})["k"])
            held = rows.add({"block": F.floor(k / size).cast("long"), "place": F.pmod(k, F.lit(size)).cast("double")})
            block, place = F.col(held["block"]), F.col(held["place"])
            within = Window.partitionBy(*rows.by, block).orderBy(frame.pos).rowsBetween(Window.unboundedPreceding, 0)
            own = F.col(rows.add({"own": F.sum(x * F.pow(F.lit(1 / r), place)).over(within) * F.pow(F.lit(r), place)})["own"])
            before = F.col(rows.add({"before": F.lag(own).over(frame.ordered)})["before"])
            carried = F.coalesce(F.first(before).over(within), F.lit(0.0)) * F.pow(F.lit(r), place + 1)
            out[name] = F.when(k >= 0, (own + carried) * (1 - r) / (1 - F.pow(F.lit(r), k + 1)))
        new = rows.add(out)
        return Frame(rows, {n: new.get(n, h) for n, h in frame.held.items()})


class ExpandingCentering(Step):
    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: x - F.avg(x).over(frame.expanding))


class RollingCentering(Step):
    def __init__(self, window: int, min_points: int = 1, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window, self.min_points = window, min_points

    def apply(self, frame: Frame) -> Frame:
        w = frame.rolling(self.window)
        return frame.each(lambda x: x - at_least(x, self.min_points, lambda c: c.over(w), F.avg(x).over(w)))


class ExpandingNormalization(Step):
    """(x - mean) / std of all rows so far; NULL where there is no spread."""

    def apply(self, frame: Frame) -> Frame:
        w = frame.expanding
        return frame.each(lambda x: stats.deviance(x, lambda c: c.over(w)))


class Accumulate(Step):
    """Running sum; normalised, over the root of its size."""

    def __init__(self, normalize: bool = False, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.normalize = normalize

    def apply(self, frame: Frame) -> Frame:
        def one(x: Column) -> Column:
            # NULL stays NULL in its own row, and adds nothing.
            total = F.when(x.isNotNull(), F.sum(x).over(frame.expanding))
            return stats.ratio(total, F.sqrt(F.abs(total))) if self.normalize else total

        return frame.each(one)


class Diff(Step):
    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: x - F.lag(x).over(frame.ordered))


class ChangesDetector(Step):
    """Whether a value differs from the one before; true in the first row and next to NULL."""

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: F.coalesce(x != F.lag(x).over(frame.ordered), F.lit(True)), frame.columns)


class SampleNumber(Step):
    def apply(self, frame: Frame) -> Frame:
        return frame.compute({"sample_number": F.row_number().over(frame.ordered).cast("long") - 1})


class TimeToPreviousBinaryValue(Step):
    """Rows since the last 1; NULL before the first. Columns ``ttp_{feature}``."""

    def apply(self, frame: Frame) -> Frame:
        pos = F.col(frame.pos)
        return frame.compute({f"ttp_{n}": pos - F.last(F.when(frame.col(n) == 1, pos), ignorenulls=True).over(frame.expanding) for n in frame.columns})


class SubstractLinebase(Step):
    """Difference from the cycle's first row."""

    def apply(self, frame: Frame) -> Frame:
        return frame.each(lambda x: x - F.first(x).over(frame.expanding))


class LocalEntropyMeasures(Step):
    """Local entropies of a discrete series with a history of ``window`` values.

    ``local_active_information`` = log2 p(x | history) / p(x), ``local_block_entropy`` = -log2 p(block),
    ``local_entropy_rate`` = -log2 p(x | history), with frequencies of the cycle. The first rows,
    which lack a history (or a whole block), are NULL. All counts are window aggregates.
    """

    MEASURES = ("local_active_information", "local_block_entropy", "local_entropy_rate")

    def __init__(self, window: int = 2, to_compute: Sequence[str] | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window, self.to_compute = window, list(to_compute or self.MEASURES)

    def apply(self, frame: Frame) -> Frame:
        out = {}
        for name in frame.columns:
            x, k = frame.col(name), self.window
            lags = [F.lag(x, i).over(frame.ordered) for i in range(k, 0, -1)]
            keys = frame.rows.add(
                {
                    "history": F.when(F.col(frame.pos) >= k, F.concat_ws("|", *lags)),
                    "block": F.when(F.col(frame.pos) >= k - 1, F.concat_ws("|", *lags[1:], x)),
                    "value": x.cast("string"),
                }
            )
            history, block, value = (F.col(keys[n]) for n in ("history", "block", "value"))
            whole = frame.rows.by
            with_history = F.when(history.isNotNull(), F.lit(1))
            of = lambda *by: F.count(with_history).over(Window.partitionBy(*whole, *by)).cast("double")
            n, n_history, n_value, n_both = of(), of(history), of(value), of(history, value)
            share = n_both / n_history
            blocks = F.count(block).over(Window.partitionBy(*whole)).cast("double")
            measures = {
                "local_active_information": F.when(history.isNotNull(), F.log2(share / (n_value / n))),
                "local_block_entropy": F.when(block.isNotNull(), -F.log2(F.count(block).over(Window.partitionBy(*whole, block)) / blocks)),
                "local_entropy_rate": F.when(history.isNotNull(), -F.log2(share)),
            }
            out |= {f"{name}_{m}": measures[m] for m in self.to_compute}
        return frame.compute(out)


def apply_rolling_data(frame: Frame, function: Callable[[Column], Column], window: int, names: Sequence[str] | None = None, step: int | None = None) -> Frame:
    """An aggregate of windows of rows that begin every ``step`` rows (by default every ``window`` rows).

    Windows that follow each other leave a last one that may be short. Others are the whole windows of
    a cycle, and one more of the rows beyond ``window`` times their number, where there are any; a
    cycle shorter than a window is one short window. Rows are copied into their windows, no more often
    than a row has windows, and meet by cycle, as they are already dealt.
    """
    names = list(names or frame.numeric)
    step = step or window
    if step == window:
        place, df = F.floor(F.col(frame.pos) / window).cast("long"), frame.rows.df
    else:
        held = frame.rows.add({"n": F.count(F.lit(1)).over(frame.whole), "at": F.row_number().over(frame.ordered).cast("long") - 1})
        n, at = F.col(held["n"]), F.col(held["at"])
        whole = F.greatest(F.floor((n - window) / step) + 1, F.lit(0)).cast("long")
        first = F.greatest(F.ceil((at - window + 1) / step), F.lit(0)).cast("long")
        last = F.least(F.floor(at / step).cast("long"), whole - 1)
        none = F.array().cast("array<bigint>")
        own = F.concat(F.when(first <= last, F.sequence(first, last)).otherwise(none), F.when(at >= whole * window, F.array(whole)).otherwise(none))
        df, place = frame.rows.df.withColumn("_window", F.explode(own)), F.col("_window")
    df = df.groupBy(*frame.rows.by, place.alias(frame.pos)).agg(*(function(frame.col(n)).alias(n) for n in names))
    return Frame(Rows(df, frame.cycle, frame.pos, frame.rows.unit), {n: n for n in names})
