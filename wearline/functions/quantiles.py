"""Exact quantiles of columns of any size.

An exact percentile aggregate holds every distinct value in one buffer. Beyond ``MOST`` values a
quantile is instead bracketed: an approximate percentile sketch of bounded size names two values
around the wanted rank, one aggregation counts what lies below and between them, and the search goes
on between; each pass leaves a few thousandths. When few values are left, they are put in order and
the wanted ranks are read. Results are the same at every size.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that are put in order in one place.
MOST = 100_000
#: Accuracy of the sketch: ranks are right to one part in so many.
ACCURACY = 2_000


class Quantile(NamedTuple):
    """A quantile that is to be found: with linear interpolation, NULLs left out."""

    x: Column
    q: float

    @property
    def column(self) -> Column:
        """As an aggregate, for groups that are not large."""
        return F.percentile(self.x, F.lit(self.q))


def exact(df: DataFrame, wanted: dict[str, Quantile], most: int = MOST) -> dict[str, float | None]:
    names = list(wanted)
    if not names:
        return {}
    counts = df.agg(*(F.count(wanted[n].x).alias(f"_{i}") for i, n in enumerate(names))).first()
    sizes = {n: counts[i] for i, n in enumerate(names)}
    small = [n for n in names if sizes[n] <= most]
    out: dict[str, float | None] = {}
    if small:
        row = df.agg(*(wanted[n].column.alias(f"_{i}") for i, n in enumerate(small))).first()
        out = {n: row[i] for i, n in enumerate(small)}
    for n in names:
        if n not in out:
            out[n] = _search(df.select(wanted[n].x.cast("double").alias("x")).filter("x IS NOT NULL"), sizes[n], wanted[n].q, most)
    return out


def _search(values: DataFrame, size: int, q: float, most: int) -> float:
    place = q * (size - 1)
    ranks = (math.floor(place), math.ceil(place))
    below, inside, x = 0, size, F.col("x")
    current, reach = values, 1.5 / ACCURACY
    while inside > most:
        share = [(r - below) / max(1, inside - 1) for r in ranks]
        sides = [max(0.0, share[0] - reach), min(1.0, share[1] + reach)]
        low, high = current.agg(F.percentile_approx("x", F.array(*map(F.lit, sides)), F.lit(ACCURACY)).alias("p")).first()["p"]
        # The ends of a range are its extremes, which a sketch need not hold.
        before = x < low if sides[0] > 0 else F.lit(False)
        after = x > high if sides[1] < 1 else F.lit(False)
        row = current.agg(F.sum(before.cast("long")), F.sum((~before & ~after).cast("long"))).first()
        if not below + row[0] <= ranks[0] or not ranks[1] < below + row[0] + row[1]:
            reach *= 4
            continue
        if low == high and sides[0] > 0 and sides[1] < 1:
            return low
        if row[1] == inside:
            reach /= 2
            if reach < 1e-9:
                break
            continue
        below, inside = below + row[0], row[1]
        current = current.filter(~before & ~after)
    found = current.agg(F.array_sort(F.collect_list("x")).alias("v")).first()["v"]
    a, b = found[ranks[0] - below], found[ranks[1] - below]
    return a + (b - a) * (place - ranks[0])
