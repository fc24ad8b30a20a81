"""Evaluation of predictions: lives, maintenance measures, regression metrics, errors by RUL.

Predictions are a table (model, fold, idx, y_true, y_pred); idx orders the rows of a fold, in which
lives follow each other. A life begins where the true RUL rises.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.frame import Rows, by_group
from wearline.functions import ragged
from wearline.functions.kernels import PiecewiseLinearRegression, root_of
from wearline.functions.stats import ratio

FOLD = ("model", "fold")
LIFE = (*FOLD, "life")


def sample_weight(y_true: Column, y_pred: Column, c: float = 0.9) -> Column:
    """The error's size relative to the RUL, from ``c`` up."""
    return F.abs(y_true - y_pred) / F.greatest(y_true, F.lit(c))


def rul_line(rul: float, n: int, step: Column) -> Column:
    """A RUL that decreases by steps (an expression over an ordered window is the caller's), not below 0."""
    return F.greatest(F.lit(rul) + step, F.lit(0.0))


def split_lives(predictions: DataFrame) -> DataFrame:
    """Add life (its number in the fold) and pos; lives of one row, and those with a missing prediction, go."""
    order = Window.partitionBy(*FOLD).orderBy("idx")
    rose = F.coalesce((F.col("y_true") > F.lag("y_true").over(order)).cast("long"), F.lit(0).cast("long"))
    numbered = predictions.withColumn("_rose", rose).withColumn("life", F.sum("_rose").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_rose")
    whole = Window.partitionBy(*LIFE)
    bad = F.max((F.col("y_pred").isNull() | F.isnan("y_pred")).cast("int")).over(whole)
    numbered = numbered.withColumns({"pos": F.row_number().over(whole.orderBy("idx")).cast("long") - 1, "n": F.count("*").over(whole), "_bad": bad})
    return numbered.filter("n > 1 AND _bad = 0").drop("_bad")


def with_time(lives: DataFrame, rul_threshold: float | None = None) -> DataFrame:
    """Add start (the row where degradation begins) and time.

    Degradation begins below the threshold, or after the first rows that do not change. Time sums the
    decrements of the RUL, the last ones first; rows before the start take the median step.
    """
    # The k-th step from the start is the k-th decrement from the end, so their sum is read at the mirrored
    # row. All of it is one kernel over lives as split_lives leaves them: in order, without another sort.
    rows = _Lives(lives.drop("start", "time"), "life", "idx" if "idx" in lives.columns else "pos")
    held = rows.kernel({"y": "y_true"}, {"start": "long", "time": "double"}, lambda part, starts: _timed(part["y"].to_numpy(dtype=float), starts, rul_threshold), together=True)
    return rows.df.withColumnsRenamed({h: n for n, h in held.items()})


class _Lives(Rows):
    by = list(LIFE)


def _timed(y: np.ndarray, starts: np.ndarray, rul_threshold: float | None) -> dict[str, np.ndarray]:
    """Start and time of the rows of whole lives; NaN is a missing RUL."""
    sizes = ragged.sizes_of(starts, len(y))
    life, last = np.repeat(np.arange(len(starts)), sizes), starts + sizes - 1
    pos = np.arange(len(y)) - starts[life]
    if rul_threshold is not None:
        begins, otherwise = y < rul_threshold, np.zeros(len(starts), dtype=np.int64)
    else:
        following = np.append(y[1:], np.nan)
        following[last] = np.nan
        begins, otherwise = (following != y) & ~np.isnan(following) & ~np.isnan(y), sizes - 1
    least = np.minimum.reduceat(np.where(begins, pos, len(y)), starts)
    start = np.where(least < len(y), least, otherwise)
    median = np.zeros(len(starts))
    for i in np.flatnonzero(start > 0):
        steps = -np.diff(y[starts[i] + start[i] : last[i] + 1])
        steps = steps[~np.isnan(steps)]
        median[i] = np.median(steps) if len(steps) else 1.0
    own = start[life]
    mirror = np.where(pos > own, starts[life] + sizes[life] - 1 + own - pos, last[life])
    late = np.where(pos > own, y[mirror] - y[last[life]], 0.0)
    return {"start": own, "time": np.where(own > 0, median[life] * (np.minimum(pos, own) + 1), 0.0) + late}


def fitted_lives(timed: DataFrame) -> DataFrame:
    """One row per life: errors, line fits, and true and predicted ends of life."""
    e = F.col("y_true") - F.col("y_pred")
    t = F.col("time")
    whole = Window.partitionBy(*LIFE)
    # What is sorted has no more columns than are read.
    timed = timed.select(*LIFE, "pos", "start", "time", "y_true", "y_pred")
    line = timed.withColumns({"_slope": F.regr_slope("y_pred", t).over(whole), "_intercept": F.regr_intercept("y_pred", t).over(whole)})
    lines = line.groupBy(*LIFE).agg(
        F.first("_slope").alias("slope_pred"), F.first("_intercept").alias("intercept_pred"),
        F.avg(F.abs(F.col("y_pred") - F.col("_slope") * t - F.col("_intercept"))).alias("noisiness"),
        F.regr_slope("y_true", t).alias("slope_true"), F.regr_intercept("y_true", t).alias("intercept_true"),
        F.count("*").alias("n_rows"), F.first("start").alias("degrading_start"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.coalesce(F.min(F.when(F.col("y_pred") == 0, F.struct("pos", "time")))["time"], F.max_by(t + F.col("y_pred"), "pos")).alias("predicted_end_of_life"),
        F.coalesce(F.min(F.when(F.col("y_true") == 0, F.struct("pos", "time")))["time"], F.max_by(t + F.col("y_true"), "pos")).alias("end_of_life"),
    )
    angle = F.atan(ratio(F.col("slope_true") - F.col("slope_pred"), 1 + F.col("slope_true") * F.col("slope_pred")))
    return lines.withColumn("slope_resemblance", 1 - F.abs(angle / (math.pi / 2) ** 2))


def lines_of_lives(timed: DataFrame, value: str = "y_pred", not_increasing: bool = True) -> DataFrame:
    """Per life (rows of :func:`with_time`): the line pieces that follow a value over time, and where they reach 0.

    Returns the life's keys, ``pieces`` (t1, y1, t2, y2) and ``root``. A life is fitted point by point by one task.
    """

    def run(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        t, y = part["time"].astype(float).tolist(), part[value].astype(float).tolist()
        corners, roots = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
            line = PiecewiseLinearRegression(not_increasing)
            for i in range(a, b):
                line.add_point(t[i], y[i])
            pieces = line.pieces()
            corners.append([(*begin, *end) for begin, end in pieces])
            roots.append(root_of(pieces))
        keys = {k: part[k].iloc[starts].reset_index(drop=True) for k in LIFE}
        return pd.DataFrame({**keys, **{n: [[c[i] for c in own] for own in corners] for i, n in enumerate(ends)}, "root": roots})

    ends = ("t1", "y1", "t2", "y2")
    kinds = ", ".join(f"{c} {timed.schema[c].dataType.simpleString()}" for c in LIFE)
    source = timed.select(*LIFE, "pos", "time", value).filter(F.col("time").isNotNull() & F.col(value).isNotNull())
    found = by_group(source, LIFE, "pos", run, f"{kinds}, {', '.join(f'{n} array<double>' for n in ends)}, root double", together=True)
    return found.select(*LIFE, F.arrays_zip(*ends).alias("pieces"), "root")


def lives_of(predictions: DataFrame, rul_threshold: float | None = None) -> DataFrame:
    return fitted_lives(with_time(split_lives(predictions), rul_threshold))


# Maintenance measures of a life row ------------------------------------------------------------------


def maintenance_point(m: Column) -> Column:
    return F.col("predicted_end_of_life") - m


def unexploited(m: Column) -> Column:
    """Life left unused when maintenance comes ``m`` before the predicted end."""
    return F.greatest(F.col("end_of_life") - maintenance_point(m), F.lit(0.0))


def broke(m: Column, tolerance: float = 0.0) -> Column:
    """Whether the life ends before its maintenance."""
    return ~(maintenance_point(m) - tolerance < F.col("end_of_life"))


def windows(spark, window_size: float, n: int) -> DataFrame:
    """n maintenance windows from 0 to a size: a small table."""
    step = window_size / max(1, n - 1)
    return spark.range(n).select((F.col("id") * float(step)).alias("window"))


def _sweep(lives: DataFrame, window_size: float, n: int, value: Column, name: str) -> DataFrame:
    # n rows on the other side, whatever the number of lives.
    each = lives.crossJoin(F.broadcast(windows(lives.sparkSession, window_size, n))).withColumn("_v", value)
    return each.groupBy("model", "window").agg(F.avg("_v").alias(f"{name}_mean"), F.stddev_pop("_v").alias(f"{name}_std"))


def unexploited_lifetime(lives: DataFrame, window_size: float, n: int) -> DataFrame:
    """(model, window, mean, std) over all lives of a model."""
    return _sweep(lives, window_size, n, unexploited(F.col("window")), "unexploited")


def unexpected_breaks(lives: DataFrame, window_size: float, n: int) -> DataFrame:
    return _sweep(lives, window_size, n, broke(F.col("window")).cast("double"), "breaks")


def metric_j(lives: DataFrame, window_size: float, n: int, q1: float, q2: float) -> DataFrame:
    """Weighted sum of breaks and unexploited life, each over its fold's greatest, averaged over folds."""
    each = lives.crossJoin(F.broadcast(windows(lives.sparkSession, window_size, n)))
    each = each.withColumns({"_b": broke(F.col("window")).cast("double"), "_u": unexploited(F.col("window"))})
    tiny = 1e-10
    folds = each.groupBy(*FOLD, "window").agg((F.avg("_b") / (F.max("_b") + tiny) * q1 + F.avg("_u") / (F.max("_u") + tiny) * q2).alias("_j"))
    return folds.groupBy("model", "window").agg(F.avg("_j").alias("j"))


def j_cost(lives: DataFrame, window_size: float, n: int, ratios: Sequence[float]) -> DataFrame:
    """For each cost ratio: mean over the windows of breaks plus ratio times unexploited life, with its propagated error."""
    both = unexpected_breaks(lives, window_size, n).join(unexploited_lifetime(lives, window_size, n), ["model", "window"])
    kinds = F.explode(F.array(*(F.lit(float(r)) for r in ratios)))
    each = both.withColumn("ratio", kinds)
    cost = F.col("breaks_mean") + F.col("ratio") * F.col("unexploited_mean")
    error = F.sqrt(F.col("breaks_std") ** 2 + (F.col("ratio") * F.col("unexploited_std")) ** 2)
    return each.groupBy("model", "ratio").agg(F.avg(cost).alias("cost"), (F.sqrt(F.sum(error * error)) / F.count("*")).alias("cost_std"))


# Regression metrics ----------------------------------------------------------------------------------


def regression_metrics(predictions: DataFrame, threshold: float = float("inf"), digits: int | None = 2) -> DataFrame:
    """Per model: mean and std over folds of MAE, weighted MAE, MSE, weighted MSE and MAPE.

    Rows above the threshold and missing predictions are left out, and so are folds with one constant prediction.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    rows = predictions.filter((y <= threshold) & p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf")))
    e, w = y - p, sample_weight(y, p)
    folds = rows.groupBy(*FOLD).agg(
        F.avg(F.abs(e)).alias("mae"), ratio(F.sum(w * F.abs(e)), F.sum(w)).alias("mae_sw"), F.avg(e * e).alias("mse"),
        ratio(F.sum(w * e * e), F.sum(w)).alias("mse_sw"), F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))).alias("mape"),
        (F.max(p) > F.min(p)).alias("_varies"),
    )
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    names = ("mae", "mae_sw", "mse", "mse_sw", "mape")
    return folds.filter("_varies").groupBy("model").agg(*(cut(f(n)).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))))


def errors_by_rul(predictions: DataFrame, nbins: int, greatest: float | None = None) -> DataFrame:
    """(model, fold, bin, mean_error, mae, mse): errors in equal bins of the true RUL from 0 to its greatest.

    Both ends of a bin belong to it, so a value on an inner edge counts in two; empty bins give 0.
    """
    spark = predictions.sparkSession
    if greatest is None:
        greatest = predictions.agg(F.max("y_true")).first()[0]
    edges = [greatest * i / nbins for i in range(nbins + 1)]
    bins = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(nbins)], "bin int, low double, high double")
    y, e = F.col("y_true"), F.col("y_true") - F.col("y_pred")
    # Each row names its one or two bins, so no range join is needed.
    own = F.filter(F.array(*(F.when((y >= edges[i]) & (y <= edges[i + 1]), F.lit(i)) for i in range(nbins))), lambda b: b.isNotNull())
    found = predictions.withColumn("bin", F.explode(own)).groupBy(*FOLD, "bin").agg(F.avg(e).alias("mean_error"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    grid = predictions.select(*FOLD).distinct().crossJoin(F.broadcast(bins))
    joined = grid.join(found, [*FOLD, "bin"], "left")
    return joined.fillna(0.0, ["mean_error", "mae", "mse"])


# Losses, as aggregates -------------------------------------------------------------------------------


def root_mean_squared_error(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def relative_mae(y: Column, p: Column, c: float = 0.9) -> Column:
    return F.avg(sample_weight(y, p, c) * F.abs(y - p))


def relative_mse(y: Column, p: Column, c: float = 0.9) -> Column:
    return F.avg(sample_weight(y, p, c) * (y - p) * (y - p))


def asymmetric_loss(y: Column, p: Column, over: tuple[float, float, float], under: tuple[float, float, float], relative: bool = True) -> Column:
    """Quadratic near 0 and exponential beyond; (theta, alpha, gamma) for over- and for underprediction."""
    e = y - p

    def side(size: Column, theta: float, alpha: float, gamma: float) -> Column:
        return F.when(size > theta, alpha * theta * (theta + 2 * gamma * (F.exp((size - theta) / gamma) - 1))).otherwise(alpha * size * size)

    loss = F.when(e < 0, side(-e, *over)).when(e > 0, side(e, *under)).otherwise(F.lit(0.0))
    return F.avg(sample_weight(y, p) * loss) if relative else F.avg(loss)


# Weibull ---------------------------------------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8; right to about 1e-12 for positive numbers."""
    shift = F.lit(0.0)
    for i in range(8):
        shift += F.ln(x + i)
    z = x + 8
    inverse = 1 / (z * z)
    series = (1 / z) * (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680)))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def weibull(scale: Column, shape: Column, q: float = 0.5) -> dict[str, Column]:
    """Mean, mode, median, variance and a quantile of Weibull distributions."""
    gamma = lambda k: F.exp(log_gamma(1 + k / shape))
    return {
        "mean": scale * gamma(1.0),
        "mode": F.when(shape > 1, scale * F.pow((shape - 1) / shape, 1 / shape)).otherwise(F.lit(0.0)),
        "median": scale * F.pow(F.lit(math.log(2)), 1 / shape),
        "variance": scale * scale * (gamma(2.0) - gamma(1.0) * gamma(1.0)),
        "quantile": scale * F.pow(F.lit(-math.log(1 - q)), 1 / shape),
    }


#: Euler's constant, as the divergence has it.
EULER = 0.5772


def weibull_divergence(scale: Column, shape: Column, other_scale: Column, other_shape: Column) -> Column:
    """Kullback-Leibler divergence of a Weibull distribution from another."""
    densities = F.log(shape / F.pow(scale, shape)) - F.log(other_shape / F.pow(other_scale, other_shape))
    means = (shape - other_shape) * (F.log(scale) - EULER / shape)
    return densities + means + F.pow(scale / other_scale, other_shape) * F.exp(log_gamma(other_shape / shape + 1)) - 1


def weibull_log_likelihood(y: Column, scale: Column, shape: Column) -> Column:
    z = F.greatest(y, F.lit(1e-12)) / scale
    return F.ln(shape / scale) + (shape - 1) * F.ln(z) - F.pow(z, shape)
