"""Baselines, and windows as input of Spark's own regressors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.frame import CycleSet
from wearline.functions.quantiles import Quantile, exact
from wearline.plans.graph import Transformer
from wearline.plans.samples import Batcher, WindowedDatasetIterator
from wearline.results import LIFE, with_time


def _timed(cycles: CycleSet, rul_threshold: float | None) -> DataFrame:
    """Cycles as lives of one fold, with their time."""
    n = F.count("*").over(Window.partitionBy(cycles.cycle))
    rows = cycles.df.select(
        F.lit("").alias(LIFE[0]), F.lit(0).alias(LIFE[1]), F.col(cycles.cycle).alias("life"), "pos", n.alias("n"), F.col(cycles.rul).cast("double").alias("y_true")
    )
    return with_time(rows, rul_threshold)


class FixedValueBaselineModel:
    """Every cycle lasts the same: the value less the time so far, from 0 to the value."""

    def __init__(self, value: float | None = None) -> None:
        self.value = value

    def fit(self, cycles: CycleSet) -> FixedValueBaselineModel:
        return self

    def predict(self, cycles: CycleSet, rul_threshold: float | None = None) -> DataFrame:
        """(cycle, pos, y_true, y_pred)."""
        value = F.lit(float(self.value))
        left = F.least(F.greatest(value - F.col("time"), F.lit(0.0)), value)
        return _timed(cycles, rul_threshold).select(F.col("life").alias(cycles.cycle), "pos", "y_true", left.alias("y_pred"))


class BaselineModel(FixedValueBaselineModel):
    """The same with the mean or median duration of cycles."""

    def __init__(self, mode: str = "mean", RUL_threshold: float | None = None) -> None:
        super().__init__()
        if mode not in ("mean", "median"):
            raise ValueError(f"unknown mode {mode}")
        self.mode, self.threshold = mode, RUL_threshold

    def fit(self, cycles: CycleSet) -> BaselineModel:
        timed = _timed(cycles, self.threshold)
        first = timed.groupBy("life").agg((F.min_by("y_true", "pos") + F.max(F.when(F.col("pos") == F.col("start"), F.col("time")))).alias("d"))
        self.value = first.agg(F.avg("d")).first()[0] if self.mode == "mean" else exact(first, {"d": Quantile(F.col("d"), 0.5)})["d"]
        return self

    def predict(self, cycles: CycleSet, rul_threshold: float | None = None) -> DataFrame:
        return super().predict(cycles, self.threshold if rul_threshold is None else rul_threshold)


def training_rows(samples: WindowedDatasetIterator) -> DataFrame:
    """Samples as (cycle, pos, features, label, weight) for ``pyspark.ml``; the order does not matter there."""
    x = F.transform(F.flatten("X"), lambda v: v.cast("double"))
    return samples.samples().select(samples.x.cycle, samples.x.pos, array_to_vector(x).alias("features"), F.col("y")[0].cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))


def train_model(estimator: Estimator, samples: WindowedDatasetIterator) -> Model:
    """Fit a ``pyspark.ml`` regressor on windows; weights are used if it takes them."""
    if estimator.hasParam("weightCol"):
        estimator = estimator.copy({estimator.getParam("weightCol"): "weight"})
    return estimator.fit(training_rows(samples))


def predict(model: Model, samples: WindowedDatasetIterator) -> DataFrame:
    """(cycle, pos, y_true, y_pred)."""
    return model.transform(training_rows(samples)).select(samples.x.cycle, samples.x.pos, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def _table(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


def fit_batch(model: Any, train: Batcher, validation: WindowedDatasetIterator | None = None, n_epochs: int = 15) -> tuple[Any, list[float]]:
    """Fit an object with ``partial_fit(X, y)`` on every batch, epoch by epoch, and its mean squared error on the validation samples after each.

    A row of X is a window, row by row. The samples are cut and sorted once and kept by the executors (what
    is lost with one is made again). The batches come to the driver one partition at a time, so sets of
    any size go through it; the errors are taken where the samples are.
    """
    history = []
    ordered = train.iterator.ordered().persist()
    held = None if validation is None else _windows(validation).persist()
    try:
        for _ in range(n_epochs):
            for x, y, _ in train.of(ordered):
                model.partial_fit(_table(x), y[:, 0] if y.ndim == 2 and y.shape[1] == 1 else y)
            if held is not None:
                error = F.col("y_true") - F.col("y_pred")
                history.append(_scored(model, held).agg(F.avg(error * error)).first()[0])
    finally:
        ordered.unpersist()
        if held is not None:
            held.unpersist()
    return model, history


def _windows(samples: WindowedDatasetIterator) -> DataFrame:
    return samples.samples().select(samples.x.cycle, samples.x.pos, F.col("y")[0].cast("double").alias("y_true"), F.flatten("X").alias("_x"))


def predict_batch(model: Any, samples: WindowedDatasetIterator) -> DataFrame:
    """(cycle, pos, y_true, y_pred) of an object with ``predict(X)``, which goes to the executors and sees Arrow batches of windows."""
    return _scored(model, _windows(samples))


def _scored(model: Any, rows: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                y = np.asarray(model.predict(np.stack(part["_x"].to_list()).astype(np.float32)), dtype=float)
                yield part.drop(columns="_x").assign(y_pred=y.reshape(len(part), -1)[:, 0])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_x").schema)
    return rows.mapInPandas(run, f"{kinds}, y_pred double")


class TimeSeriesWindowTransformer:
    """Cycles into windows: a transformer, and how windows are cut from what it gives."""

    def __init__(self, transformer: Transformer, window_size: int, padding: bool = True, **windows: Any) -> None:
        self.transformer, self.windows = transformer, {"window_size": window_size, "padding": padding, **windows}

    def fit(self, cycles: CycleSet) -> TimeSeriesWindowTransformer:
        self.transformer.fit(cycles)
        return self

    def transform(self, cycles: CycleSet) -> WindowedDatasetIterator:
        data = self.transformer.transform(cycles)
        return WindowedDatasetIterator(data.x, data.y, **self.windows)

    def true_values(self, cycles: CycleSet) -> DataFrame:
        """(cycle, pos, y_true)."""
        samples = self.transform(cycles)
        return samples.samples().select(samples.x.cycle, samples.x.pos, F.col("y")[0].cast("double").alias("y_true"))

    def get_params(self) -> dict:
        return {**self.windows, "transformer": self.transformer.get_params()}


class CycleRegressor:
    """A window transformer and a regressor as one: fitted on cycles, it predicts cycles.

    The regressor is a ``pyspark.ml`` estimator, or an object with ``partial_fit`` and ``predict``
    that learns ``batch_size`` samples at a time.
    """

    def __init__(self, windows: TimeSeriesWindowTransformer, regressor: Any, batch_size: int = 256, n_epochs: int = 1) -> None:
        self.windows, self.regressor, self.batch_size, self.n_epochs = windows, regressor, batch_size, n_epochs
        self.model: Any = None

    def fit(self, cycles: CycleSet) -> CycleRegressor:
        samples = self.windows.fit(cycles).transform(cycles)
        if isinstance(self.regressor, Estimator):
            self.model = train_model(self.regressor, samples)
        else:
            self.model, _ = fit_batch(self.regressor, Batcher(samples, self.batch_size), n_epochs=self.n_epochs)
        return self

    def predict(self, cycles: CycleSet) -> DataFrame:
        """(cycle, pos, y_true, y_pred)."""
        if self.model is None:
            raise ValueError("the regressor is not fitted")
        samples = self.windows.transform(cycles)
        return predict(self.model, samples) if isinstance(self.model, Model) else predict_batch(self.model, samples)

    def score(self, cycles: CycleSet, metric: str | Column = "r2") -> float:
        """A metric of ``RegressionEvaluator`` by name, or any aggregate of y_true and y_pred."""
        found = self.predict(cycles)
        if isinstance(metric, Column):
            return found.agg(metric).first()[0]
        return RegressionEvaluator(labelCol="y_true", predictionCol="y_pred", metricName=metric).evaluate(found)


def fold_of(cycle: Column, folds: int, seed: int = 0) -> Column:
    """A fold for whole cycles, by a hash of their id."""
    return F.pmod(F.xxhash64(cycle, F.lit(seed)), F.lit(folds)).cast("int")


def cross_validate(estimator: Estimator, grid: Sequence[dict], samples: WindowedDatasetIterator, folds: int = 3, seed: int = 0, metric: str = "rmse") -> CrossValidatorModel:
    """Grid search in which no cycle is split between folds."""
    rows = training_rows(samples)
    rows = rows.withColumn("fold", fold_of(F.col(samples.x.cycle), folds, seed))
    search = CrossValidator(estimator=estimator, estimatorParamMaps=list(grid), evaluator=RegressionEvaluator(metricName=metric), numFolds=folds, foldCol="fold")
    return search.fit(rows)


#: Samples among which a feature is dealt anew.
BUCKET = 100_000


def permutation_importance(model: Model, samples: WindowedDatasetIterator, feature: str, seed: int = 0) -> DataFrame:
    """The error with one feature's windows dealt anew among samples, less the error as it is.

    Windows of the feature move between samples by a join of two hash orders within buckets of about
    ``BUCKET`` samples, so that no task sorts them all.
    """
    k = samples.x.columns.index(feature)
    base = samples.samples()
    keys = [samples.x.cycle, samples.x.pos]
    bucket = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(max(1, base.count() // BUCKET)))
    place = lambda salt: F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(*keys, F.lit(salt)), *keys))
    own = base.withColumn("_b", bucket)
    left, right = own.withColumn("_r", place(seed + 1)), own.withColumn("_r", place(seed + 2)).select("_b", "_r", F.transform("X", lambda r: r[k]).alias("_x"))
    mixed = left.join(right, ["_b", "_r"])
    cells = F.zip_with("X", "_x", lambda row, v: F.transform(row, lambda c, i: F.when(i == k, v).otherwise(c)))

    def error(rows: DataFrame) -> DataFrame:
        x = F.transform(F.flatten("X"), lambda v: v.cast("double"))
        scored = model.transform(rows.select(array_to_vector(x).alias("features"), F.col("y")[0].cast("double").alias("label")))
        return scored.agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"))

    moved = error(mixed.withColumn("X", cells)).select(F.col("mae").alias("moved"))
    return moved.crossJoin(F.broadcast(error(base))).select(F.lit(feature).alias("feature"), (F.col("moved") - F.col("mae")).alias("importance"))
