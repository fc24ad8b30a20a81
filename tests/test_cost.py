"""What keeps queries' cost in proportion to their input: plans and kernels of many small cycles at once."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline import analysis, results
from wearline.frame import CycleSet, by_group
from wearline.functions import kernels, ragged
from wearline.queries.common import cycles, rounded, sensors
from wearline.queries.evaluation import predictions


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bins", [5, 70])
def test_pairs_of_histograms_are_plain_sums(spark, bins):
    random = np.random.RandomState(0)
    rows = [(c, p, float(v)) for c in range(40) for p, v in enumerate(random.standard_normal(20 + c))]
    own = CycleSet(spark.createDataFrame(rows, "cycle_id long, pos long, v double"), features=["v"], rul="v")
    result = analysis.features_divergences(own, bins, ["v"])
    if bins <= analysis.MAX_TERMS:
        # Nothing is interpreted for each pair: functions of arrays belong below the join.
        above = plan(result).split("Join")[0]
        assert "lambdafunction" not in above and "zip_with" not in above
    found = {(r["cycle_1"], r["cycle_2"]): r for r in result.collect()}
    values = {c: np.array([r[2] for r in rows if r[0] == c]) for c in range(40)}
    edges = np.linspace(min(v.min() for v in values.values()), max(v.max() for v in values.values()), bins + 1)
    h = {c: np.histogram(v, edges)[0] / len(v) + 1e-50 for c, v in values.items()}
    assert set(found) == set(itertools.combinations(range(40), 2))
    for (a, b), row in found.items():
        kl = (np.mean(h[a] * np.log(h[a] / h[b]) - h[a] + h[b]) + np.mean(h[b] * np.log(h[b] / h[a]) - h[b] + h[a])) / 2
        assert np.isclose(row["kl"], kl) and np.isclose(row["wasserstein"], np.abs(np.sort(h[a]) - np.sort(h[b])).mean())
        assert (row["cycle_1_length"], row["cycle_2_length"], row["abs_length_difference"]) == (20 + a, 20 + b, b - a)


def test_rounding_of_any_size(spark):
    values = [0.1234565, -0.1234565, 2.5e-7, -2.5e-7, 0.0, 12345.6789012345, 1e12 + 0.3, -7e300, 1e308, float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in rounded(df).collect()]
    by_text = [r[0] for r in df.select(F.round(F.col("v") + 1.3e-8, 6) + 0.0).collect()]
    assert found == by_text
    assert rounded(spark.createDataFrame([(float("nan"),)], "v double")).first()[0] != 0


def series(seed: int = 0, most: int = 60, many: int = 150) -> list[np.ndarray]:
    """Series of lengths 1 and up: noise, waves, ties, levels."""
    random = np.random.RandomState(seed)
    kinds = (lambda n: random.standard_normal(n), lambda n: np.sin(np.arange(n)) + 0.3 * random.standard_normal(n), lambda n: random.randint(0, 4, n).astype(float), lambda n: np.ones(n))
    return [kinds[i % 4](1 + random.randint(most)) for i in range(many)]


def flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    return np.concatenate(parts), ragged.starts_of(sizes), sizes


def test_modes_of_many_series_are_those_of_each():
    parts = [*series(), np.random.RandomState(1).standard_normal(ragged.MAX_TOGETHER + 9), np.array([1.0, np.nan, 2.0])]
    x, starts, sizes = flat(parts)
    found = ragged.sift(x, starts, 3)
    for part, a, n in zip(parts, starts, sizes, strict=True):
        expected = np.full((n, 3), np.nan)
        if np.isfinite(part).all():
            modes = kernels.sift(part, 3)
            expected[:, : modes.shape[1]] = modes
        assert np.allclose(found[a : a + n], expected, equal_nan=True)


@pytest.mark.parametrize("distance", [1, 3, 7])
def test_peaks_of_many_series_are_those_of_each(distance):
    parts = series(3)
    x, starts, _ = flat(parts)
    assert ragged.find_peaks(x, starts, distance).tolist() == [int(a + p) for part, a in zip(parts, starts, strict=True) for p in kernels.find_peaks(part, distance)]


def test_complexity_of_many_series_is_that_of_each():
    parts = series(5)
    x, _, sizes = flat(parts)
    y = np.random.RandomState(7).standard_normal(len(x))
    entropies, shared = ragged.approximate_entropy(x, sizes), ragged.mutual_information(x, y, sizes)
    for i, (part, a) in enumerate(zip(parts, ragged.starts_of(sizes), strict=True)):
        assert np.isclose(entropies[i], kernels.approximate_entropy(part), equal_nan=True)
        assert np.isclose(shared[i], kernels.mutual_information(part, y[a : a + len(part)]))


def test_spectra_hurst_and_wavelets_of_a_matrix_are_those_of_its_rows():
    x = np.random.RandomState(2).standard_normal((6, 40))
    for i, row in enumerate(x):
        assert np.allclose(np.stack(kernels.frequency_features(x), axis=-1)[i], kernels.frequency_features(row))
        assert all(np.isclose(f(x, 4, 16, 3)[i], f(row, 4, 16, 3)) for f in kernels.HURST.values())
        for many, one in zip(kernels.wavelet_decompose(x, "db2", 2), kernels.wavelet_decompose(row, "db2", 2), strict=True):
            assert np.allclose(many[i], one)


def test_kernels_get_many_cycles_at_a_time(spark, sf):
    """A call of a function for each cycle was what short cycles cost."""
    calls = spark.sparkContext.accumulator(0)
    frame = sensors(spark, sf)

    def run(part, starts):
        calls.add(1)
        return {"n": np.repeat(ragged.sizes_of(starts, len(part)), ragged.sizes_of(starts, len(part)))}

    rows = frame.kernel({"n": "long"}, run, together=True).df
    assert rows.count() == frame.df.count()
    expected = frame.df.groupBy("cycle_id").count()
    found = rows.groupBy("cycle_id").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c"))
    assert found.filter("a <> b OR a <> c").count() == 0
    before = calls.value
    rows.write.format("noop").mode("overwrite").save()
    assert calls.value - before <= 16 < expected.count()


def test_groups_together_are_whole(spark):
    """Groups of many sizes, also longer than an Arrow batch."""
    sizes = {i: 1 + (i * 37) % 90 for i in range(60)} | {100: 500}
    df = spark.createDataFrame([(g, p) for g, n in sizes.items() for p in range(n)], "g long, pos long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        run = lambda part, starts: pd.DataFrame({"g": part["g"].iloc[starts].to_numpy(), "n": ragged.sizes_of(starts, len(part))})
        assert {r[0]: r[1] for r in by_group(df, ["g"], "pos", run, "g long, n long", together=True).collect()} == sizes
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_long_segment_costs_a_point_the_same():
    """The residuals' mean and spread were taken anew at every point."""
    line = kernels.PiecewiseLinearRegression()
    for t in range(150_000):
        line.add_point(float(t), 5.0 - 2.0 * t)
    assert len(line.pieces()) == 1 and np.isclose(line.finish().root(), 2.5)
    assert not hasattr(line, "residuals")


def sorts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_lives_are_sorted_once_and_never_gathered(spark, sf):
    """A task held a sort of its rows for each of five steps, and lives as arrays."""
    made = predictions(spark, sf)
    lives = results.split_lives(made)
    timed = results.with_time(lives)
    assert sorts(timed) == sorts(lives)
    assert "collect_list" not in plan(timed)
    assert sorts(results.fitted_lives(timed)) <= sorts(lives) + 2


def test_time_of_lives_with_level_starts(spark):
    # Steps 2, 1, 3 from the second row on; the first two rows are level, and take the median step.
    y = [9.0, 9.0, 7.0, 6.0, 3.0]
    rows = [("a", 1, i, v, v) for i, v in enumerate([*y, 4.0, 1.0])]
    df = spark.createDataFrame(rows, "model string, fold long, idx long, y_true double, y_pred double")
    found = results.with_time(results.split_lives(df)).orderBy("idx").select("life", "start", "time").collect()
    assert [tuple(r) for r in found] == [(0, 1, 2.0), (0, 1, 4.0), (0, 1, 7.0), (0, 1, 8.0), (0, 1, 10.0), (1, 0, 0.0), (1, 0, 3.0)]


def test_metrics_of_cells_need_one_order(spark, sf):
    found = analysis.analyze(cycles(spark, sf), ["correlation", "number_of_unique_elements", "std", "autocorrelation"], ["k", "value"])
    text = plan(found)
    # One order by value and one by position, and no table of distinct values.
    assert sorts(found) <= sorts(cycles(spark, sf).df) + 2 and text.count("Aggregate [") == 1
    rows = [(1, i, v, float(i)) for i, v in enumerate([2.0, None, 2.0, 0.0, -0.0, float("inf"), 5.0])]
    own = CycleSet(spark.createDataFrame(rows, "cycle_id long, pos long, v double, RUL double"), features=["v", "RUL"])
    got = analysis.analyze(own, ["number_of_unique_elements", "correlation"], ["v"]).first()
    part = pd.Series([2.0, 2.0, 0.0, 0.0, 5.0])
    assert got["number_of_unique_elements"] == 4
    assert np.isclose(got["correlation"], np.corrcoef(part.rank(), [0, 2, 3, 4, 6])[0, 1])
