"""Kernels against definitions."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from wearline.functions import kernels
from wearline.functions.quantiles import Quantile, exact


def test_murmur3_reference_values():
    # Published test values of MurmurHash3_x86_32.
    assert kernels.murmur3(b"") == 0
    assert kernels.murmur3(b"", 1) == 0x514E28B7
    assert kernels.murmur3(b"hello") == 0x248BFA47
    assert kernels.murmur3(b"hello, world") == 0x149BBB7F
    assert [kernels.integer_bytes(v) for v in (0, 255, 256, -1)] == [b"\0", b"\xff", b"\0\1", b"\xff"]


@pytest.mark.parametrize(("window", "order"), [(5, 2), (7, 3)])
def test_savitzky_golay_keeps_polynomials(window, order):
    t = np.arange(30.0)
    x = sum(c * t**k for k, c in enumerate((1.0, -2.0, 0.3, 0.01)[: order + 1]))
    assert np.allclose(kernels.savitzky_golay(x, window, order), x)
    assert kernels.savitzky_golay(x[:window], window, order) is not None


def test_peaks_of_plateaus_and_distance():
    x = np.array([0, 1, 1, 1, 0, 2, 0, 3, 0.0])
    assert kernels.find_peaks(x).tolist() == [2, 5, 7]
    assert kernels.find_peaks(x, 3).tolist() == [2, 7]
    assert len(kernels.find_peaks(np.zeros(5))) == 0


def test_spectral_moments_of_a_line():
    y = np.zeros(40)
    y[[10, 14]] = 1
    centroid, variance, skew, kurtosis = kernels.moments_of_spectrum(y)
    assert centroid == 12 and variance == 4 and np.isfinite(kurtosis)
    assert np.isnan(kernels.moments_of_spectrum(np.eye(1, 9, 3)[0])[2])


def test_hurst_of_a_random_walk():
    x = np.cumsum(np.random.RandomState(0).standard_normal(5000))
    for method, found in kernels.HURST.items():
        assert 0.35 < found(x, 8, 200, 5) < 0.7, method


def test_daubechies_known_filter():
    s = np.sqrt(3)
    assert np.allclose(kernels.daubechies(2), np.array([1 + s, 3 + s, 3 - s, 1 - s]) / (4 * np.sqrt(2)))
    for p in (1, 3, 5):
        f = kernels.daubechies(p)
        assert np.isclose(f @ f, 1) and np.isclose(f.sum(), np.sqrt(2))


def test_approximate_entropy_by_definition():
    x = np.random.RandomState(3).standard_normal(80)

    def phi(m):
        rows = np.array([x[i : i + m] for i in range(len(x) - m + 1)])
        far = np.abs(rows[:, None] - rows[None]).max(axis=2)
        return np.log((far <= 0.2 * x.std()).mean(axis=1)).mean()

    assert np.isclose(kernels.approximate_entropy(x), phi(2) - phi(3))


def test_mutual_information_orders_dependence():
    random = np.random.RandomState(0)
    x = random.standard_normal(600)
    strong = kernels.mutual_information(x, x + 0.1 * random.standard_normal(600))
    weak = kernels.mutual_information(x, random.standard_normal(600))
    assert strong > 1.5 > 0.2 > weak >= 0
    assert kernels.mutual_information(np.ones(50), x[:50]) == 0


def test_piecewise_lines():
    line = kernels.PiecewiseLinearRegression()
    for t in range(100):
        line.add_point(t, 50 - t if t < 50 else 0)
    found = line.finish()
    assert abs(found.root() - 50) < 2 and abs(found(20) - 30) < 1
    line = kernels.Polyline([((0, 4), (2, 0)), ((2, 0), (4, 0)), ((4, 0), (6, 2))])
    assert line([-1, 0, 1, 2, 3, 5, 8]).tolist() == [6, 4, 2, 0, 0, 1, 4] and line.root() == 2
    assert kernels.Polyline([((0, 4), (2, 3))]).root() == 8 and kernels.Polyline([((0, 4), (2, 4))]).root() == 0


@pytest.mark.parametrize("kind", ["normal", "ties", "one", "skewed"])
def test_exact_quantiles_beyond_memory(spark, kind):
    random = np.random.RandomState(0)
    x = {"normal": random.standard_normal(20_000), "ties": random.randint(0, 4, 20_000).astype(float), "one": np.ones(20_000), "skewed": np.exp(3 * random.standard_normal(20_000))}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
    wanted = {str(q): Quantile(F.col("v"), q) for q in (0.0, 0.25, 0.5, 0.613, 0.999, 1.0)}
    for most in (50, 100_000):
        for name, found in exact(df, wanted, most).items():
            assert np.isclose(found, np.quantile(x, float(name)), rtol=1e-12, atol=1e-12), (kind, name, most)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert exact(df, {"a": Quantile(F.col("v"), 0.5)}) == {"a": None} and exact(df, {}) == {}


def test_rocket_is_repeatable():
    rows = np.random.RandomState(0).rand(4, 12)
    a, b = (kernels.Rocket(12, 6, (3, 5), seed=1)(rows) for _ in range(2))
    assert a.shape == (4, 12) and np.array_equal(a, b)
