"""Steps on small literal frames with known results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from wearline import operators as op
from wearline.frame import from_cycles
from wearline.plans.graph import IdentityTransformer, Pipeline, Source, Transformer, make_pipeline

INF = float("inf")


def rows(frame, cycle=0):
    """A cycle's features by name, NULL as None."""
    found = frame.df.filter(f"{frame.cycle} = {cycle}").orderBy(frame.pos).collect()
    return {n: [r[n] for r in found] for n in frame.columns}


def frame_of(spark, *cycles, names=None):
    return from_cycles(spark, [pd.DataFrame(c) for c in cycles]).frame(names)


def close(found, expected, tolerance=1e-9):
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert (a is None and b is None) or (a is not None and b is not None and (a == b or abs(a - b) < tolerance)), (found, expected)


def test_scalers_of_two_cycles(spark):
    data = frame_of(spark, {"a": [1.0, 2, 3, 4], "b": [2.0, 4, 6, 8]}, {"a": [150.0, 5, 14, 24], "b": [-52.0, -14, -36, 8]})
    found = rows(op.MinMaxScaler((-1, 1)).fit_transform(data), 1)
    assert found["a"][0] == 1 and found["b"][0] == -1 and found["b"][3] == 1
    a = np.array([1, 2, 3, 4, 150, 5, 14, 24.0])
    close(rows(op.StandardScaler().fit_transform(data))["a"], list((a[:4] - a.mean()) / a.std(ddof=1)))
    close(rows(op.RobustStandardScaler().fit_transform(data))["a"], list((a[:4] - np.median(a)) / (np.quantile(a, 0.75) - np.quantile(a, 0.25))))
    close(rows(op.RobustMinMaxScaler((0, 1)).fit_transform(data), 1)["a"][:1], [1.0])


def test_scaler_of_constant_and_missing(spark):
    data = frame_of(spark, {"a": [3.0, 3, 3], "b": [1.0, None, 2]})
    found = rows(op.MinMaxScaler((0, 5)).fit_transform(data))
    assert found["a"] == [3, 3, 3] and found["b"] == [0, None, 5]
    assert rows(op.StandardScaler().fit_transform(data))["a"] == [0, 0, 0]


def test_iqr_marks_infinities(spark):
    data = frame_of(spark, {"a": [0, 0.5, 0.2, 0.1, 0.9, 15, 0.5, 0.3, 0.5], "b": [5.0, 6, 7, 5, 9, 5, 6, 5, -45]})
    found = rows(op.IQROutlierRemover().fit_transform(data))
    assert found["a"][5] == INF and found["b"][8] == -INF
    assert all(math.isfinite(v) for i, v in enumerate(found["a"]) if i != 5)


def test_zscore_drops(spark):
    data = frame_of(spark, {"a": [0, 0.5, 0.2, 0.1, 0.9, 15, 0.5, 0.3, 0.5], "b": [5.0, 6, 7, 5, 9, 5, 6, 5, 45]})
    found = rows(op.ZScoreOutlierRemover(2).fit_transform(data))
    assert found["a"].index(None) == 5 and found["b"].index(None) == 8


@pytest.mark.parametrize(("limit", "kept"), [(0.3, ["c"]), (0.55, ["a", "c"]), (0.8, ["a", "b", "c"])])
def test_null_proportion(spark, limit, kept):
    data = frame_of(spark, {"a": [0, 0.5, None, None], "b": [5.0, None, None, None], "c": [5.0, 2, 3, None]})
    for per_cycle in (True, False):
        assert op.NullProportionSelector(limit, per_cycle=per_cycle).fit_transform(data).columns == kept


def test_variance_threshold_in_every_cycle(spark):
    data = frame_of(spark, {"a": [1.0, 9], "b": [1.0, 1]}, {"a": [2.0, 8], "b": [0.0, 50]})
    assert op.PandasVarianceThreshold(1).fit_transform(data).columns == ["a"]
    assert op.PandasVarianceThreshold(1, per_cycle=False).fit_transform(data).columns == ["a", "b"]


def test_changes_and_accumulate(spark):
    data = frame_of(spark, {"a": list("aaabbaac"), "b": list("aabbcccc"), "d": [1, 0, 1, 0, 0, 0, 0, 0]})
    found = rows(op.ChangesDetector().transform(data.select(["a", "b"])))
    assert [int(v) for v in found["a"]] == [1, 0, 0, 1, 0, 1, 0, 1]
    assert [int(v) for v in found["b"]] == [1, 0, 1, 0, 1, 0, 0, 0]
    assert rows(op.Accumulate().transform(data.select(["d"])))["d"][:4] == [1, 1, 2, 2]


def test_encoders(spark):
    train = frame_of(spark, {"x": ["c1", "c2", "c3", "c1", "c3"]}, {"x": ["c1", "c1", "c2", "c1", "c4"]})
    other = frame_of(spark, {"x": ["c1", "c1", "c1", "c3", "c5"]})
    assert rows(op.SimpleEncodingCategorical().fit(train).transform(other))["encoding"] == [0, 0, 0, 2, -1]
    hot = rows(op.OneHotCategorical().fit(train).transform(other))
    assert list(hot) == ["c1", "c2", "c3", "c4"] and [v[4] for v in hot.values()] == [0, 0, 0, 0] and hot["c1"] == [1, 1, 1, 0, 0]
    hashed = rows(op.HashingEncodingCategorical(7).transform(other))["encoding"]
    assert hashed[0] == hashed[1] and all(0 <= v < 7 for v in hashed)


def test_difference_and_its_error(spark):
    data = frame_of(spark, {"a": [1, 2, 3, 4], "b": [2, 4, 6, 8], "c": [2, 2, 2, 2], "d": [1, 1, 1, 1]})
    found = rows(op.Difference(["a", "b"], ["c", "d"]).transform(data))
    assert found == {"a": [-1, 0, 1, 2], "b": [1, 3, 5, 7]}
    with pytest.raises(ValueError):
        op.Difference(["a"], ["c", "d"])


def test_local_entropy_of_a_known_series(spark):
    data = frame_of(spark, {"a": [0, 0, 1, 1, 1, 1, 0, 0, 0]})
    found = rows(op.LocalEntropyMeasures(2).transform(data))
    close(found["a_local_block_entropy"], [None, 1.4150375, 3, 1.4150375, 1.4150375, 1.4150375, 3, 1.4150375, 1.4150375], 1e-6)
    close(found["a_local_entropy_rate"], [None, None, 1, 0, 0.5849625, 0.5849625, 1.5849625, 0, 1], 1e-6)
    close(found["a_local_active_information"], [None, None, -0.19264508, 0.80735492, 0.22239242, 0.22239242, -0.36257008, 1.22239242, 0.22239242], 1e-6)


def test_integer_resample(spark):
    data = frame_of(spark, {"time": [5.0, 3, 0], "B": [10.0, 6, 0]})
    assert rows(op.IntegerIndexResamplerTransformer("time", 2).transform(data))["B"] == [0, 4, 8]


def test_peaks(spark):
    data = frame_of(spark, {"a": list(np.cos(np.arange(-np.pi, 3 * np.pi, np.pi / 4)))})
    assert [i for i, v in enumerate(rows(op.Peaks(3).transform(data))["a"]) if v] == [4, 12]


def test_rows_and_strings(spark):
    data = frame_of(spark, {"a": list("abc"), "b": list("def")})
    assert rows(op.StringConcatenate().transform(data))["concatenation"] == ["a-d", "b-e", "c-f"]
    ten = frame_of(spark, {"a": list(range(10))})
    assert rows(op.SliceRows(op.RelativeToStart(5), op.RelativeToEnd(5)).transform(ten))["a"] == []
    assert rows(op.SliceRows(op.RelativeToStart(2), op.RelativeToEnd(3)).transform(ten))["a"] == [2, 3, 4, 5, 6]


def test_imputers(spark):
    data = frame_of(spark, {"a": [0, INF, 12, -INF, 0.9, 15, 0.5, 0.3, 0.5]})
    rolling = op.ApplyRollingImputer(3, lambda v: v[np.isfinite(v)].max())
    close(rows(rolling.fit_transform(data))["a"], [0, 12, 12, 15, 0.9, 15, 0.5, 0.3, 0.5])
    assert rows(op.PerColumnImputer().fit_transform(data))["a"][1::2][:2] == [15, 0]
    holes = frame_of(spark, {"a": [None, 1.0, None, 3, None]})
    assert rows(op.ForwardFillImputer().transform(holes))["a"] == [None, 1, 1, 3, 3]
    assert rows(op.BackwardFillImputer().transform(holes))["a"] == [1, 1, 3, 3, None]
    assert rows(op.MedianImputer().fit_transform(holes))["a"] == [2, 1, 2, 3, 2]
    assert rows(op.MeanImputer().fit_transform(holes))["a"] == [2, 1, 2, 3, 2]
    assert rows(op.FillImputer(9.0).transform(holes))["a"] == [9, 1, 9, 3, 9]
    assert rows(op.RollingMedianImputer(2).fit_transform(holes))["a"] == [1, 1, 2, 3, 3]
    assert rows(op.NaNtoInf().transform(data))["a"][1] is None


def test_targets(spark):
    data = frame_of(spark, {"RUL": list(np.linspace(0, 500, 50))})
    rul = np.linspace(0, 500, 50)
    assert rows(op.TargetToClasses([15, 50, 150, 200]).transform(data))["RUL_class"] == np.digitize(rul, [15, 50, 150, 200]).tolist()
    assert rows(op.RULBinarizer(50).transform(data))["RUL"] == (rul > 50).astype(int).tolist()
    close(rows(op.PicewiseRUL(26).transform(data))["RUL"], np.clip(rul, 0, 26).tolist())


def test_windows_against_pandas(spark):
    random = np.random.RandomState(0)
    x = [None if i % 11 == 5 else float(v) for i, v in enumerate(random.standard_normal(60) * 3)]
    data = frame_of(spark, {"x": x}, {"x": [4.0]}, {"x": [2.0, 2, 2, 2, 2]})
    s = pd.Series(x, dtype=float)
    found = rows(op.RollingStatistics(7, 3).transform(data))
    for name, expected in {"mean": s.rolling(7, 3).mean(), "std": s.rolling(7, 3).std(), "skewness": s.rolling(7, 3).skew(), "kurtosis": s.rolling(7, 3).kurt(), "max": s.rolling(7, 3).max()}.items():
        close(found[f"x_{name}"], [None if np.isnan(v) else v for v in expected], 1e-8)
    expanding = rows(op.ExpandingStatistics(2).transform(data))
    close(expanding["x_std"], [None if np.isnan(v) else v for v in s.expanding(2).std()], 1e-8)
    assert rows(op.RollingStatistics(7, 2, to_compute=["std", "deviance", "impulse"]).transform(data), 2)["x_deviance"] == [None] * 5
    ewma = rows(op.EWMAFilter(4).transform(data))
    close(ewma["x"], s.ewm(span=4, ignore_na=True).mean().tolist(), 1e-9)
    for center in (True, False):
        close(rows(op.MeanFilter(5, center, 2).transform(data))["x"], [None if np.isnan(v) else v for v in s.rolling(5, 2, center=center).mean()], 1e-9)


def test_graph_with_branches_is_one_projection(spark):
    data = frame_of(spark, {"a": [1.0, 2, 3], "b": [4.0, 5, 6]})
    start = Source()
    graph = Pipeline(op.Concatenate()(op.Scale(2.0)(start), op.MinMaxScaler((0, 1))(start)))
    found = graph.fit_transform(data)
    assert rows(found) == {"Scale_0_a": [2, 4, 6], "Scale_0_b": [8, 10, 12], "MinMaxScaler_1_a": [0, 0.5, 1], "MinMaxScaler_1_b": [0, 0.5, 1]}
    assert "Join" not in found.df._jdf.queryExecution().toString()
    half = Pipeline(op.Scale(2.0)(start) / 4)
    assert rows(half.fit_transform(data))["a"] == [0.5, 1, 1.5]
    both = Pipeline(op.Scale(2.0)(Source()) + 1)
    assert rows(both.fit_transform(data))["a"] == [3, 5, 7]


def test_branches_of_other_rows_are_joined(spark):
    data = frame_of(spark, {"a": [1.0, 2, 3]})
    start = Source()
    found = rows(Pipeline(op.Sum()(op.Subsample(2)(start), op.Scale(10.0)(start))).fit_transform(data))
    assert found["a"] == [11, 20, 33]


def test_params_round_trip(spark, tmp_path):
    data = frame_of(spark, {"a": [1.0, 2, 3]})
    make = lambda: make_pipeline(op.MinMaxScaler((0, 1)), op.MeanImputer())
    fitted = make().fit(data)
    fitted.save(str(tmp_path / "params.json"))
    other = make().load(str(tmp_path / "params.json"))
    assert rows(other.transform(frame_of(spark, {"a": [2.0, None]})))["a"] == [0.5, 0.5]
    with pytest.raises(ValueError):
        make().transform(data)
    assert fitted.find_node("MeanImputer").params == {"a": {"mean": 0.5}}


def test_split_by_category_and_unseen(spark):
    train = frame_of(spark, {"c": ["x", "x", "y", "y"], "a": [1.0, 3, 10, 20]})
    step = op.SplitByCategory("c", op.MeanCentering).fit(train)
    found = rows(step.transform(train))
    assert found["a"] == [-1, 1, -5, 5]
    other = rows(step.transform(frame_of(spark, {"c": ["z", "x"], "a": [8.5, 2.0]})))
    assert other["a"] == [0, 0]
    per = op.PerCategoricalMinMaxScaler("c", scaler_params={"range": (0, 1)}).fit(train)
    assert rows(per.transform(train))["a"] == [0, 1, 0, 1]


def test_transformer(spark):
    data = frame_of(spark, {"a": [1.0, 2, 3], "RUL": [2.0, 1, 0]})
    own = Transformer(make_pipeline(op.ByNameFeatureSelector(["a"]), op.MinMaxScaler((0, 1))), op.ByNameFeatureSelector(["RUL"]))
    found = own.fit_map(data)
    assert own.n_features == 1 and found.df().columns == ["cycle_id", "pos", "a", "RUL"]
    assert own.description()["metadata"] == "Missing"
    assert IdentityTransformer("RUL").fit_map(data).x.columns == ["a", "RUL"]


def test_wavelets_and_modes_add_up(spark):
    x = np.cumsum(np.random.RandomState(1).standard_normal(64))
    data = frame_of(spark, {"x": list(x)})
    for wavelet in ("db1", "db3"):
        bands = rows(op.SlidingNonOverlappingWaveletDecomposition(32, 2, wavelet, ["A2", "D1", "D2"]).transform(data))
        close(list(np.sum([bands[f"wavelet_{b}_x"] for b in ("A2", "D1", "D2")], axis=0)), list(x), 1e-8)
    modes = rows(op.EMD(4).transform(data))
    close(list(np.nansum([[np.nan if v is None else v for v in m] for m in modes.values()], axis=0)), list(x), 1e-8)


def test_kmeans_leaves_k_values(spark):
    data = frame_of(spark, {"x": [0.0, 0.1, 5, 5.1, 9, 9.1], "y": [0.0, 0, 1, 1, 2, 2]})
    assert len(set(rows(op.OneDimensionalKMeans(3).fit_transform(data))["x"])) == 3
    found = rows(op.MultiDimensionalKMeans(3).fit_transform(data))
    assert len(set(zip(found["x"], found["y"], strict=True))) == 3


class _Range:
    """Scales by the extremes of all rows it has been given."""

    low, high = math.inf, -math.inf

    def fit(self, x):
        self.low, self.high = np.nanmin(x, axis=0), np.nanmax(x, axis=0)

    def transform(self, x):
        return (x - self.low) / (self.high - self.low)


class _RangeInParts(_Range):
    most = 0

    def partial_fit(self, x):
        self.most = max(self.most, len(x))
        self.low, self.high = np.fmin(self.low, np.nanmin(x, axis=0)), np.fmax(self.high, np.nanmax(x, axis=0))


def test_wrapped_objects_are_fitted_on_all_rows(spark):
    x = [float(i % 7) for i in range(500)]
    x[123], x[124], x[377] = 1000.0, None, -1000.0
    data = frame_of(spark, {"x": x}, {"x": [5000.0, 1.0]})
    expected = [None if v is None else (v + 1000) / 6000 for v in x]
    step = op.SKLearnTransformerWrapper(_RangeInParts(), max_rows=50)
    for _ in range(2):
        close(rows(step.fit_transform(data))["x"], expected)
        assert step.transformer.most == 50
    close(rows(op.SKLearnTransformerWrapper(_Range(), max_rows=502).fit_transform(data))["x"], expected)
    with pytest.raises(ValueError, match="partial_fit"):
        op.SKLearnTransformerWrapper(_Range(), max_rows=501).fit(data)


def test_isolation_forest(spark):
    x = [float(v) for v in np.random.RandomState(0).standard_normal(300)] + [60.0]
    found = rows(op.IsolationForestOutlierRemover(50).fit_transform(frame_of(spark, {"x": x})))["x"]
    assert found[-1] is None
