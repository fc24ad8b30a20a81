"""Windows, scalers, imputers, outliers, encoders, arithmetic and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline import operators as op
from wearline.plans.graph import Pipeline, Source, Transformer, make_pipeline
from wearline.queries.common import BASE, WINDOWS, cycles, gaps, query, r, rounded, sensors

_KEYS = "cycle_id, CAST(pos AS BIGINT) AS pos"


def _sql(columns: str, source: str = "d") -> str:
    return f"{BASE} SELECT {_KEYS}, {columns} FROM {source} {WINDOWS}"


def _stats(w: str, names: tuple[str, ...], least: int = 2) -> str:
    """Statistics of ``value`` over a window in SQL."""
    x, o = "value", f"OVER {w}"
    peak = f"(max({x}) {o} - min({x}) {o})"
    mean_abs, rms = f"avg(abs({x})) {o}", f"sqrt(avg({x} * {x}) {o})"
    forms = {
        "mean": f"avg({x}) {o}", "max": f"max({x}) {o}", "min": f"min({x}) {o}", "std": f"stddev_samp({x}) {o}",
        "kurtosis": f"CASE WHEN count({x}) {o} >= 4 AND {peak} > 0 THEN kurtosis({x}) {o} END",
        "skewness": f"CASE WHEN count({x}) {o} >= 3 AND {peak} > 0 THEN skewness({x}) {o} END",
        "peak": peak, "impulse": f"{peak} / nullif({mean_abs}, 0)", "clearance": f"{peak} / nullif(pow(avg(sqrt(abs({x}))) {o}, 2), 0)", "rms": rms,
        "shape": f"{rms} / nullif({mean_abs}, 0)", "crest": f"{peak} / nullif({rms}, 0)", "deviance": f"({x} - avg({x}) {o}) / nullif(stddev_samp({x}) {o}, 0)",
        "std_atan": f"stddev_samp(atan({x})) {o}", "std_asinh": f"stddev_samp(asinh({x})) {o}",
        "std_acosh": f"stddev_samp(CASE WHEN {x} >= 1 THEN acosh({x}) END) {o}", "energy": f"sum({x} * {x}) {o}",
    }
    return ", ".join(f"{r(f'CASE WHEN count({x}) {o} >= {least} THEN {forms[n]} END', 5)} AS value_{n}" for n in names)


_ROLLING = ("mean", "max", "min", "std", "kurtosis", "skewness", "peak", "impulse", "clearance", "rms", "shape", "crest", "deviance", "std_atan", "std_asinh", "std_acosh", "energy")
_EXPANDING = tuple(s for s in _ROLLING if s not in ("energy", "deviance"))


@query("rolling_stats", _sql(_stats("r5", _ROLLING)))
def rolling_stats(spark, sf):
    return rounded(op.RollingStatistics(5, 2).transform(sensors(spark, sf)).df, 5)


@query("expanding_stats", _sql(_stats("ex", _EXPANDING)))
def expanding_stats(spark, sf):
    return rounded(op.ExpandingStatistics(2).transform(sensors(spark, sf)).df, 5)


@query(
    "life_stats",
    BASE + f"""SELECT cycle_id, CAST(0 AS BIGINT) AS pos, {r('CASE WHEN count(value) >= 4 THEN kurtosis(value) END', 5)} AS value_kurtosis, {r('CASE WHEN count(value) >= 3 THEN skewness(value) END', 5)} AS value_skewness,
{r('max(value)', 5)} AS value_max, {r('min(value)', 5)} AS value_min, {r('stddev_samp(value)', 5)} AS value_std, {r('max(value) - min(value)', 5)} AS value_peak,
{r('coalesce((max(value) - min(value)) / nullif(avg(abs(value)), 0), 0)', 5)} AS value_impulse, {r('coalesce(pow((max(value) - min(value)) / nullif(avg(sqrt(abs(value))), 0), 2), 0)', 5)} AS value_clearance,
{r('sqrt(avg(value * value))', 5)} AS value_rms, {r('coalesce(sqrt(avg(value * value)) / nullif(avg(abs(value)), 0), 0)', 5)} AS value_shape,
{r('coalesce((max(value) - min(value)) / nullif(sqrt(avg(value * value)), 0), 0)', 5)} AS value_crest FROM d GROUP BY cycle_id""",
)
def life_stats(spark, sf):
    return rounded(op.LifeStatistics().transform(sensors(spark, sf)).df, 5)


def _register(name: str, columns: str, step, names: tuple[str, ...] = ("value",), prepare=None, source: str = "d", digits: int = 6):
    """A query that fits and applies one step."""

    @query(name, _sql(columns, source))
    def run(spark, sf):
        frame = sensors(spark, sf, names)
        made = step() if callable(step) else step
        return rounded(made.fit_transform(prepare(frame) if prepare else frame).df, digits)

    return run


def _value(expression: str, name: str = "value") -> str:
    return f"{r(expression)} AS {name}"


_HOLES = "(SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN value END AS value) FROM d)"
_MOMENTS = "(SELECT d.*, s.* FROM d, (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_samp(value) AS s, stddev_pop(value) AS sp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM d) s)"
_HOLED = _MOMENTS.replace("FROM d)", f"FROM {_HOLES})").replace("FROM d,", f"FROM {_HOLES} d,")

_register("mean_filter", _value("CASE WHEN count(value) OVER m5 >= 3 THEN avg(value) OVER m5 END"), lambda: op.MeanFilter(5, True, 3))
_register("median_filter", _value("CASE WHEN count(value) OVER r5 >= 3 THEN median(value) OVER r5 END"), lambda: op.MedianFilter(5, 3))
_register("expanding_centering", _value("value - avg(value) OVER ex"), op.ExpandingCentering)
_register("rolling_centering", _value("value - avg(value) OVER r5"), lambda: op.RollingCentering(5, 1))
_register("expanding_norm", _value("(value - avg(value) OVER ex) / nullif(stddev_samp(value) OVER ex, 0)"), op.ExpandingNormalization)
_register("accumulate", "CAST(sum(k) OVER ex AS BIGINT) AS k", op.Accumulate, ("k",))
_register("accumulate_normalized", _value("sum(k) OVER ex / nullif(sqrt(abs(sum(k) OVER ex)), 0)", "k"), lambda: op.Accumulate(normalize=True), ("k",))
_register("diff", _value("value - lag(value) OVER wc"), op.Diff)
_register("changes", "coalesce(event_type <> lag(event_type) OVER wc, true) AS event_type", op.ChangesDetector, ("event_type",))
_register("sample_number", "CAST(pos AS BIGINT) AS sample_number", op.SampleNumber)
_register(
    "ttp_binary", "CAST(pos - max(CASE WHEN event_type = 'click' THEN pos END) OVER ex AS BIGINT) AS ttp_flag", op.TimeToPreviousBinaryValue, ("event_type",),
    lambda f: f.compute({"flag": (f.col("event_type") == "click").cast("int")}),
)
_register("baseline_sub", _value("value - first_value(value) OVER ex"), op.SubstractLinebase)
_register("ffill", _value("last_value(value IGNORE NULLS) OVER ex"), op.ForwardFillImputer, prepare=gaps, source=_HOLES)
_register("bfill", _value("first_value(value IGNORE NULLS) OVER fw"), op.BackwardFillImputer, prepare=gaps, source=_HOLES)
_register("minmax", _value("least(greatest((value - lo) / (hi - lo) * 2 - 1, -1), 1)"), lambda: op.MinMaxScaler((-1, 1)), source=_MOMENTS)
_register("robust_minmax", _value("least(greatest((value - q1) / (q3 - q1), 0), 1)"), lambda: op.RobustMinMaxScaler((0, 1)), source=_MOMENTS)
_register("standard", _value("(value - m) / s"), op.StandardScaler, source=_MOMENTS)
_register("robust_standard", _value("(value - q2) / (q3 - q1)"), op.RobustStandardScaler, source=_MOMENTS)
_register("mean_centering", _value("value - m"), op.MeanCentering, source=_MOMENTS)
_register("median_centering", _value("value - q2"), op.MedianCentering, source=_MOMENTS)
_register(
    "percat_minmax", _value("(value - min(value) OVER (PARTITION BY event_type)) / nullif(max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type), 0) * 2 - 1"),
    lambda: op.PerCategoricalMinMaxScaler("event_type"), ("event_type", "value"),
)
_register(
    "scale_inv_rul", _value("flag * f", "flag"), lambda: op.ScaleInvRUL("RUL"), ("RUL", "event_type"),
    lambda f: f.compute({"flag": (f.col("event_type") == "click").cast("int")}, keep=True).select(["RUL", "flag"]),
    "(SELECT d.*, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS flag, t.f FROM d, (SELECT 1 / quantile_cont(1 + rul / m, 0.5) AS f FROM (SELECT *, max(rul) OVER () AS m FROM d) WHERE event_type = 'click') t)",
)
_register(
    "onehot", ", ".join(f"CAST(event_type = '{c}' AS INTEGER) AS {c}" for c in ("click", "error", "purchase", "signup", "view")), lambda: op.OneHotCategorical("event_type", ("click", "error", "purchase", "signup", "view")), ("event_type",)
)
_register(
    "simple_encoding", "CAST(code AS BIGINT) AS encoding", lambda: op.SimpleEncodingCategorical("event_type"), ("event_type",),
    source="(SELECT d.*, t.code FROM d JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM d)) t USING (event_type))",
)
_register("target_classes", 'CAST((rul >= 5) AS INTEGER) + CAST((rul >= 50) AS INTEGER) + CAST((rul >= 500) AS INTEGER) AS "RUL_class"', lambda: op.TargetToClasses([5, 50, 500]), ("RUL",))
_register("piecewise_rul", r("least(greatest(rul, 0), 30)") + ' AS "RUL"', lambda: op.PicewiseRUL(30), ("RUL",))
_register("piecewise_quantile", r("least(greatest(rul, 0), q)") + ' AS "RUL"', lambda: op.PicewiseRULQuantile(0.6), ("RUL",), source="(SELECT d.*, t.q FROM d, (SELECT quantile_cont(rul, 0.6) AS q FROM d) t)")
_register("rul_binarizer", 'CAST(rul > 20 AS INTEGER) AS "RUL"', lambda: op.RULBinarizer(20), ("RUL",))
_register("iqr_clip", _value("least(greatest(value, q1 - 0.2 * (q3 - q1)), q3 + 0.2 * (q3 - q1))"), lambda: op.IQROutlierRemover(margin=0.2, clip=True), source=_MOMENTS)
_register("beyond_quartile", _value("least(greatest(value, q1), q3)"), lambda: op.BeyondQuartileOutlierRemover(clip=True), source=_MOMENTS)
_register("zscore", _value("CASE WHEN abs((value - m) / sp) <= 1 THEN (value - m) / sp END"), lambda: op.ZScoreOutlierRemover(1), source=_MOMENTS)
_register("ewma_range", _value("CASE WHEN value BETWEEN m - 3 * sqrt(0.1 / 1.9) * sp AND m + 3 * sqrt(0.1 / 1.9) * sp THEN value END"), lambda: op.EWMAOutOfRange(0.1), source=_MOMENTS)
_QUARTILES = "quantile_cont(value, 0.25) OVER r5 AS a, quantile_cont(value, 0.5) OVER r5 AS b, quantile_cont(value, 0.75) OVER r5 AS c, count(value) OVER r5 AS n"
_register(
    "rolling_outlier", _value("CASE WHEN n < 5 THEN value WHEN value < b - 0.5 * (c - a) THEN b - 0.5 * (c - a) WHEN value > b + 0.5 * (c - a) THEN b + 0.5 * (c - a) ELSE value END"),
    lambda: op.RollingMeanOutlierRemover(5, 0.5), source=f"(SELECT *, {_QUARTILES} FROM d {WINDOWS})",
)
_register("mean_imputer", _value("coalesce(value, m)"), op.MeanImputer, prepare=gaps, source=_HOLED)
_register("median_imputer", _value("coalesce(value, q2)"), op.MedianImputer, prepare=gaps, source=_HOLED)
_register("fill_imputer", _value("coalesce(value, -1)"), lambda: op.FillImputer(-1.0), prepare=gaps, source=_HOLES)
_register(
    "percolumn_imputer", _value("CASE WHEN event_id % 5 = 0 THEN hi WHEN event_id % 5 = 1 THEN lo WHEN event_id % 5 = 2 THEN q2 ELSE value END"), op.PerColumnImputer,
    prepare=lambda f: f.compute({"value": F.when(F.col("event_id") % 5 == 0, float("inf")).when(F.col("event_id") % 5 == 1, float("-inf")).when(F.col("event_id") % 5 > 2, f.col("value"))}),
    source="(SELECT d.*, s.* FROM d, (SELECT min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS q2 FROM d WHERE event_id % 5 > 2) s)",
)
_register(
    "rolling_mean_imputer", _value("coalesce(value, avg(value) OVER (PARTITION BY cycle_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), m)"), lambda: op.RollingMeanImputer(2), prepare=gaps, source=_HOLED
)
_register("nan_to_inf", _value("CASE WHEN event_id % 7 <> 0 THEN value END"), op.NaNtoInf, prepare=lambda f: f.compute({"value": F.when(F.col("event_id") % 7 != 0, f.col("value")).otherwise(float("inf"))}))


@query("square_scale_clip", _sql(_value("least(greatest(value * value * 0.5, 1), 200)")))
def square_scale_clip(spark, sf):
    return rounded(make_pipeline(op.Square(), op.Scale(0.5), op.Clip(1, 200)).fit_transform(sensors(spark, sf)).df)


_register("sqrt", _value("CASE WHEN value >= 0 THEN sqrt(value) END"), op.Sqrt)
_register("interactions", _value("value * k", "value_k"), op.Interactions, ("value", "k"))
_register("difference", _value("value - k"), lambda: op.Difference(["value"], ["k"]), ("value", "k"))
_register("column_sum", _value("value + k", "total"), lambda: op.ColumnWiseSum("total"), ("value", "k"))
_register("concat_strings", "event_type || '-' || CAST(k AS VARCHAR) AS concatenation", op.StringConcatenate, ("event_type", "k"))
_register(
    "local_entropy",
    "round(CASE WHEN pos >= 2 THEN log2((nb / nh) / (nv / n)) END + 1.3e-8, 6) + 0e0 AS k_local_active_information, round(CASE WHEN pos >= 1 THEN -log2(nk / bl) END + 1.3e-8, 6) + 0e0 AS k_local_block_entropy, round(CASE WHEN pos >= 2 THEN -log2(nb / nh) END + 1.3e-8, 6) + 0e0 AS k_local_entropy_rate",
    op.LocalEntropyMeasures, ("k",), lambda f: f.compute({"k": f.col("k") % 2}),
    """(SELECT *, CAST(count(CASE WHEN pos >= 2 THEN 1 END) OVER (PARTITION BY cycle_id) AS DOUBLE) AS n, CAST(count(CASE WHEN pos >= 2 THEN 1 END) OVER (PARTITION BY cycle_id, h) AS DOUBLE) AS nh,
count(CASE WHEN pos >= 2 THEN 1 END) OVER (PARTITION BY cycle_id, x) AS nv, count(CASE WHEN pos >= 2 THEN 1 END) OVER (PARTITION BY cycle_id, h, x) AS nb,
CAST(count(CASE WHEN pos >= 1 THEN 1 END) OVER (PARTITION BY cycle_id, b) AS DOUBLE) AS nk, count(CASE WHEN pos >= 1 THEN 1 END) OVER (PARTITION BY cycle_id) AS bl
FROM (SELECT cycle_id, pos, k % 2 AS x, CASE WHEN pos >= 2 THEN lag(k % 2, 2) OVER wc || '|' || lag(k % 2) OVER wc END AS h, CASE WHEN pos >= 1 THEN lag(k % 2) OVER wc || '|' || (k % 2) END AS b FROM d """ + WINDOWS + "))",
)


def _gauss(std: float) -> str:
    weight = f"exp(-0.5 * pow((2 - (d.pos - x.pos) - 0) / {std}, 2))"
    return f"sum(x.value * {weight}) / sum({weight})"


_GAUSS = BASE + "SELECT d.cycle_id, CAST(d.pos AS BIGINT) AS pos, {} AS value FROM d JOIN d x ON x.cycle_id = d.cycle_id AND x.pos BETWEEN d.pos - 4 AND d.pos GROUP BY 1, 2"


@query("gaussian_filter", _GAUSS.format(r(_gauss(2.0))))
def gaussian_filter(spark, sf):
    return rounded(op.GaussianFilter(5, 2.0).transform(sensors(spark, sf)).df)


@query("dog", _GAUSS.format(r(f"{_gauss(1.0)} - {_gauss(2.0)}")))
def dog(spark, sf):
    return rounded(op.DoG(5, [1.0, 2.0]).transform(sensors(spark, sf)).df)


@query("ewma_filter", BASE + f"""SELECT d.cycle_id, CAST(d.pos AS BIGINT) AS pos, {r('sum(x.value * pow(2.0 / 3, d.pos - x.pos)) / sum(pow(2.0 / 3, d.pos - x.pos))')} AS value
FROM d JOIN d x ON x.cycle_id = d.cycle_id AND x.pos <= d.pos GROUP BY 1, 2""")  # fmt: skip
def ewma_filter(spark, sf):
    return rounded(op.EWMAFilter(5).transform(sensors(spark, sf)).df)


@query("sum_steps", _sql(_value("value * value + value")))
def sum_steps(spark, sf):
    return rounded(_branches(spark, sf, "+"))


def _branches(spark, sf, sign: str):
    start = Source()
    left, right = op.Square()(start), op.Scale(1.0)(start)
    return Pipeline(left + right if sign == "+" else left / right).fit_transform(sensors(spark, sf)).df


@query("divide_steps", _sql(_value("value * value / nullif(value * 1.0, 0)")))
def divide_steps(spark, sf):
    return rounded(_branches(spark, sf, "/"))


@query("concatenate_steps", _sql(f"{r('value * value')} AS \"Square_0_value\", {r('value * 3')} AS \"Scale_1_value\""))
def concatenate_steps(spark, sf):
    start = Source()
    return rounded(Pipeline(op.Concatenate()(op.Square()(start), op.Scale(3.0)(start))).fit_transform(sensors(spark, sf)).df)


@query("split_by_category", _sql(_value("value - avg(value) OVER (PARTITION BY event_type)")))
def split_by_category(spark, sf):
    return rounded(op.SplitByCategory("event_type", op.MeanCentering).fit_transform(sensors(spark, sf, ("event_type", "value"))).df)


@query("transformer_xy", _sql(f"{r('(value - lo) / (hi - lo)')} AS value, {r('least(rul, 30)')} AS \"RUL\"", _MOMENTS))
def transformer_xy(spark, sf):
    x = make_pipeline(op.ByNameFeatureSelector(["value"]), op.MinMaxScaler((0, 1)))
    y = make_pipeline(op.ByNameFeatureSelector(["RUL"]), op.PicewiseRUL(30))
    return rounded(Transformer(x, y).fit_map(cycles(spark, sf)).df())


_FLAGSHIP = ("mean", "std", "rms", "kurtosis")


@query(
    "flagship",
    BASE + f", s AS (SELECT d.* REPLACE ((value - lo) / (hi - lo) AS value) FROM d, (SELECT min(value) AS lo, max(value) AS hi FROM d)), f AS (SELECT cycle_id, pos, count(*) OVER whole AS n, {_stats('r5', _FLAGSHIP)} FROM s {WINDOWS}) SELECT * EXCLUDE (n) REPLACE (CAST(pos AS BIGINT) AS pos) FROM f WHERE pos >= greatest(n - 10, 0)",
)
def flagship(spark, sf):
    """Split at failures, label, scale, rolling statistics, the last rows of each cycle."""
    graph = make_pipeline(op.ByNameFeatureSelector(["value"]), op.MinMaxScaler((0, 1)), op.RollingStatistics(5, 2, to_compute=_FLAGSHIP), op.SliceRows(op.RelativeToEnd(10), op.RelativeToEnd(0)))
    return rounded(graph.fit_transform(cycles(spark, sf)).df, 5)


# The projection of five values on their parabola: the first two rows of its matrix, and the middle one.
_PARABOLA = ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3))


def _parabola(row: int, offset: int, sign: int = 1) -> str:
    """A row of the matrix over values ``offset`` rows away and on, in the direction of ``sign``."""
    terms = []
    for i, w in enumerate(_PARABOLA[row]):
        k = sign * (i + offset)
        x = f"lag(value, {-k}) OVER wc" if k < 0 else f"lead(value, {k}) OVER wc" if k else "value"
        terms.append(f"{w} * {x}")
    return f"({' + '.join(terms)}) / 35"


@query(
    "savitzky_golay",
    BASE + f"""SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('v')} AS value FROM (SELECT *, CASE WHEN n <= 5 THEN value WHEN pos = 0 THEN {_parabola(0, 0)} WHEN pos = 1 THEN {_parabola(1, -1)}
WHEN pos = n - 1 THEN {_parabola(0, 0, -1)} WHEN pos = n - 2 THEN {_parabola(1, -1, -1)} ELSE {_parabola(2, -2)} END AS v FROM (SELECT *, count(*) OVER whole AS n FROM d {WINDOWS}) {WINDOWS})""",
)
def savitzky_golay(spark, sf):
    return rounded(op.SavitzkyGolayTransformer(5, 2).transform(sensors(spark, sf)).df)


# Kernels: no SQL says them; tests compare them with definitions. ---------------------------------------


def _kernel(name: str, step, names: tuple[str, ...] = ("value",), prepare=None):
    @query(name)
    def run(spark, sf):
        frame = sensors(spark, sf, names)
        return rounded(step().fit_transform(prepare(frame) if prepare else frame).df)


_kernel("peaks", lambda: op.Peaks(3))
_kernel("emd", lambda: op.EMD(3))
_kernel("emd_filter", lambda: op.EMDFilter(3, 1, 3))
_kernel("emd_blocks", lambda: op.SlidingNonOverlappingEMD(16, 3, 2))
_kernel("wavelet_blocks", lambda: op.SlidingNonOverlappingWaveletDecomposition(16, 2, "db2", ["A2", "D1", "D2"]))
_kernel("frequency_features", op.FrequencyFeatures)
_kernel("hurst", lambda: op.HurstExponent("all", 4, 16, 3))
_kernel("kmeans_values", lambda: op.OneDimensionalKMeans(3))
_kernel("kmeans_rows", lambda: op.MultiDimensionalKMeans(3), ("value", "k"))
_kernel("isolation_forest", op.IsolationForestOutlierRemover)
_kernel("hashing_encoding", lambda: op.HashingEncodingCategorical(16, "event_type"), ("event_type",))
_kernel("apply_rolling_imputer", lambda: op.ApplyRollingImputer(2, _largest_finite), prepare=gaps)
_kernel("rocket", lambda: op.ROCKET(4, (2, 3)), ("value", "k", "event_id"))


def _largest_finite(values) -> float:
    import numpy as np

    good = values[np.isfinite(values)]
    return float(good.max()) if len(good) else float("nan")

