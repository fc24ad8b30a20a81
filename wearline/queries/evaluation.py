"""Windows of samples, profiles, evaluation of predictions, joins."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from wearline import analysis, models, results
from wearline import operators as op
from wearline.frame import CycleSet
from wearline.plans import samples
from wearline.queries.common import BASE, WINDOWS, cycles, query, r, raw_events, rounded, sensors
from wearline.sources import asof_forward

# Samples -------------------------------------------------------------------------------------------


def _iterator(spark, sf, **kwargs):
    frame = sensors(spark, sf, ("value", "k", "RUL"))
    return samples.WindowedDatasetIterator(frame.select(["value", "k"]), frame.select(["RUL"]), **kwargs)


def _flat(df):
    """A sample's cells as numbers: a digest that keeps the places."""
    cells = F.flatten(F.transform("X", lambda row: F.transform(row, lambda v: v.cast("double"))))
    total = F.aggregate(F.transform(cells, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    y = F.aggregate(F.transform("y", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return rounded(df.select("cycle_id", "pos", F.size("X").alias("rows"), total.alias("x"), y.alias("y"), F.col("weight").cast("double").alias("weight")), 1)


_CELL = "CAST(CAST(x.value AS FLOAT) AS DOUBLE) * (2 * (x.pos - d.pos + 3) - 1) + x.k * (2 * (x.pos - d.pos + 3))"


@query(
    "windows_forecast",
    BASE + f"""SELECT d.cycle_id, CAST(d.pos AS BIGINT) AS pos, 3 AS rows, {r(f'sum(CASE WHEN x.pos <= d.pos THEN {_CELL} ELSE 0 END)', 1)} AS x,
{r('sum(CASE WHEN x.pos >= d.pos THEN CAST(CAST(x.rul AS FLOAT) AS DOUBLE) * (x.pos - d.pos + 1) ELSE 0 END)', 1)} AS y, 1e0 AS weight
FROM (SELECT *, count(*) OVER whole AS n FROM d {WINDOWS}) d JOIN d x ON x.cycle_id = d.cycle_id AND x.pos BETWEEN d.pos - 2 AND d.pos + 1
WHERE d.pos >= 2 AND (d.pos % 2 = 0 OR d.pos = d.n - 1) GROUP BY 1, 2""",
)
def windows_forecast(spark, sf):
    return _flat(_iterator(spark, sf, window_size=3, step=2, horizon=2).samples())


@query(
    "windows_padded",
    BASE + f"""SELECT d.cycle_id, CAST(d.pos AS BIGINT) AS pos, 3 AS rows, {r(f'sum({_CELL})', 1)} AS x, {r('max(CAST(CAST(d.rul AS FLOAT) AS DOUBLE))', 1)} AS y, {r('max(CAST(1 / (d.rul + 1) AS FLOAT))', 1)} AS weight
FROM d JOIN d x ON x.cycle_id = d.cycle_id AND x.pos BETWEEN d.pos - 2 AND d.pos GROUP BY 1, 2""",
)
def windows_padded(spark, sf):
    return _flat(_iterator(spark, sf, window_size=3, padding=True, sample_weight=samples.rul_inverse_weighted).samples())


@query(
    "windows_seq2seq",
    BASE + f"""SELECT d.cycle_id, CAST(d.pos AS BIGINT) AS pos, 3 AS rows, {r(f'sum({_CELL})', 1)} AS x, {r('sum(CAST(CAST(x.rul AS FLOAT) AS DOUBLE) * (x.pos - d.pos + 3))', 1)} AS y, 1e0 AS weight
FROM d JOIN d x ON x.cycle_id = d.cycle_id AND x.pos BETWEEN d.pos - 2 AND d.pos WHERE d.pos >= 2 GROUP BY 1, 2""",
)
def windows_seq2seq(spark, sf):
    return _flat(_iterator(spark, sf, window_size=3, iteration_type=samples.SEQ_TO_SEQ).samples())


@query("sample_weights", BASE + f"""SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('1 / (rul + 1)')} AS inverse, {r('exp(-(rul * rul) / (-400 / ln(1e-6)))')} AS decay,
{r('1 / nullif(first_value(rul) OVER ex, 0)')} AS by_length FROM d {WINDOWS}""")  # fmt: skip
def sample_weights(spark, sf):
    frame = sensors(spark, sf, ("RUL",))
    y = frame.col("RUL")
    first = F.first(y).over(frame.expanding)
    return rounded(frame.compute({"inverse": samples.rul_inverse_weighted(y), "decay": samples.ExponentialDecay(20.0)(y), "by_length": samples.InverseToLengthWeighted()(first)}).df)


@query("inverse_order", BASE + f"""SELECT cycle_id, CAST(pos AS BIGINT) AS pos, CAST(row_number() OVER (ORDER BY pos DESC, cycle_id) - 1 AS BIGINT) AS place
FROM (SELECT *, count(*) OVER whole AS n FROM d {WINDOWS}) WHERE (n - 1 - pos) % 2 = 0 AND pos < n""")  # fmt: skip
def inverse_order(spark, sf):
    own = _iterator(spark, sf, window_size=2, padding=True, shuffler=samples.InverseOrder(2))
    return own.batches(64).select("cycle_id", "pos", F.col("place").cast("long").alias("place"))


@query("batches", BASE + """SELECT CAST(floor(place / 100) AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n FROM
(SELECT row_number() OVER (ORDER BY cycle_id, pos) - 1 AS place FROM d WHERE pos >= 2) GROUP BY 1""")  # fmt: skip
def batches(spark, sf):
    return _iterator(spark, sf, window_size=3).batches(100).groupBy("batch").agg(F.count("*").alias("n"))


# Powers of the size up to it, as many as it has rows: the whole parts are distances from the end.
@query("log_spaced_order", BASE + """, n AS (SELECT cycle_id, count(*) AS n FROM d GROUP BY 1)
SELECT DISTINCT cycle_id, CAST(n - floor(CASE WHEN i = n - 1 THEN n WHEN i = 0 THEN 1 ELSE pow(n * 1e0, i / (n - 1e0)) + 1e-9 END) AS BIGINT) AS pos FROM n, unnest(range(0, n)) AS t(i) WHERE n > 1
UNION ALL SELECT cycle_id, 0 FROM n WHERE n = 1""")
def log_spaced_order(spark, sf):
    return _iterator(spark, sf, window_size=1, padding=True, last_point=False, shuffler=samples.AllShuffled(evenly_sampled=False)).batches(64).select("cycle_id", "pos")


# Profiles ------------------------------------------------------------------------------------------


_CELLS = BASE + """, x AS (SELECT cycle_id, pos, 'k' AS feature, CAST(k AS DOUBLE) AS x FROM d UNION ALL SELECT cycle_id, pos, 'value', value FROM d),
s AS (SELECT *, x - lag(x) OVER (PARTITION BY cycle_id, feature ORDER BY pos) AS step, rank() OVER (PARTITION BY cycle_id, feature ORDER BY x) + (count(*) OVER (PARTITION BY cycle_id, feature, x) - 1) / 2.0 AS rk FROM x)"""
_METRICS = {
    "std": "stddev_pop(x)", "autocorrelation": "sum(step * step) / count(*)", "monotonicity": "abs(sum(sign(step))) / greatest(count(*) - 1, 1)",
    "null": "avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END) * 100", "correlation": "CASE WHEN max(x) > min(x) THEN corr(rk, pos) END",
}
_FEATURES = ("k", "value")


@query("feature_metrics", _CELLS + " SELECT cycle_id, feature, " + ", ".join(f"{r(e)} AS \"{n}\"" for n, e in _METRICS.items()) + ", CAST(count(DISTINCT x) AS BIGINT) AS number_of_unique_elements FROM s GROUP BY 1, 2")
def feature_metrics(spark, sf):
    found = analysis.analyze(cycles(spark, sf), [*_METRICS, "number_of_unique_elements"], _FEATURES)
    return rounded(found.withColumn("number_of_unique_elements", F.col("number_of_unique_elements").cast("long")))


@query("spearman", _CELLS + f" SELECT cycle_id, feature, {r(_METRICS['correlation'])} AS correlation FROM s GROUP BY 1, 2")
def spearman(spark, sf):
    return rounded(analysis.analyze(cycles(spark, sf), ["correlation"], _FEATURES))


@query("monotonicity", _CELLS + f""" SELECT feature, {r('avg(m)')} AS monotonicity_mean, {r('stddev_pop(m)')} AS monotonicity_std, {r('max(m)')} AS monotonicity_max, {r('min(m)')} AS monotonicity_min
FROM (SELECT cycle_id, feature, {_METRICS['monotonicity']} AS m FROM s GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def monotonicity(spark, sf):
    return rounded(analysis.analyze_as_dataframe(cycles(spark, sf), ["monotonicity"], _FEATURES))


@query("entropy_and_information")
def entropy_and_information(spark, sf):
    return rounded(analysis.analyze(cycles(spark, sf), ["entropy", "mutual_information"], ["value"]))


_PAIRS = (("RUL", "k"), ("RUL", "value"), ("k", "value"))


def _pair(a: str, b: str) -> str:
    a, b = (f"CAST({'rul' if c == 'RUL' else c} AS DOUBLE)" for c in (a, b))
    return f"CASE WHEN max({a}) > min({a}) AND max({b}) > min({b}) THEN corr({a}, {b}) ELSE 0 END"


@query(
    "correlation_analysis",
    BASE + ", q AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {_pair(a, b)} AS c FROM d GROUP BY cycle_id" for a, b in _PAIRS) + f""")
SELECT feature_1, feature_2, {r('avg(c)')} AS mean_correlation, {r('stddev_samp(c)')} AS std_correlation, {r('max(c)')} AS max_correlation, {r('min(c)')} AS min_correlation,
{r('avg(abs(c))')} AS abs_mean_correlation, {r('stddev_samp(abs(c))')} AS std_abs_mean_correlation FROM q GROUP BY 1, 2""",
)
def correlation_analysis(spark, sf):
    return rounded(analysis.correlation_analysis(cycles(spark, sf), ["k", "value", "RUL"]))


def _units(spark, sf) -> CycleSet:
    """Whole units as cycles: every row of the table, and pairs of units in the result."""
    return CycleSet(raw_events(spark, sf), "user_id", ["ts", "event_id"], "k", ["value", "k"])


@query(
    "divergences",
    f"""WITH p AS (SELECT user_id AS cycle_id, value, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT min(value) AS a, max(value) AS b FROM p),
h AS (SELECT cycle_id, least(floor((value - a) / (b - a) * 5), 4) AS bin, n FROM p, g),
f AS (SELECT c.cycle_id, c.n, i.bin, count(h.bin) * 1e0 / c.n + 1e-50 AS v FROM (SELECT DISTINCT cycle_id, n FROM p) c CROSS JOIN (SELECT unnest(range(5)) AS bin) i LEFT JOIN h ON h.cycle_id = c.cycle_id AND h.bin = i.bin GROUP BY 1, 2, 3),
s AS (SELECT *, row_number() OVER (PARTITION BY cycle_id ORDER BY v) AS place FROM f),
k AS (SELECT x.cycle_id AS cycle_1, y.cycle_id AS cycle_2, x.n AS n1, y.n AS n2, avg(x.v * ln(x.v / y.v) - x.v + y.v) / 2 + avg(y.v * ln(y.v / x.v) - y.v + x.v) / 2 AS kl FROM f x JOIN f y ON x.bin = y.bin AND x.cycle_id < y.cycle_id GROUP BY 1, 2, 3, 4),
w AS (SELECT x.cycle_id AS cycle_1, y.cycle_id AS cycle_2, avg(abs(x.v - y.v)) AS wd FROM s x JOIN s y ON x.place = y.place AND x.cycle_id < y.cycle_id GROUP BY 1, 2)
SELECT 'value' AS feature, cycle_1, cycle_2, CAST(n1 AS BIGINT) AS cycle_1_length, CAST(n2 AS BIGINT) AS cycle_2_length, CAST(abs(n1 - n2) AS BIGINT) AS abs_length_difference, {r('wd')} AS wasserstein, {r('kl')} AS kl FROM k JOIN w USING (cycle_1, cycle_2)""",
)
def divergences(spark, sf):
    return rounded(analysis.features_divergences(_units(spark, sf), 5, ["value"]))


@query(
    "sample_rate",
    BASE + f""", s AS (SELECT cycle_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER wc) / 1e6 AS rate FROM d {WINDOWS}), m AS (SELECT *, quantile_cont(rate, 0.5) OVER (PARTITION BY cycle_id) AS md FROM s WHERE rate IS NOT NULL)
SELECT {r('avg(rate)', 3)} AS mean, {r('stddev_pop(rate)', 3)} AS std, {r('quantile_cont(rate, 0.5)', 3)} AS median, 's' AS unit FROM m WHERE rate <= md""",
)
def sample_rate(spark, sf):
    return rounded(analysis.sample_rate_summary(cycles(spark, sf), "ts", "s"), 3)


@query("durations_boxplot", BASE + f"SELECT {r('min(x)')} AS min, {r('quantile_cont(x, 0.25)')} AS q1, {r('quantile_cont(x, 0.5)')} AS median, {r('quantile_cont(x, 0.75)')} AS q3, {r('max(x)')} AS max FROM (SELECT max(rul) AS x FROM d GROUP BY cycle_id)")
def durations_boxplot(spark, sf):
    return rounded(analysis.durations_boxplot(cycles(spark, sf)))


@query(
    "durations_histogram",
    BASE + f""", l AS (SELECT max(rul) AS x FROM d GROUP BY cycle_id), g AS (SELECT min(x) AS a, max(x) AS b FROM l WHERE x < 500), o AS (SELECT avg(x) AS mean, quantile_cont(x, 0.5) AS median FROM l),
bn AS (SELECT CAST(least(floor((x - a) / ((b - a) / 8)), 7) AS INTEGER) AS bin, count(*) AS n FROM l, g WHERE x < 500 GROUP BY 1)
SELECT CAST(i.bin AS INTEGER) AS bin, {r('a + (b - a) / 8 * i.bin')} AS low, {r('a + (b - a) / 8 * (i.bin + 1)')} AS high, CAST(coalesce(bn.n, 0) AS BIGINT) AS n, {r('mean')} AS mean, {r('median')} AS median
FROM (SELECT unnest(range(8)) AS bin) i CROSS JOIN g CROSS JOIN o LEFT JOIN bn ON bn.bin = i.bin""",
)
def durations_histogram(spark, sf):
    return rounded(analysis.durations_histogram(cycles(spark, sf), 8, 500.0))


# Results -------------------------------------------------------------------------------------------


def predictions(spark, sf):
    """Two made-up models; a fold is a unit, whose rows are in time order."""
    own = cycles(spark, sf).df.withColumn("idx", F.row_number().over(_unit()).cast("long") - 1)
    rows = own.select(F.col("user_id").alias("fold"), "idx", F.col("RUL").alias("y_true"), "k")
    a = rows.withColumn("y_pred", F.col("y_true") * (0.8 + (F.col("k") % 5) * 0.1))
    b = rows.withColumn("y_pred", F.greatest(F.col("y_true") + (F.col("k") % 7) - 3, F.lit(0.0)))
    both = a.withColumn("model", F.lit("a")).unionByName(b.withColumn("model", F.lit("b")))
    return both.select("model", "fold", "idx", "y_true", "y_pred")


def _unit():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


_PREDICTED = BASE + """, z AS (SELECT 'a' AS model, CAST(u AS BIGINT) AS fold, o AS idx, rul AS y, rul * (0.8 + (k % 5) * 0.1) AS p FROM d
UNION ALL SELECT 'b', CAST(u AS BIGINT), o, rul, greatest(rul + (k % 7) - 3, 0) FROM d)"""
_LIVES = _PREDICTED + """, r1 AS (SELECT *, CASE WHEN y > lag(y) OVER (PARTITION BY model, fold ORDER BY idx) THEN 1 ELSE 0 END AS rose FROM z),
r2 AS (SELECT *, sum(rose) OVER (PARTITION BY model, fold ORDER BY idx) AS life FROM r1),
l AS (SELECT *, row_number() OVER (PARTITION BY model, fold, life ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY model, fold, life) AS n FROM r2)"""
# The decrements are positive from the start on unless the first rows repeat; time is read at the mirrored row.
_TIMED = _LIVES + """, t1 AS (SELECT *, coalesce(min(CASE WHEN nx <> y THEN pos END) OVER (PARTITION BY model, fold, life), n - 1) AS start
  FROM (SELECT *, lead(y) OVER (PARTITION BY model, fold, life ORDER BY pos) AS nx FROM l WHERE n > 1)),
t2 AS (SELECT *, CASE WHEN pos > start THEN lag(y) OVER (PARTITION BY model, fold, life ORDER BY pos) - y END AS step FROM t1),
t3 AS (SELECT *, CASE WHEN start > 0 THEN coalesce(quantile_cont(step, 0.5) OVER (PARTITION BY model, fold, life), 1) ELSE 0 END AS md FROM t2),
t AS (SELECT a.*, a.md * (CASE WHEN a.start > 0 THEN least(a.pos, a.start) + 1 ELSE 0 END) + CASE WHEN a.pos > a.start THEN b.y - c.y ELSE 0 END AS time
  FROM t3 a LEFT JOIN t3 b ON a.model = b.model AND a.fold = b.fold AND a.life = b.life AND b.pos = a.n - 1 + a.start - a.pos
  JOIN t3 c ON a.model = c.model AND a.fold = c.fold AND a.life = c.life AND c.pos = c.n - 1),
e AS (SELECT model, fold, life, coalesce(min_by(time, pos) FILTER (p = 0), max_by(time + p, pos)) AS pe, coalesce(min_by(time, pos) FILTER (y = 0), max_by(time + y, pos)) AS te,
  sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, regr_slope(p, time) AS slope_pred, regr_slope(y, time) AS slope_true, count(*) AS n FROM t GROUP BY 1, 2, 3)"""
# A CTE of this name is in BASE already.
_TIMED = _TIMED.replace("\ne AS (SELECT model", "\nlv AS (SELECT model")


@query("split_lives", _LIVES + " SELECT model, fold, idx, CAST(life AS BIGINT) AS life, CAST(pos AS BIGINT) AS pos FROM l WHERE n > 1")
def split_lives(spark, sf):
    return results.split_lives(predictions(spark, sf)).select("model", "fold", "idx", "life", "pos")


@query("fitted_lives", _TIMED + f""" SELECT model, fold, CAST(life AS BIGINT) AS life, CAST(n AS BIGINT) AS n_rows, {r('rmse', 4)} AS rmse, {r('mae', 4)} AS mae, {r('pe', 4)} AS predicted_end_of_life, {r('te', 4)} AS end_of_life,
{r('slope_pred', 4)} AS slope_pred, {r('slope_true', 4)} AS slope_true FROM lv""")  # fmt: skip
def fitted_lives(spark, sf):
    found = results.lives_of(predictions(spark, sf)).select("model", "fold", "life", "n_rows", "rmse", "mae", "predicted_end_of_life", "end_of_life", "slope_pred", "slope_true")
    return rounded(found, 4)


@query("life_shape", _TIMED + f""", q AS (SELECT model, fold, life, regr_slope(p, time) AS a, regr_intercept(p, time) AS b, regr_slope(y, time) AS c FROM t GROUP BY 1, 2, 3)
SELECT model, fold, CAST(life AS BIGINT) AS life, {r('avg(abs(p - a * time - b))', 4)} AS noisiness, {r('1 - abs(atan((c - a) / nullif(1 + c * a, 0)) / pow(pi() / 2, 2))', 4)} AS slope_resemblance
FROM t JOIN q USING (model, fold, life) GROUP BY model, fold, life, a, b, c""")
def life_shape(spark, sf):
    return rounded(results.lives_of(predictions(spark, sf)).select("model", "fold", "life", "noisiness", "slope_resemblance"), 4)


@query("piecewise_lines")
def piecewise_lines(spark, sf):
    timed = results.with_time(results.split_lives(predictions(spark, sf)))
    return rounded(results.lines_of_lives(timed).select("model", "fold", "life", F.size("pieces").alias("n_pieces"), F.array_max("pieces")["t2"].alias("last"), "root"), 4)


_SWEEP = _TIMED + ", m AS (SELECT unnest(range(5)) * 12.0 AS m)"


@query("unexpected_breaks", _SWEEP + f""" SELECT model, {r('m')} AS "window", {r('avg(b)')} AS breaks_mean, {r('stddev_pop(b)')} AS breaks_std FROM (SELECT model, m, CASE WHEN pe - m < te THEN 0 ELSE 1 END AS b FROM lv, m) GROUP BY 1, 2""")
def unexpected_breaks(spark, sf):
    return rounded(results.unexpected_breaks(results.lives_of(predictions(spark, sf)), 48.0, 5))


@query("unexploited_lifetime", _SWEEP + f""" SELECT model, {r('m')} AS "window", {r('avg(v)')} AS unexploited_mean, {r('stddev_pop(v)')} AS unexploited_std FROM (SELECT model, m, greatest(te - (pe - m), 0) AS v FROM lv, m) GROUP BY 1, 2""")
def unexploited_lifetime(spark, sf):
    return rounded(results.unexploited_lifetime(results.lives_of(predictions(spark, sf)), 48.0, 5))


@query("metric_j", _SWEEP + f""" SELECT model, {r('m')} AS "window", {r('avg(j)')} AS j FROM (SELECT model, fold, m, avg(b) / (max(b) + 1e-10) * 0.4 + avg(v) / (max(v) + 1e-10) * 0.6 AS j
FROM (SELECT model, fold, m, CASE WHEN pe - m < te THEN 0 ELSE 1 END AS b, greatest(te - (pe - m), 0) AS v FROM lv, m) GROUP BY 1, 2, 3) GROUP BY 1, 2""")  # fmt: skip
def metric_j(spark, sf):
    return rounded(results.metric_j(results.lives_of(predictions(spark, sf)), 48.0, 5, 0.4, 0.6))


@query("j_cost", _SWEEP + f""", q AS (SELECT model, m, avg(b) AS b, stddev_pop(b) AS bs, avg(v) AS v, stddev_pop(v) AS vs FROM (SELECT model, m, CASE WHEN pe - m < te THEN 0 ELSE 1 END AS b, greatest(te - (pe - m), 0) AS v FROM lv, m) GROUP BY 1, 2)
SELECT model, {r('x')} AS ratio, {r('avg(b + x * v)')} AS cost, {r('sqrt(sum(bs * bs + x * x * vs * vs)) / count(*)')} AS cost_std FROM q, (SELECT unnest([0.01, 0.1]) AS x) GROUP BY 1, x""")  # fmt: skip
def j_cost(spark, sf):
    return rounded(results.j_cost(results.lives_of(predictions(spark, sf)), 48.0, 5, [0.01, 0.1]))


_W = "abs(y - p) / greatest(y, 0.9)"
_REGRESSION = {
    "mae": "avg(abs(y - p))", "mae_sw": f"sum({_W} * abs(y - p)) / nullif(sum({_W}), 0)", "mse": "avg((y - p) * (y - p))",
    "mse_sw": f"sum({_W} * (y - p) * (y - p)) / nullif(sum({_W}), 0)", "mape": "avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))",
}


@query("cv_metrics", _PREDICTED + " SELECT model, " + ", ".join(f"{r(f'avg({n})', 4)} AS {n}_mean, {r(f'stddev_pop({n})', 4)} AS {n}_std" for n in list(_REGRESSION)[:4])
       + " FROM (SELECT model, fold, " + ", ".join(f"{e} AS {n}" for n, e in _REGRESSION.items()) + " FROM z WHERE y <= 100 GROUP BY 1, 2 HAVING max(p) > min(p)) GROUP BY 1")
def cv_metrics(spark, sf):
    return rounded(results.regression_metrics(predictions(spark, sf), 100.0, digits=None).drop("mape_mean", "mape_std"), 4)


@query("cv_bins", _PREDICTED + f""", g AS (SELECT max(y) AS m FROM z), b AS (SELECT i AS bin, m * i / 4 AS lo, m * (i + 1) / 4 AS hi FROM g, (SELECT unnest(range(4)) AS i)),
f AS (SELECT DISTINCT model, fold FROM z)
SELECT f.model, f.fold, CAST(b.bin AS INTEGER) AS bin, {r('max(lo)')} AS low, {r('max(hi)')} AS high, {r('coalesce(avg(y - p), 0)')} AS mean_error, {r('coalesce(avg(abs(y - p)), 0)')} AS mae, {r('coalesce(avg((y - p) * (y - p)), 0)')} AS mse
FROM f CROSS JOIN b LEFT JOIN z ON z.model = f.model AND z.fold = f.fold AND z.y >= b.lo AND z.y <= b.hi GROUP BY 1, 2, 3""")  # fmt: skip
def cv_bins(spark, sf):
    return rounded(results.errors_by_rul(predictions(spark, sf), 4))


@query("losses", _PREDICTED + f""" SELECT model, {r('sqrt(avg((y - p) * (y - p)))', 3)} AS rmse, {r(f'avg({_W} * abs(y - p))', 3)} AS relative_mae, {r(f'avg({_W} * (y - p) * (y - p))', 3)} AS relative_mse,
{r('avg(CASE WHEN y - p < -5 THEN 0.1 * 5 * (5 + 2 * 50 * (exp((p - y - 5) / 50) - 1)) WHEN y - p < 0 THEN 0.1 * (y - p) * (y - p) WHEN y - p > 10 THEN 0.05 * 10 * (10 + 2 * 80 * (exp((y - p - 10) / 80) - 1)) ELSE 0.05 * (y - p) * (y - p) END)', 3)} AS asymmetric
FROM z GROUP BY 1""")  # fmt: skip
def losses(spark, sf):
    y, p = F.col("y_true"), F.col("y_pred")
    found = predictions(spark, sf).groupBy("model").agg(
        results.root_mean_squared_error(y, p).alias("rmse"), results.relative_mae(y, p).alias("relative_mae"), results.relative_mse(y, p).alias("relative_mse"),
        results.asymmetric_loss(y, p, (5, 0.1, 50), (10, 0.05, 80), relative=False).alias("asymmetric"),
    )
    return rounded(found, 3)


@query("weibull", "SELECT CAST(i AS BIGINT) AS id, " + f"{r('i * pow(ln(2), 1 / (1 + i / 10.0))', 5)} AS median, {r('i * exp(lgamma(1 + 1 / (1 + i / 10.0)))', 5)} AS mean, {r('i * pow(-ln(0.1), 1 / (1 + i / 10.0))', 5)} AS quantile FROM (SELECT unnest(range(1, 40)) AS i)")
def weibull(spark, sf):
    rows = spark.range(1, 40)
    found = results.weibull(F.col("id").cast("double"), 1 + F.col("id") / 10.0, 0.9)
    return rounded(rows.select("id", *(found[n].alias(n) for n in ("median", "mean", "quantile"))), 5)


_KL = "ln((1 + i / 10.0) / pow(i, 1 + i / 10.0)) - ln(2 / 400e0) + (i / 10.0 - 1) * (ln(i) - 0.5772 / (1 + i / 10.0)) + pow(i / 20e0, 2) * exp(lgamma(2 / (1 + i / 10.0) + 1)) - 1"


@query("weibull_shape", "SELECT CAST(i AS BIGINT) AS id, " + f"""{r('i * pow((i / 10.0) / (1 + i / 10.0), 1 / (1 + i / 10.0))', 5)} AS mode, {r('i * i * (exp(lgamma(1 + 2 / (1 + i / 10.0))) - pow(exp(lgamma(1 + 1 / (1 + i / 10.0))), 2))', 4)} AS variance,
{r('ln((1 + i / 10.0) / i) + i / 10.0 * ln(7e0 / i) - pow(7e0 / i, 1 + i / 10.0)', 4)} AS log_likelihood, {r(_KL, 4)} AS divergence FROM (SELECT unnest(range(1, 40)) AS i)""")
def weibull_shape(spark, sf):
    scale, shape = F.col("id").cast("double"), 1 + F.col("id") / 10.0
    found = results.weibull(scale, shape)
    of = {"mode": found["mode"], "variance": found["variance"], "log_likelihood": results.weibull_log_likelihood(F.lit(7.0), scale, shape), "divergence": results.weibull_divergence(scale, shape, F.lit(20.0), F.lit(2.0))}
    rows = spark.range(1, 40).select("id", *(c.alias(n) for n, c in of.items()))
    return rounded(rounded(rows.select("id", "mode"), 5).join(rounded(rows.drop("mode"), 4), "id"), 5)


@query("baseline_model", BASE + f""", v AS (SELECT avg(x) AS v FROM (SELECT max(rul) AS x FROM d GROUP BY cycle_id))
SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('rul')} AS y_true, {r('least(greatest(v - (m.rul2 - 0), 0), v)')} AS y_pred
FROM (SELECT a.cycle_id, a.pos, a.rul, b.rul AS rul2 FROM (SELECT *, count(*) OVER whole AS n FROM d {WINDOWS}) a JOIN d b ON a.cycle_id = b.cycle_id AND b.pos = a.n - 1 - a.pos) m, v""")  # fmt: skip
def baseline_model(spark, sf):
    own = cycles(spark, sf)
    return rounded(models.BaselineModel("mean").fit(own).predict(own).select("cycle_id", "pos", "y_true", "y_pred"))


class _MeanOfWindow:
    """Fits nothing: the mean of a window of two features, the second halved."""

    def partial_fit(self, x, y):
        return self

    def predict(self, x):
        cells = x.astype(float).reshape(len(x), -1, 2)
        return cells[:, :, 0].mean(axis=1) + cells[:, :, 1].mean(axis=1) / 2


@query(
    "window_model_object",
    BASE + f"""SELECT d.cycle_id, CAST(d.pos AS BIGINT) AS pos, {r('max(CAST(CAST(d.rul AS FLOAT) AS DOUBLE))', 2)} AS y_true,
{r('avg(CAST(CAST(x.value AS FLOAT) AS DOUBLE)) + avg(x.k) / 2', 2)} AS y_pred
FROM d JOIN d x ON x.cycle_id = d.cycle_id AND x.pos BETWEEN d.pos - 2 AND d.pos WHERE d.pos >= 2 GROUP BY 1, 2""",
)
def window_model_object(spark, sf):
    return rounded(models.predict_batch(_MeanOfWindow(), _iterator(spark, sf, window_size=3)), 2)


@query("window_regression")
def window_regression(spark, sf):
    """Windows into a ridge regression; the model's predictions."""
    frame = sensors(spark, sf, ("value", "k", "RUL"))
    scaled = op.MinMaxScaler((0, 1)).fit_transform(frame.select(["value", "k"]))
    own = samples.WindowedDatasetIterator(scaled, frame.select(["RUL"]), 4)
    return rounded(models.predict(models.train_model(LinearRegression(regParam=0.1), own), own), 4)


# Joins ---------------------------------------------------------------------------------------------


@query("asof_next_error", """SELECT e.event_id, CAST(f.k AS BIGINT) AS next_k FROM (SELECT * FROM events) e ASOF LEFT JOIN
(SELECT user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error') f ON e.user_id = f.user_id AND e.ts <= f.ts""")  # fmt: skip
def asof_next_error(spark, sf):
    events = raw_events(spark, sf)
    errors = events.filter("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("k").alias("next_k"))
    return asof_forward(events, errors, ("ts", "error_ts"), ["user_id"], ["next_k"]).select("event_id", "next_k")


@query("category_ranges", f"""SELECT l_returnflag, {r('min(l_quantity)')} AS low, {r('max(l_quantity)')} AS high, {r('quantile_cont(l_extendedprice, 0.5)')} AS median, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def category_ranges(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rounded(rows.groupBy("l_returnflag").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.percentile("l_extendedprice", F.lit(0.5)).alias("median"), F.count("*").alias("n")))
