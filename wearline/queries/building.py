"""Splitting, labelling, metadata, rows and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline import operators as op
from wearline.queries.common import BASE, WINDOWS, builder, cycles, query, r, raw_events, rounded, sensors
from wearline.sources import (
    CycleRULColumn,
    FailureDataCycleSplitter,
    IncreasingFeatureCycleSplitter,
    LifeIdCycleSplitter,
    NumberOfRowsRULColumn,
    catalog,
)


@query("split_life_end", BASE + "SELECT cycle_id, CAST(pos AS BIGINT) AS pos, event_id FROM d")
def split_life_end(spark, sf):
    return cycles(spark, sf).df.select("cycle_id", "pos", "event_id")


_UNITS = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS u, event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o FROM events)
"""


@query(
    "split_increasing",
    _UNITS + """, f AS (SELECT *, CASE WHEN k < lag(k) OVER (PARTITION BY u ORDER BY o) THEN 1 ELSE 0 END AS fell FROM e),
c AS (SELECT *, sum(fell) OVER (PARTITION BY u ORDER BY o) AS cyc FROM f)
SELECT 'Cycle_1:' || u || '_' || CAST(cyc + 1 AS BIGINT) AS cycle_id, CAST(row_number() OVER (PARTITION BY u, cyc ORDER BY o) - 1 AS BIGINT) AS pos, event_id FROM c""",
)
def split_increasing(spark, sf):
    found = builder().set_splitting_method(IncreasingFeatureCycleSplitter("k")).cycles(raw_events(spark, sf))
    return found.df.select("cycle_id", "pos", "event_id")


@query(
    "split_life_id",
    _UNITS + """, f AS (SELECT *, min(o) OVER (PARTITION BY u, event_type) AS first FROM e), c AS (SELECT *, dense_rank() OVER (PARTITION BY u ORDER BY first) AS cyc FROM f)
SELECT 'Cycle_1:' || u || '_' || cyc AS cycle_id, CAST(row_number() OVER (PARTITION BY u, cyc ORDER BY o) - 1 AS BIGINT) AS pos, event_id FROM c""",
)
def split_life_id(spark, sf):
    found = builder().set_splitting_method(LifeIdCycleSplitter("event_type")).cycles(raw_events(spark, sf))
    return found.df.select("cycle_id", "pos", "event_id")


def _pairs(spark, sf):
    events = raw_events(spark, sf)
    data = events.filter("event_type != 'error'").select("user_id", "ts", "event_id", "value")
    faults = events.filter("event_type = 'error'").select("user_id", F.col("ts").alias("fault_ts"), F.col("k").alias("fault_k"))
    return data, faults


@query(
    "split_fault_asof",
    """WITH s AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'error'),
f AS (SELECT user_id, ts AS fault_ts, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS fault_k, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS cyc FROM events WHERE event_type = 'error' GROUP BY user_id, ts),
j AS (SELECT s.user_id, s.ts, s.event_id, f.fault_ts, f.fault_k, f.cyc FROM s ASOF JOIN f ON s.user_id = f.user_id AND s.ts <= f.fault_ts)
SELECT 'Cycle_1:' || user_id || '_' || cyc AS cycle_id, CAST(row_number() OVER (PARTITION BY user_id, cyc ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, event_id, fault_k,
  CAST(count(*) OVER (PARTITION BY user_id, cyc) - row_number() OVER (PARTITION BY user_id, cyc ORDER BY ts, event_id) AS BIGINT) AS "RUL" FROM j""",
)
def split_fault_asof(spark, sf):
    made = builder().set_splitting_method(FailureDataCycleSplitter("ts", "fault_ts")).set_rul_column_method(NumberOfRowsRULColumn())
    return made.pair_cycles([_pairs(spark, sf)]).df.select("cycle_id", "pos", "event_id", "fault_k", "RUL")


@query("rul_rows", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, CAST(count(*) OVER whole - 1 - pos AS BIGINT) AS \"RUL\" FROM d {WINDOWS}")
def rul_rows(spark, sf):
    return builder().set_rul_column_method(NumberOfRowsRULColumn()).cycles(raw_events(spark, sf)).df.select("cycle_id", "pos", "RUL")


@query("rul_cycle", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, max(k) OVER whole - k AS \"RUL\" FROM d {WINDOWS}")
def rul_cycle(spark, sf):
    return builder().set_rul_column_method(CycleRULColumn("k")).cycles(raw_events(spark, sf)).df.select("cycle_id", "pos", "RUL")


@query("rul_datetime", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('rul')} AS \"RUL\" FROM d")
def rul_datetime(spark, sf):
    return rounded(cycles(spark, sf).df.select("cycle_id", "pos", "RUL"))


@query(
    "cycle_metadata",
    BASE + f"SELECT cycle_id, CAST(count(*) AS BIGINT) AS n_samples, {r('max(rul)')} AS duration, min_by(event_type, pos) AS first_event FROM d GROUP BY cycle_id",
)
def cycle_metadata(spark, sf):
    return rounded(cycles(spark, sf).metadata({"first_event": "event_type"}))


@query("dataset_sizes", BASE + f"SELECT CAST(count(DISTINCT cycle_id) AS BIGINT) AS n_cycles, CAST(count(*) AS BIGINT) AS n_samples, {r('max(rul)')} AS longest FROM d")
def dataset_sizes(spark, sf):
    own = cycles(spark, sf)
    return rounded(own.df.agg(F.countDistinct("cycle_id").alias("n_cycles"), F.count("*").alias("n_samples"), F.max("RUL").alias("longest")))


@query("subsampled_rows", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('value')} AS value FROM d WHERE pos % 4 = 0")
def subsampled_rows(spark, sf):
    return rounded(cycles(spark, sf).sampled(subsample_proportion=0.25).select("cycle_id", "pos", "value"))


@query("slice_rows", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('value')} AS value FROM (SELECT *, count(*) OVER whole AS n FROM d {WINDOWS}) WHERE pos >= 1 AND pos < greatest(n - 2, 0)")
def slice_rows(spark, sf):
    return rounded(op.SliceRows(op.RelativeToStart(1), op.RelativeToEnd(2)).transform(sensors(spark, sf)).df)


@query("select_by_name", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, k, {r('value')} AS value FROM d")
def select_by_name(spark, sf):
    return rounded(op.ByNameFeatureSelector(["k", "value", "absent"]).transform(cycles(spark, sf).frame()).df)


@query("discard_and_match", BASE + "SELECT cycle_id, CAST(pos AS BIGINT) AS pos, event_id FROM d")
def discard_and_match(spark, sf):
    return op.MatchFeatureSelector("event").transform(op.DiscardByNameFeatureSelector(["event_type"]).transform(cycles(spark, sf).frame())).df


@query("select_by_type", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, event_id, k, {r('value')} AS value, {r('rul')} AS \"RUL\" FROM d")
def select_by_type(spark, sf):
    return rounded(op.ByTypeFeatureSelector("number").transform(cycles(spark, sf).frame(["event_id", "ts", "event_type", "value", "k", "RUL"])).df)


@query("position_features", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('value')} AS value, k, event_id FROM d")
def position_features(spark, sf):
    return rounded(op.PositionFeatures({"event_id": 2}).transform(sensors(spark, sf, ("event_id", "k", "value"))).df)


@query("variance_threshold", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, k, {r('value')} AS value FROM d")
def variance_threshold(spark, sf):
    frame = sensors(spark, sf, ("k", "value"))
    wide = frame.compute({"still": F.lit(1.0)}, keep=True)
    return rounded(op.PandasVarianceThreshold(0.5, per_cycle=False).fit_transform(wide).df)


@query("null_proportion", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('value')} AS value FROM d")
def null_proportion(spark, sf):
    frame = sensors(spark, sf)
    wide = frame.compute({"holes": F.when(F.col("event_id") % 2 == 0, frame.col("value"))}, keep=True)
    return rounded(op.NullProportionSelector(0.2, per_cycle=False).fit_transform(wide).df)


@query("filter_category", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('value')} AS value FROM d WHERE event_type = 'click'")
def filter_category(spark, sf):
    return rounded(op.Filter(["click"], ["event_type"]).transform(sensors(spark, sf, ("event_type", "value"))).df)


@query("cast_to", BASE + "SELECT cycle_id, CAST(pos AS BIGINT) AS pos, CAST(trunc(value) AS BIGINT) AS value, CAST(k AS BIGINT) AS k FROM d")
def cast_to(spark, sf):
    return op.CastTo("int64").transform(sensors(spark, sf, ("value", "k"))).df


@query("to_datetime", BASE + "SELECT cycle_id, CAST(pos AS BIGINT) AS pos, CAST(epoch_us(to_timestamp(k)) AS BIGINT) AS micros FROM d")
def to_datetime(spark, sf):
    found = op.ToDateTime("s", columns=["k"]).transform(sensors(spark, sf, ("k",))).df
    return found.select("cycle_id", "pos", F.unix_micros("k").alias("micros"))


@query("subsample", BASE + f"SELECT cycle_id, CAST(pos AS BIGINT) AS pos, {r('value')} AS value FROM d WHERE pos % 3 = 0")
def subsample(spark, sf):
    return rounded(op.Subsample(3).transform(sensors(spark, sf)).df)


@query(
    "index_mean_resample",
    BASE + f"""SELECT cycle_id, CAST(row_number() OVER (PARTITION BY cycle_id ORDER BY b) - 1 AS BIGINT) AS pos, CAST(epoch_us(b) AS BIGINT) AS bin, {r('v')} AS value
FROM (SELECT cycle_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS b, avg(value) AS v FROM d GROUP BY 1, 2)""",
)
def index_mean_resample(spark, sf):
    found = op.IndexMeanResampler("6 hours", "ts").transform(sensors(spark, sf, ("ts", "value"))).df
    return rounded(found.select("cycle_id", "pos", F.unix_micros("ts").alias("bin"), "value"))


@query(
    "subsampler",
    BASE + f"""SELECT cycle_id, CAST(row_number() OVER (PARTITION BY cycle_id ORDER BY p) - 1 AS BIGINT) AS pos, {r('v')} AS value
FROM (SELECT cycle_id, floor(k / 20) AS b, avg(value) AS v, min(pos) AS p FROM d GROUP BY 1, 2)""",
)
def subsampler(spark, sf):
    return rounded(op.SubsamplerTransformer("k", 20).transform(sensors(spark, sf, ("k", "value"))).df)


@query(
    "integer_resample",
    BASE + f""", g AS (SELECT cycle_id, unnest(range(CAST(max(pos) AS BIGINT) * 2)) AS i, count(*) AS n FROM d GROUP BY cycle_id),
t AS (SELECT cycle_id, i, i * 0.5 AS x FROM g)
SELECT t.cycle_id, CAST(t.i AS BIGINT) AS pos, {r('a.value + (coalesce(b.value, a.value) - a.value) * (t.x - floor(t.x))')} AS value
FROM t JOIN d a ON a.cycle_id = t.cycle_id AND a.pos = floor(t.x) LEFT JOIN d b ON b.cycle_id = t.cycle_id AND b.pos = floor(t.x) + 1""",
)
def integer_resample(spark, sf):
    frame = sensors(spark, sf)
    with_time = frame.compute({"t": F.col("pos").cast("double")}, keep=True)
    return rounded(op.IntegerIndexResamplerTransformer("t", 0.5).transform(with_time).df)


@query("mean_of_blocks", BASE + f"SELECT cycle_id, CAST(floor(pos / 4) AS BIGINT) AS pos, {r('avg(value)')} AS value FROM d GROUP BY 1, 2")
def mean_of_blocks(spark, sf):
    return rounded(op.apply_rolling_data(sensors(spark, sf), F.avg, 4).df)




@query(
    "rolling_data_steps",
    BASE + f""", f AS (SELECT *, CAST(greatest(floor((n - 4) / 2.0) + 1, 0) AS BIGINT) AS whole FROM (SELECT *, count(*) OVER whole AS n FROM d {WINDOWS}))
SELECT cycle_id, CAST(w AS BIGINT) AS pos, {r('max(value)')} AS value FROM f, unnest(range(0, n + 1)) AS t(w)
WHERE (w < whole AND pos BETWEEN 2 * w AND 2 * w + 3) OR (w = whole AND pos >= 4 * whole) GROUP BY 1, 2""",
)
def rolling_data_steps(spark, sf):
    return rounded(op.apply_rolling_data(sensors(spark, sf), F.max, 4, step=2).df)


@query("rul_of_train", "SELECT l_orderkey AS unit, CAST(l_linenumber AS INTEGER) AS cycle, CAST(max(l_linenumber) OVER (PARTITION BY l_orderkey) - l_linenumber AS INTEGER) AS rul FROM lineitem")
def rul_of_train(spark, sf):
    found = catalog.rul_of_train(_turbines(spark, sf))
    return found.select(F.col("UnitNumber").alias("unit"), F.col("Cycle").alias("cycle"), F.col("RUL").cast("int").alias("rul"))


@query(
    "rul_of_test",
    "SELECT l_orderkey AS unit, CAST(l_linenumber AS INTEGER) AS cycle, CAST(max(l_linenumber) OVER (PARTITION BY l_orderkey) + o_custkey % 50 - l_linenumber AS BIGINT) AS rul FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
)
def rul_of_test(spark, sf):
    truth = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("UnitNumber"), (F.col("o_custkey") % 50).alias("truth"))
    found = catalog.rul_of_test(_turbines(spark, sf), truth)
    return found.select(F.col("UnitNumber").alias("unit"), F.col("Cycle").alias("cycle"), F.col("RUL").cast("long").alias("rul"))


def _turbines(spark, sf):
    """Order lines as the runs of units: a unit's cycles are numbered."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("UnitNumber"), F.col("l_linenumber").cast("int").alias("Cycle"))


@query("sum_of_other_rows", BASE + f"""SELECT coalesce(a.cycle_id, b.cycle_id) AS cycle_id, CAST(coalesce(a.pos, b.pos) AS BIGINT) AS pos, {r('coalesce(a.value, 0) + coalesce(b.value, 0)')} AS value
FROM (SELECT cycle_id, pos, value FROM d WHERE event_type <> 'click') a FULL JOIN (SELECT cycle_id, pos, value * value AS value FROM d WHERE k % 2 = 0) b ON a.cycle_id = b.cycle_id AND a.pos = b.pos""")
def sum_of_other_rows(spark, sf):
    """Branches with rows of their own meet in a full join."""
    frame = sensors(spark, sf, ("event_type", "value", "k"))
    one = frame.where(frame.col("event_type") != "click").select(["value"])
    two = op.Square().transform(frame.where(frame.col("k") % 2 == 0).select(["value"]))
    return rounded(op.Sum().transform(one, two).df)
