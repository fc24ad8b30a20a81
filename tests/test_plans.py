"""Native forms against the definitions they replace, and numbering across partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline import operators as op
from wearline.frame import from_cycles, numbered
from wearline.functions import kernels
from wearline.plans.graph import make_pipeline


def series(frame, name="a"):
    rows = frame.df.select("cycle_id", "pos", name).toPandas().sort_values(["cycle_id", "pos"])
    return {c: g[name].astype(float).to_numpy() for c, g in rows.groupby("cycle_id")}


@pytest.mark.parametrize("span", [1, 1.05, 1.5, 5, 40])
def test_ewma_is_that_of_pandas(spark, span):
    random = np.random.RandomState(3)
    cycles = [pd.DataFrame({"a": np.where(random.rand(n) < holes, np.nan, random.standard_normal(n) * 10.0 ** random.randint(0, 6)), "RUL": 0.0}) for n, holes in ((1, 0), (7, 0.5), (3000, 0.2), (900, 0.9), (4, 1))]
    found = series(op.EWMAFilter(span).transform(from_cycles(spark, cycles).frame(["a"])))
    for i, c in enumerate(cycles):
        assert np.allclose(found[i], c["a"].ewm(span=span, ignore_na=True).mean(), rtol=1e-9, atol=1e-9, equal_nan=True), i


@pytest.mark.parametrize(("window", "order"), [(3, 1), (5, 2), (9, 4), (33, 2)])
def test_savitzky_golay_is_that_of_the_kernel(spark, window, order):
    random = np.random.RandomState(4)
    cycles = [pd.DataFrame({"a": random.standard_normal(n), "RUL": 0.0}) for n in (1, window - 1, window, window + 1, 2 * window, 70)]
    found = series(op.SavitzkyGolayTransformer(window, order).transform(from_cycles(spark, cycles).frame(["a"])))
    for i, c in enumerate(cycles):
        assert np.allclose(found[i], kernels.savitzky_golay(c["a"].to_numpy(), window, order)), i


@pytest.mark.parametrize("add_default", [True, False])
def test_split_at_once_is_split_branch_by_branch(spark, add_default):
    random = np.random.RandomState(5)
    cycles = from_cycles(spark, [pd.DataFrame({"c": random.choice(["x", "y", None], 40), "a": random.standard_normal(40), "RUL": 0.0}) for _ in range(3)])
    frame = cycles.frame(["c", "a"])
    at_once = op.SplitByCategory("c", lambda: op.MeanCentering(), add_default)
    branched = op.SplitByCategory("c", lambda: make_pipeline(op.MeanCentering(), op.Scale(1.0)), add_default)
    one, two = at_once.fit(frame).transform(frame), branched.fit(frame).transform(frame)
    assert at_once.params == branched.params
    key = lambda f: sorted((r["cycle_id"], r["pos"], round(r["a"], 9)) for r in f.df.collect())
    assert key(one) == key(two) and "Join" not in one.df._jdf.queryExecution().optimizedPlan().toString()


def test_kernels_move_nothing_twice(spark):
    """Rows that a window has brought together go to a kernel as they are, in one exchange; groups of any size come whole."""
    lengths = [1, 3, 5000, 1, 2, 30_000, 4]
    cycles = from_cycles(spark, [pd.DataFrame({"a": np.arange(n, dtype=float), "s": "text", "RUL": 0.0}) for n in lengths])
    frame = cycles.frame(["a", "s"])
    frame = frame.compute({"b": F.avg(frame.col("a")).over(frame.expanding)}, keep=True)
    seen = frame.kernel({"n": "long", "first": "double"}, lambda part: pd.DataFrame({"n": len(part), "first": part["a"].iloc[0]}, index=part.index), ["a"], keep=True)
    rows = seen.df.groupBy("cycle_id").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("rows"), F.max("first").alias("first"), F.min("s").alias("s")).collect()
    assert {r["cycle_id"]: (r["low"], r["high"], r["rows"], r["first"], r["s"]) for r in rows} == {i: (n, n, n, 0.0, "text") for i, n in enumerate(lengths)}
    plan = seen.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    found = numbered(df, [F.col("v").desc()], "place").collect()
    assert sorted((r["place"], r["v"]) for r in found) == [(i, 999 - i) for i in range(1000)]


def test_cycles_by_place(spark):
    cycles = from_cycles(spark, [pd.DataFrame({"a": [float(i)] * (i + 1), "RUL": 0.0}) for i in range(6)])
    assert [cycles[i].count() for i in (0, 3, -1)] == [1, 4, 6]
    assert cycles[1:5:2].ids == [1, 3] and cycles[[5, -6]].ids == [5, 0]
    with pytest.raises(IndexError):
        cycles[6]


def test_lines_of_lives_are_those_of_each_life(spark):
    from wearline import results
    from wearline.queries.evaluation import predictions

    timed = results.with_time(results.split_lives(predictions(spark, "/root/testdata/sf0.001")))
    rows = timed.toPandas().sort_values(["model", "fold", "life", "pos"])
    found = {(r["model"], r["fold"], r["life"]): r for r in results.lines_of_lives(timed).collect()}
    lives = dict(tuple(rows.groupby(["model", "fold", "life"])))
    assert set(found) == set(lives)
    for key, part in lives.items():
        line = kernels.PiecewiseLinearRegression(True)
        for t, y in zip(part["time"], part["y_pred"], strict=True):
            line.add_point(t, y)
        whole = line.finish()
        assert len(found[key]["pieces"]) == len(whole) and np.isclose(found[key]["root"], whole.root(), equal_nan=True)


@pytest.mark.parametrize(("size", "window", "step"), [(10, 3, 2), (10, 3, 1), (10, 3, 3), (2, 3, 1), (10, 2, 5), (7, 7, 2)])
def test_rolling_data_as_defined(spark, size, window, step):
    x = np.random.RandomState(size).standard_normal(size)
    whole = max((size - window) // step + 1, 0)
    parts = [x[i * step : i * step + window] for i in range(whole)] + ([x[whole * window :]] if whole * window < size else [])
    if step == window:
        parts = [x[i : i + window] for i in range(0, size, window)]
    found = op.apply_rolling_data(from_cycles(spark, [pd.DataFrame({"a": x, "RUL": 0.0})]).frame(["a"]), F.sum, window, step=step)
    assert np.allclose(series(found)[0], [p.sum() for p in parts])


def test_sets_of_one_file_a_cycle(spark, tmp_path):
    from wearline.sources import load_cycle_files

    folder = tmp_path / "processed" / "cycles"
    folder.mkdir(parents=True)
    frames = [pd.DataFrame({"a": np.arange(float(n)), "s": [f"x{i}" for i in range(n)], "RUL": np.arange(float(n))[::-1]}) for n in (3, 5, 4, 2)]
    frames[0].to_csv(folder / "one.csv", index=False)
    frames[1].to_parquet(folder / "two.parquet")
    frames[2].to_feather(folder / "three.feather")
    frames[3].drop(columns="s").to_pickle(folder / "four.pkl")
    names = ["one.csv", "two.parquet", "three.feather", "four.pkl", "one.csv"]
    pd.DataFrame({"Filename": [str(folder / n) if k % 2 else f"processed/cycles/{n}" for k, n in enumerate(names)], "n": 1}).to_csv(folder / "cycles.csv", index=False)
    found = load_cycle_files(spark, str(tmp_path))
    assert len(found) == 5 and found.rul_column == "RUL" and set(found.features) == {"a", "s", "RUL"}
    for i, k in enumerate([0, 1, 2, 3, 0]):
        own = found[i].toPandas()
        assert own["a"].tolist() == frames[k]["a"].tolist() and own["RUL"].tolist() == frames[k]["RUL"].tolist()
        assert own["s"].tolist() == (frames[k]["s"].tolist() if k != 3 else [None, None])
    (folder / "cycles.csv").write_text("Filename\n")
    with pytest.raises(ValueError):
        load_cycle_files(spark, str(tmp_path))
