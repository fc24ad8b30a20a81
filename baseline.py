"""Single-threaded pandas times for headline queries: what the same work costs cycle by cycle in memory.

Reads the tables of BENCH_SF_DIR (default /root/testdata/sf0.1) anew for each query, as the queries do,
cuts events into cycles, and computes each query by a loop over cycles or a groupby, whichever is
plainer in pandas. Prints one JSON line with seconds per query, like ``bench.py``.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

os.environ.setdefault("OMP_NUM_THREADS", "1")

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from wearline.functions import kernels  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def cycles() -> pd.DataFrame:
    """Events by unit and time, cut after each error, with the hours left to the cycle's end."""
    d = pd.read_parquet(f"{FOLDER}/events.parquet").sort_values(["user_id", "ts", "event_id"], ignore_index=True)
    d["k"] = d["props"].map(lambda p: json.loads(p)["k"])
    ended = (d["event_type"] == "error").groupby(d["user_id"]).cumsum()
    before = ended.groupby(d["user_id"]).shift(fill_value=0)
    d["cycle_id"] = "Cycle_1:" + d["user_id"].astype(str) + "_" + (before + 1).astype(int).astype(str)
    by = d.groupby("cycle_id", sort=False)
    d["pos"] = by.cumcount()
    d["RUL"] = (by["ts"].transform("max") - d["ts"]).dt.total_seconds() / 3600
    return d


def each(function: Callable[[pd.Series], object]) -> Callable[[], pd.DataFrame]:
    """A function of each cycle's values, one cycle after the other."""

    def run() -> pd.DataFrame:
        return pd.concat([pd.DataFrame(function(part["value"])) for _, part in cycles().groupby("cycle_id", sort=False)])

    return run


def _stats(x: pd.Series, w: object) -> dict[str, pd.Series]:
    """The features of a window, rolling or expanding."""
    rms = np.sqrt((x * x).pipe(lambda y: w(y).mean()))
    high, mean = w(x.abs()).max(), w(x.abs()).mean()
    root = w(np.sqrt(x.abs())).mean()
    return {
        "mean": w(x).mean(), "max": w(x).max(), "min": w(x).min(), "std": w(x).std(), "kurtosis": w(x).kurt(), "skewness": w(x).skew(), "peak": w(x).max() - w(x).min(),
        "impulse": high / mean, "clearance": high / (root * root), "rms": rms, "shape": rms / mean, "crest": high / rms, "energy": w(x * x).sum(),
    }


def _faults() -> pd.DataFrame:
    d = cycles()
    faults = d.loc[d["event_type"] == "error", ["user_id", "ts", "event_id"]].rename(columns={"event_id": "fault"}).sort_values("ts")
    return pd.merge_asof(d.sort_values("ts"), faults, on="ts", by="user_id", direction="forward")


def _robust() -> pd.Series:
    x = cycles()["value"]
    q = x.quantile([0.25, 0.5, 0.75]).to_numpy()
    return (x - q[1]) / (q[2] - q[0])


def _clip() -> pd.Series:
    x = cycles()["value"]
    q = x.quantile([0.25, 0.75]).to_numpy()
    return x.clip(q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0]))


def _by_category() -> pd.Series:
    d = cycles()
    by = d.groupby("event_type")["value"]
    return (d["value"] - by.transform("min")) / (by.transform("max") - by.transform("min"))


def _centred() -> pd.Series:
    d = cycles()
    return d["value"] - d.groupby("event_type")["value"].transform("mean")


def _rates() -> pd.Series:
    parts = []
    for _, part in cycles().groupby("cycle_id", sort=False):
        step = part["ts"].diff().dt.total_seconds().dropna()
        parts.append(step[step <= step.median()])
    return pd.concat(parts)


BASELINES: dict[str, Callable[[], object]] = {
    "split_life_end": cycles,
    "split_fault_asof": _faults,
    "cycle_metadata": lambda: cycles().groupby("cycle_id").agg(n=("pos", "size"), duration=("RUL", "max"), first=("event_type", "first")),
    "rolling_stats": each(lambda x: _stats(x, lambda y: y.rolling(5, 1))),
    "expanding_stats": each(lambda x: _stats(x, lambda y: y.expanding(1))),
    "median_filter": each(lambda x: {"value": x.rolling(5, 1, center=True).median()}),
    "ewma_filter": each(lambda x: {"value": x.ewm(span=5, ignore_na=True).mean()}),
    "savitzky_golay": each(lambda x: {"value": kernels.savitzky_golay(x.to_numpy(), 5, 2)}),
    "minmax": lambda: (lambda x: (x - x.min()) / (x.max() - x.min()))(cycles()["value"]),
    "robust_standard": _robust,
    "percat_minmax": _by_category,
    "iqr_clip": _clip,
    "ffill": each(lambda x: {"value": x.ffill()}),
    "onehot": lambda: pd.get_dummies(cycles()["event_type"]),
    "split_by_category": _centred,
    "sample_rate": _rates,
}


def main() -> None:
    seconds = {}
    for name, run in BASELINES.items():
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "single-threaded pandas", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/"))}))


if __name__ == "__main__":
    main()
