"""Queries without SQL against the same steps by hand: cycle by cycle, from the collected input."""

from __future__ import annotations

import numpy as np
import pytest

from wearline import queries as core
from wearline.functions import kernels
from wearline.queries.common import cycles, gaps, sensors


def parts(df, names):
    rows = df.select("cycle_id", "pos", *names).toPandas().sort_values(["cycle_id", "pos"])
    return {c: g.reset_index(drop=True) for c, g in rows.groupby("cycle_id")}


def close(found, expected, places=6):
    return np.allclose(np.asarray(found, dtype=float), np.asarray(expected, dtype=float), atol=2 * 10.0**-places, rtol=1e-6, equal_nan=True)


def test_peaks(spark, sf):
    source, found = parts(cycles(spark, sf).df, ["value"]), parts(core.queries()["peaks"](spark, sf), ["value"])
    assert set(source) == set(found)
    for c, part in source.items():
        x = part["value"].to_numpy(dtype=float)
        marks = np.zeros(len(x))
        # By definition: rows above both neighbours (plateaus by their middle), the highest first, none nearer than 3 to a higher one.
        tops = []
        i = 1
        while i < len(x) - 1:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if x[i] > x[i - 1] and j < len(x) - 1 and x[i] > x[j + 1]:
                tops.append((i + j) // 2)
            i = j + 1
        for top in sorted(tops, key=lambda k: (x[k], k), reverse=True):
            if all(abs(top - k) >= 3 for k in np.flatnonzero(marks)):
                marks[top] = 1
        assert found[c]["value"].tolist() == marks.tolist(), c


def test_hashing_encoding(spark, sf):
    source, found = parts(cycles(spark, sf).df, ["event_type"]), parts(core.queries()["hashing_encoding"](spark, sf), ["encoding"])
    for c, part in source.items():
        assert found[c]["encoding"].tolist() == [kernels.murmur3(v.encode()) % 16 for v in part["event_type"]]


def test_apply_rolling_imputer(spark, sf):
    source = parts(gaps(sensors(spark, sf)).df, ["value"])
    found = parts(core.queries()["apply_rolling_imputer"](spark, sf), ["value"])
    assert set(source) == set(found)
    for c, part in source.items():
        kept = part["value"].notna()
        assert close(found[c]["value"][kept], part["value"][kept])


@pytest.mark.parametrize(("name", "columns", "function"), [
    ("emd", 3, lambda x: kernels.sift(x, 3)),
    ("emd_filter", 1, None),
])
def test_modes_add_up(spark, sf, name, columns, function):
    source, result = parts(cycles(spark, sf).df, ["value"]), core.queries()[name](spark, sf)
    names = [c for c in result.columns if c not in ("cycle_id", "pos")]
    assert len(names) == columns
    found = parts(result, names)
    for c, part in list(source.items())[:150]:
        if function is not None:
            modes = function(part["value"].to_numpy(dtype=float))
            for k in range(columns):
                expected = modes[:, k] if k < modes.shape[1] else np.full(len(part), np.nan)
                assert close(found[c][names[k]], expected), (c, k)
        else:
            assert len(found[c]) == len(part)
