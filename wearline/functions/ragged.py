"""Many series at once: one flat array and where each series starts.

Cycles are mostly short and very many, so what a kernel costs is its calls and not its sums. These forms
take all whole cycles of a batch together; a series of any length still gives what it gives alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from wearline.functions import kernels

#: Cells of one matrix of series of the same length; a longer series is a matrix of its own.
MAX_CELLS = 250_000
#: Series of more rows are sifted alone: knots of many series share a table as wide as the most of them.
MAX_TOGETHER = 512


def sizes_of(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def kept(good: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sizes of the series (none empty) when only good rows stay."""
    return np.add.reduceat(good.astype(np.int64), starts) if len(starts) else np.zeros(0, dtype=np.int64)


def blocks(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Where blocks of so many rows start, within each series."""
    place = np.arange(n) - np.repeat(starts, sizes_of(starts, n))
    return np.flatnonzero(place % size == 0)


def by_length(sizes: np.ndarray, cells: Callable[[int], int] = lambda n: n) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(series, rows): series of one length, and the rows of each as a line of a matrix; ``cells`` of a length bounds how many come together."""
    starts, order = starts_of(sizes), np.argsort(sizes, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
        n = int(sizes[same[0]])
        most = max(1, MAX_CELLS // max(1, cells(n)))
        for i in range(0, len(same), most):
            chosen = same[i : i + most]
            yield chosen, starts[chosen][:, None] + np.arange(n)


def find_peaks(x: np.ndarray, starts: np.ndarray, distance: float = 1) -> np.ndarray:
    """:func:`kernels.find_peaks` of each series; places are those in the flat array."""
    n = len(x)
    if n < 3:
        return np.zeros(0, dtype=int)
    first = np.zeros(n + 1, dtype=bool)
    first[starts], first[n] = True, True
    change = np.flatnonzero((np.diff(x) != 0) | first[1:n])
    begin, end = np.append(0, change + 1), np.append(change, n - 1)
    level = x[begin]
    high = np.zeros(len(begin), dtype=bool)
    high[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    high &= ~first[begin] & ~first[end + 1]
    peaks = ((begin + end) // 2)[high]
    reach = int(np.ceil(distance))
    if reach <= 2 or not len(peaks):
        return peaks
    # Series are set apart, so that near peaks are of one series.
    apart = peaks + (np.searchsorted(starts, peaks, side="right")) * reach
    low, top = np.searchsorted(apart, apart - reach, side="right"), np.searchsorted(apart, apart + reach, side="left")
    keep = np.ones(len(peaks), dtype=bool)
    crowded = np.flatnonzero(top - low > 1)
    for i in crowded[np.argsort(x[peaks[crowded]], kind="stable")[::-1]].tolist():
        if keep[i]:
            keep[low[i] : top[i]] = False
            keep[i] = True
    return peaks[keep]


# Complexity ----------------------------------------------------------------------------------------


def approximate_entropy(x: np.ndarray, sizes: np.ndarray, order: int = 2, tolerance: float = 0.2) -> np.ndarray:
    """:func:`kernels.approximate_entropy` of each series, NaN where it is too short."""
    out = np.full(len(sizes), np.nan)
    for series, rows in by_length(sizes, lambda n: n * n):
        own, n = x[rows], rows.shape[1]
        if n <= order + 1:
            continue
        if n * n > MAX_CELLS:
            out[series] = [kernels.approximate_entropy(v, order, tolerance) for v in own]
            continue
        near = tolerance * own.std(axis=1)[:, None, None]

        def phi(m: int, own: np.ndarray = own, n: int = n, near: np.ndarray = near) -> np.ndarray:
            w = n - m + 1
            far = np.zeros((len(own), w, w))
            for k in range(m):
                part = own[:, k : k + w]
                np.maximum(far, np.abs(part[:, :, None] - part[:, None, :]), out=far)
            return np.log((far <= near).mean(axis=2)).mean(axis=1)

        out[series] = phi(order) - phi(order + 1)
    return out


def mutual_information(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, k: int = 3) -> np.ndarray:
    """:func:`kernels.mutual_information` of each pair of series of finite values."""
    out = np.zeros(len(sizes))
    for series, rows in by_length(sizes, lambda n: n * n):
        n = rows.shape[1]
        if n <= k + 1:
            continue
        if n * n > MAX_CELLS:
            out[series] = [kernels.mutual_information(u, v, k) for u, v in zip(x[rows], y[rows], strict=True)]
            continue
        own = [x[rows], y[rows]]
        spread = [z.std(axis=1, keepdims=True) for z in own]
        varies = ((spread[0] > 0) & (spread[1] > 0))[:, 0]
        # The same tiny, fixed shake as of a series alone.
        shake = np.random.RandomState(0)
        own = [z[varies] / s[varies] for z, s in zip(own, spread, strict=True)]
        own = [z + 1e-10 * np.maximum(1.0, np.abs(z).mean(axis=1, keepdims=True)) * shake.standard_normal(n) for z in own]
        far = np.maximum(*(np.abs(z[:, :, None] - z[:, None, :]) for z in own))
        radius = np.nextafter(np.partition(far, k, axis=2)[:, :, k], 0)
        sums = 0.0
        for z in own:
            among = z[:, None, :]
            counts = (among <= (z + radius)[:, :, None]).sum(axis=2) - (among < (z - radius)[:, :, None]).sum(axis=2)
            sums = sums + kernels._digamma(counts)
        value = kernels._digamma(np.array([n]))[0] + kernels._digamma(np.array([k]))[0] - np.mean(sums, axis=1)
        out[series[varies]] = np.maximum(0.0, value)
    return out


# Empirical modes -----------------------------------------------------------------------------------


def _knots(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    peaks = find_peaks(x, starts)
    return peaks, np.bincount(np.searchsorted(starts, peaks, side="right") - 1, minlength=len(starts))


def _envelopes(x: np.ndarray, starts: np.ndarray, peaks: np.ndarray, n_knots: np.ndarray) -> np.ndarray:
    """Natural splines through the peaks of each series (two at least), mirrored at both ends; a table of knots has a column a series."""
    sizes, many = sizes_of(starts, len(x)), len(starts)
    series = np.repeat(np.arange(many), n_knots)
    first = starts_of(n_knots)
    place = np.arange(len(peaks)) - first[series] + 2
    local = (peaks - starts[series]).astype(float)
    wide, n, each = int(n_knots.max()) + 4, n_knots + 4, np.arange(many)
    t, y = np.empty((wide, many)), np.zeros((wide, many))
    t[:] = 2.0 * sizes + np.arange(wide)[:, None] * 2
    t[place, series], y[place, series] = local, x[peaks]
    last = first + n_knots - 1
    for at, knot, sign in ((0, first + 1, -1), (1, first, -1), (n - 2, last, 1), (n - 1, last - 1, 1)):
        t[at, each] = -local[knot] if sign < 0 else 2.0 * (sizes - 1) - local[knot]
        y[at, each] = x[peaks[knot]]
    h = np.diff(t, axis=0)
    slope = np.diff(y, axis=0) / h
    diagonal, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope, axis=0)
    for i in range(1, wide - 2):
        w = h[i] / diagonal[i - 1]
        diagonal[i] -= w * h[i]
        right[i] -= w * right[i - 1]
    m = np.zeros((wide, many))
    for i in range(wide - 3, -1, -1):
        m[i + 1] = np.where(i <= n - 3, (right[i] - h[i + 1] * m[i + 2]) / diagonal[i], 0.0)
    row_of = np.repeat(each, sizes)
    at = np.arange(len(x)) - starts[row_of]
    # Both left mirrored knots lie before all rows, both right ones behind.
    passed = np.zeros(len(x), dtype=np.int64)
    passed[peaks] = 1
    k = 1 + np.cumsum(passed) - first[row_of]
    a, b, w = t[k + 1, row_of] - at, at - t[k, row_of], h[k, row_of]
    mk, mn = m[k, row_of], m[k + 1, row_of]
    return (mk * a**3 + mn * b**3) / (6 * w) + (y[k, row_of] / w - mk * w / 6) * a + (y[k + 1, row_of] / w - mn * w / 6) * b


def _rows(starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of some series, and where they start among these."""
    own = starts_of(sizes[chosen])
    return np.repeat(starts[chosen] - own, sizes[chosen]) + np.arange(int(sizes[chosen].sum())), own


def _one_mode(x: np.ndarray, starts: np.ndarray, rounds: int, still: float) -> np.ndarray:
    sizes, x = sizes_of(starts, len(x)), x.copy()
    live = np.arange(len(starts))
    for _ in range(rounds):
        rows, own = _rows(starts, sizes, live)
        mode = x[rows]
        (up, n_up), (down, n_down) = _knots(mode, own), _knots(-mode, own)
        moving = np.minimum(n_up, n_down) >= 2
        if not moving.all():
            live = live[moving]
            if not len(live):
                break
            up, down = up[np.repeat(moving, n_up)], down[np.repeat(moving, n_down)]
            shift = np.zeros(len(mode), dtype=np.int64)
            stay = np.repeat(moving, sizes_of(own, len(mode)))
            shift = np.cumsum(stay) - 1
            up, down, n_up, n_down = shift[up], shift[down], n_up[moving], n_down[moving]
            rows, own = _rows(starts, sizes, live)
            mode = x[rows]
        mean = (_envelopes(mode, own, up, n_up) + _envelopes(mode, own, down, n_down)) / 2
        change = np.add.reduceat(mean**2, own) / np.maximum(np.add.reduceat(mode**2, own), 1e-300)
        x[rows] = mode - mean
        live = live[change >= still]
        if not len(live):
            break
    return x


def sift(x: np.ndarray, starts: np.ndarray, modes: int, rounds: int = 50, still: float = 0.1) -> np.ndarray:
    """:func:`kernels.sift` of each series, as exactly ``modes`` columns; NaN where it has fewer, or a value that is not finite."""
    x = np.asarray(x, dtype=float)
    out = np.full((len(x), modes), np.nan)
    if not len(x):
        return out
    sizes = sizes_of(starts, len(x))
    finite = np.logical_and.reduceat(np.isfinite(x), starts)
    for i in np.flatnonzero(finite & (sizes > MAX_TOGETHER)):
        found = kernels.sift(x[starts[i] : starts[i] + sizes[i]], modes, rounds, still)
        out[starts[i] : starts[i] + sizes[i], : found.shape[1]] = found
    here, own = _rows(starts, sizes, np.flatnonzero(finite & (sizes <= MAX_TOGETHER)))
    if not len(here):
        return out
    starts, rest = own, x[here]
    sizes, found = sizes_of(starts, len(rest)), np.full((len(rest), modes), np.nan)
    active, n_modes = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    for j in range(modes - 1):
        rows, own = _rows(starts, sizes, active)
        mode = rest[rows]
        active = active[np.minimum(_knots(mode, own)[1], _knots(-mode, own)[1]) >= 2]
        if not len(active):
            break
        rows, own = _rows(starts, sizes, active)
        mode = _one_mode(rest[rows], own, rounds, still)
        found[rows, j] = mode
        rest[rows] -= mode
        n_modes[active] = j + 1
    found[np.arange(len(rest)), np.repeat(n_modes, sizes)] = rest
    out[here] = found
    return out
