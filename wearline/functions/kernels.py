"""NumPy kernels for what has no Spark expression; each works on one series of one cycle or block."""

from __future__ import annotations

import functools
import math

import numpy as np

# Hashing -------------------------------------------------------------------------------------------


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, x86, 32 bits, unsigned (public algorithm; its constants are fixed values)."""
    mask, h = 0xFFFFFFFF, seed
    rotate = lambda v, r: (v << r | v >> (32 - r)) & mask
    scramble = lambda k: rotate(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) & ~3
    for i in range(0, whole, 4):
        h = rotate(h ^ scramble(int.from_bytes(data[i : i + 4], "little")), 13)
        h = (h * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for multiplier, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        h = (h ^ h >> shift) * multiplier & mask
    return h ^ h >> 16


def integer_bytes(value: int) -> bytes:
    """An integer in the fewest little-endian bytes (at least one; negative ones in two's complement)."""
    size = max(1, (value.bit_length() + (8 if value < 0 else 7)) // 8)
    return value.to_bytes(size, "little", signed=value < 0)


# Smoothing and peaks -------------------------------------------------------------------------------


def savitzky_golay(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares polynomials: their middle inside, the first and last window's polynomial at the ends."""
    n = len(x)
    if n <= window:
        return x
    half = window // 2
    t = np.arange(window) - half
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    out = np.empty(n)
    out[half : n - half] = np.convolve(x, fit[0][::-1], mode="valid")
    powers = np.vander(t, order + 1, increasing=True)
    out[:half] = (powers @ (fit @ x[:window]))[:half]
    out[n - half :] = (powers @ (fit @ x[-window:]))[window - half :]
    return out


def find_peaks(x: np.ndarray, distance: float = 1) -> np.ndarray:
    """Middles of plateaus higher than both sides; of peaks nearer than ``distance``, the highest stay."""
    n = len(x)
    if n < 3:
        return np.zeros(0, dtype=int)
    change = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.append(0, change + 1), np.append(change, n - 1)
    inner = slice(1, len(starts) - 1)
    level = x[starts]
    high = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    peaks = ((starts[inner] + ends[inner]) // 2)[high]
    reach, keep = math.ceil(distance), np.ones(len(peaks), dtype=bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(peaks - peaks[i]) < reach
            near[i] = False
            keep[near] = False
    return peaks[keep]


# Frequencies ---------------------------------------------------------------------------------------


def moments_of_spectrum(y: np.ndarray, compat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, variance, skewness and kurtosis of bin numbers weighted by ``y``; NaN below a variance of 0.5.

    ``compat`` gives the kurtosis with a plain centroid in its last term, as some published code has it.
    Several spectra are rows of a matrix.
    """
    total = y.sum(axis=-1)
    i = np.arange(y.shape[-1], dtype=float)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        total = np.where(total > 0, total, math.nan)
        m1, m2, m3, m4 = ((y * i**k).sum(axis=-1) / total for k in (1, 2, 3, 4))
        var = m2 - m1 * m1
        shaped = np.where(var < 0.5, math.nan, var)
        last = m1 if compat else m1**4
        return m1, var, (m3 - 3 * m1 * var - m1**3) / shaped**1.5, (m4 - 4 * m1 * m3 + 6 * m2 * m1**2 - 3 * last) / shaped**2


def frequency_features(x: np.ndarray, compat: bool = False) -> list[np.ndarray]:
    """The moments of the magnitudes and of the powers of a series' spectrum; several series are rows of a matrix."""
    magnitude = np.abs(np.fft.rfft(x))
    return [*moments_of_spectrum(magnitude, compat), *moments_of_spectrum(magnitude**2, compat)]


# Self-similarity and complexity --------------------------------------------------------------------


# Several series of one length are rows of a matrix; the result is then a number for each.


def _slope(sizes: np.ndarray, values: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    """Least-squares slope of log values against log sizes, where values are positive."""
    if not len(sizes):
        return np.full(like.shape[:-1], math.nan)
    found, t = np.stack(values, axis=-1), np.log(sizes)
    good = np.isfinite(found) & (found > 0)
    y, n = np.log(np.where(good, found, 1.0)), good.sum(axis=-1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        dt = np.where(good, t - (t * good).sum(axis=-1, keepdims=True) / n, 0.0)
        dy = np.where(good, y - y.sum(axis=-1, keepdims=True) / n, 0.0)
        return np.where(n[..., 0] > 1, (dt * dy).sum(axis=-1) / (dt * dt).sum(axis=-1), math.nan)


def hurst_rs(x: np.ndarray, min_chunk: int = 8, max_chunk: int = 200, chunks: int = 5) -> np.ndarray:
    """Slope of the mean rescaled range of increments against the chunk size."""
    steps = np.diff(x)
    sizes = np.unique(np.linspace(min_chunk, max_chunk + 1, chunks).astype(int))
    sizes = sizes[(sizes >= 2) & (sizes <= steps.shape[-1])]
    means = []
    for size in sizes:
        parts = steps[..., : steps.shape[-1] // size * size].reshape(*steps.shape[:-1], -1, size)
        walk = np.cumsum(parts - parts.mean(axis=-1, keepdims=True), axis=-1)
        spread = parts.std(axis=-1)
        with np.errstate(invalid="ignore", divide="ignore"):
            means.append(np.where(spread > 0, np.ptp(walk, axis=-1) / spread, 0.0).sum(axis=-1) / (spread > 0).sum(axis=-1))
    return _slope(sizes, means, x)


def hurst_dma(x: np.ndarray, min_chunk: int = 8, max_chunk: int = 200, step: int = 5) -> np.ndarray:
    """Slope of the deviation from a moving average against its length."""
    top = min(max_chunk + 1, x.shape[-1] - 1)
    sizes = np.arange(min_chunk, top, step)
    sums = np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)], axis=-1)
    spread = [np.sqrt(np.mean((x[..., n - 1 :] - (sums[..., n:] - sums[..., :-n]) / n)[..., max(0, top - n + 1) :] ** 2, axis=-1)) for n in sizes]
    return _slope(sizes, spread, x)


def hurst_dsod(x: np.ndarray) -> np.ndarray:
    """Half the log ratio of the second differences at twice the lag."""
    if x.shape[-1] < 6:
        return np.full(x.shape[:-1], math.nan)
    near = np.mean((x[..., 2:] - 2 * x[..., 1:-1] + x[..., :-2]) ** 2, axis=-1)
    far = np.mean((x[..., 4:] - 2 * x[..., 2:-2] + x[..., :-4]) ** 2, axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((near > 0) & (far > 0), 0.5 * np.log2(far / near), math.nan)


HURST = {"RS": hurst_rs, "DMA": hurst_dma, "DSOD": lambda x, *_: hurst_dsod(x)}


def approximate_entropy(x: np.ndarray, order: int = 2, tolerance: float = 0.2, most: int = 4000) -> float:
    """ApEn with Chebyshev distance and ``tolerance`` times the std; rows are compared in strips, so memory is linear."""
    n, r = len(x), tolerance * np.std(x)
    if n <= order + 1:
        return math.nan

    def phi(m: int) -> float:
        rows = np.lib.stride_tricks.sliding_window_view(x, m)
        strip = max(1, most * 64 // len(rows))
        logs = []
        for i in range(0, len(rows), strip):
            far = np.zeros((min(strip, len(rows) - i), len(rows)))
            for k in range(m):
                np.maximum(far, np.abs(rows[i : i + strip, k, None] - rows[None, :, k]), out=far)
            logs.append(np.log((far <= r).mean(axis=1)))
        return float(np.concatenate(logs).mean())

    return phi(order) - phi(order + 1)


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    inverse = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inverse * (1 / 12 - inverse * (1 / 120 - inverse / 252))


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Kraskov's nearest-neighbour estimate between two continuous series, at least 0; strips keep memory linear."""
    good = np.isfinite(x) & np.isfinite(y)
    x, y = x[good].astype(float), y[good].astype(float)
    n = len(x)
    if n <= k + 1 or x.std() == 0 or y.std() == 0:
        return 0.0
    x, y = x / x.std(), y / y.std()
    # Ties would make all neighbours equally far: a tiny, fixed shake.
    shake = np.random.RandomState(0)
    x, y = x + 1e-10 * max(1.0, np.abs(x).mean()) * shake.standard_normal(n), y + 1e-10 * max(1.0, np.abs(y).mean()) * shake.standard_normal(n)
    strip = max(1, 2_000_000 // n)
    radius = np.empty(n)
    for i in range(0, n, strip):
        far = np.maximum(np.abs(x[i : i + strip, None] - x), np.abs(y[i : i + strip, None] - y))
        radius[i : i + strip] = np.nextafter(np.partition(far, k, axis=1)[:, k], 0)
    counts = []
    for z in (x, y):
        s = np.sort(z)
        counts.append(np.searchsorted(s, z + radius, "right") - np.searchsorted(s, z - radius, "left"))
    value = _digamma(np.array([n]))[0] + _digamma(np.array([k]))[0] - np.mean(_digamma(counts[0]) + _digamma(counts[1]))
    return max(0.0, float(value))


# Empirical modes -----------------------------------------------------------------------------------


def _natural_spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic through the knots with no curvature at the ends."""
    n = len(t)
    if n < 3:
        return np.interp(at, t, y)
    h = np.diff(t)
    slope = np.diff(y) / h
    # The tridiagonal system for the curvatures, by forward elimination.
    diagonal, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope)
    for i in range(1, n - 2):
        w = h[i] / diagonal[i - 1]
        diagonal[i] -= w * h[i]
        right[i] -= w * right[i - 1]
    m = np.zeros(n)
    for i in range(n - 3, -1, -1):
        m[i + 1] = (right[i] - h[i + 1] * m[i + 2]) / diagonal[i]
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b, w = t[k + 1] - at, at - t[k], h[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * a + (y[k + 1] / w - m[k + 1] * w / 6) * b


def _envelope(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """A spline through extrema, mirrored at both ends."""
    n = len(x)
    left, right = knots[:2][::-1], knots[-2:][::-1]
    t = np.concatenate([-left, knots, 2 * (n - 1) - right]).astype(float)
    y = np.concatenate([x[left], x[knots], x[right]])
    t, first = np.unique(t, return_index=True)
    return _natural_spline(t, y[first], np.arange(n, dtype=float))


def sift(x: np.ndarray, modes: int, rounds: int = 50, still: float = 0.1) -> np.ndarray:
    """Empirical mode decomposition: up to ``modes`` columns, the last holds what is left."""
    rest, out = np.asarray(x, dtype=float), []
    while len(out) < modes - 1:
        mode = rest
        if min(len(find_peaks(mode)), len(find_peaks(-mode))) < 2:
            break
        for _ in range(rounds):
            up, down = find_peaks(mode), find_peaks(-mode)
            if min(len(up), len(down)) < 2:
                break
            mean = (_envelope(mode, up) + _envelope(mode, down)) / 2
            change = (mean**2).sum() / max((mode**2).sum(), 1e-300)
            mode = mode - mean
            if change < still:
                break
        out.append(mode)
        rest = rest - mode
    return np.stack([*out, rest], axis=1)


# Wavelets ------------------------------------------------------------------------------------------


def daubechies(vanishing: int) -> np.ndarray:
    """The scaling filter with that many vanishing moments, by spectral factorisation (least phase)."""
    p = vanishing
    # In y = sin^2(w/2), the remaining factor is a sum of binomials; each root gives two in z.
    poly = [math.comb(p - 1 + k, k) for k in range(p)][::-1]
    roots = []
    for y in np.roots(poly) if p > 1 else []:
        z = np.roots([1, 4 * y - 2, 1])
        roots.append(z[np.argmin(np.abs(z))])
    out = np.array([1.0])
    for _ in range(p):
        out = np.convolve(out, [1, 1])
    for z in roots:
        out = np.convolve(out, [1, -z])
    out = np.real(out)
    return out / out.sum() * math.sqrt(2)


@functools.lru_cache(maxsize=16)
def _filters(wavelet: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Analysis low and high, synthesis low and high."""
    if wavelet != "haar" and not (wavelet.startswith("db") and wavelet[2:].isdigit()):
        raise ValueError(f"unknown wavelet {wavelet}")
    low = daubechies(1 if wavelet == "haar" else int(wavelet[2:]))
    sign = np.where(np.arange(len(low)) % 2, -1.0, 1.0)
    high = sign * low[::-1]
    return low[::-1], high[::-1], low, high


def _convolved(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The part of a convolution of rows in which the weights are covered wholly."""
    n, size = x.shape[-1], len(weights)
    return sum(w * x[..., size - 1 - i : n - i] for i, w in enumerate(weights))


def _padded(x: np.ndarray, by: int, mode: str) -> np.ndarray:
    return np.pad(x, [(0, 0)] * (x.ndim - 1) + [(by, by)], mode=mode)


def wavelet_decompose(x: np.ndarray, wavelet: str, level: int) -> list[np.ndarray]:
    """Approximation, then details from coarse to fine; ends are mirrored. Several series are rows of a matrix."""
    low, high, _, _ = _filters(wavelet)
    a, details = np.asarray(x, dtype=float), []
    for _ in range(level):
        longer = _padded(a, len(low) - 1, "symmetric")
        details.append(_convolved(longer, high)[..., 1::2])
        a = _convolved(longer, low)[..., 1::2]
    return [a, *details[::-1]]


def wavelet_part(coefficients: list[np.ndarray], part: str, wavelet: str, level: int, size: int) -> np.ndarray:
    """The signal of one band: ``a`` of the last level, or ``d`` of a level. All bands add up to the signal."""
    _, _, low, high = _filters(wavelet)
    if part not in ("a", "d"):
        raise ValueError(f"unknown part {part}")
    depth = len(coefficients) - 1 if part == "a" else level
    out = coefficients[0] if part == "a" else coefficients[-level]
    for i in range(depth, 0, -1):
        wide = np.zeros((*out.shape[:-1], 2 * out.shape[-1] - 1))
        wide[..., ::2] = out
        full = _convolved(_padded(wide, len(low) - 1, "constant"), high if part == "d" and i == depth else low)
        # The filter's overhang goes, and what mirrored ends have added.
        out = full[..., len(low) - 2 :][..., : coefficients[-(i - 1)].shape[-1] if i > 1 else size]
    return out


# Random convolutions -------------------------------------------------------------------------------


class Rocket:
    """Random convolution kernels; two features of each: the greatest value and the share of positive ones."""

    def __init__(self, length: int, n_kernels: int = 1000, sizes: tuple[int, ...] = (7, 9, 11), seed: int | None = 0) -> None:
        random = np.random.RandomState(seed)
        fits = [s for s in sizes if s <= length] or [max(1, length)]
        self.kernels = []
        for _ in range(n_kernels):
            size = int(random.choice(fits))
            weights = random.standard_normal(size)
            top = math.log2((length - 1) / (size - 1)) if length > size > 1 else 0.0
            dilation = int(2 ** random.uniform(0, top))
            padding = (size - 1) * dilation // 2 if random.randint(2) else 0
            self.kernels.append((weights - weights.mean(), float(random.uniform(-1, 1)), dilation, padding))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for weights, bias, dilation, padding in self.kernels:
            x = np.pad(rows, ((0, 0), (padding, padding)))
            size = x.shape[1] - (len(weights) - 1) * dilation
            found = bias + sum(w * x[:, i * dilation : i * dilation + size] for i, w in enumerate(weights))
            out += [found.max(axis=1), (found > 0).mean(axis=1)]
        return np.stack(out, axis=1)


# Isolation forest ----------------------------------------------------------------------------------


def _mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Of one feature: a tree is a set of random cuts of the line, so a value's depth depends on its interval only."""

    def __init__(self, cuts: list[list[float]], depths: list[list[float]], size: int) -> None:
        self.cuts, self.depths, self.size = cuts, depths, size

    @classmethod
    def fit(cls, values: np.ndarray, trees: int = 100, seed: int = 0, most: int = 256) -> IsolationForest:
        random = np.random.RandomState(seed)
        size = min(most, len(values))
        limit = math.ceil(math.log2(max(size, 2)))
        cuts, depths = [], []
        for _ in range(trees):
            sample = np.sort(random.choice(values, size, replace=False))
            own_cuts: list[float] = []
            own_depths: list[float] = []
            # Intervals from left to right, with an explicit stack.
            stack = [(0, size, 0)]
            while stack:
                a, b, depth = stack.pop()
                if b - a <= 1 or depth >= limit or sample[a] == sample[b - 1]:
                    own_depths.append(depth + _mean_path(b - a))
                    continue
                cut = random.uniform(sample[a], sample[b - 1])
                middle = int(np.searchsorted(sample, cut, side="right"))
                middle = min(max(middle, a + 1), b - 1)
                stack += [(middle, b, depth + 1), (a, middle, depth + 1)]
                own_cuts.append(cut)
            cuts.append(sorted(own_cuts))
            depths.append(own_depths)
        return cls(cuts, depths, size)

    def scores(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for cuts, depths in zip(self.cuts, self.depths, strict=True):
            depth += np.array(depths)[np.searchsorted(cuts, x, side="left")]
        return 2 ** (-depth / len(self.cuts) / max(_mean_path(self.size), 1e-9))

    def outliers(self, x: np.ndarray) -> np.ndarray:
        """Scores above one half are outliers."""
        return self.scores(x) > 0.5

    def to_json(self) -> dict:
        return {"cuts": self.cuts, "depths": self.depths, "size": self.size}

    @classmethod
    def from_json(cls, held: dict) -> IsolationForest:
        return cls(held["cuts"], held["depths"], held["size"])


# Piecewise lines -----------------------------------------------------------------------------------


class Polyline:
    """A function of line pieces (begin, end), each a point (t, y), in the order of t; the outer pieces go on beyond their ends."""

    def __init__(self, pieces: list[tuple[tuple[float, float], tuple[float, float]]]) -> None:
        self.pieces = list(pieces)
        corners = np.array(pieces, dtype=float).reshape(-1, 4)
        self.begin, self.height, self.end, top = corners.T
        width = self.end - self.begin
        self.slope = np.divide(top - self.height, width, out=np.zeros_like(width), where=width != 0)

    def __len__(self) -> int:
        return len(self.begin)

    def __call__(self, t: np.ndarray) -> np.ndarray:
        """Values at many places: the piece of each is the last that begins at or before it."""
        t = np.asarray(t, dtype=float)
        piece = np.clip(np.searchsorted(self.begin, t, side="right") - 1, 0, None)
        return self.height[piece] + self.slope[piece] * (t - self.begin[piece])

    def root(self) -> float:
        """The first place in its pieces where the function is 0; else where the last piece would be, 0 if it is level."""
        return root_of(self.pieces)


def root_of(pieces: list[tuple[tuple[float, float], tuple[float, float]]]) -> float:
    """:meth:`Polyline.root`, without making one."""
    at = slope = 0.0
    for (begin, height), (end, top) in pieces:
        slope = (top - height) / (end - begin) if end != begin else 0.0
        at = begin - height / slope if slope != 0 else math.nan
        if begin <= at <= end:
            return float(at)
    return float(at) if slope != 0 else 0.0


class PiecewiseLinearRegression:
    """Online segmentation: a segment grows while its residual stays near those it had; the next begins at its end."""

    # Fixed values of the method: points before a segment may end, and spreads above the mean residual that end it.
    LEAST = 15
    SPREADS = 1.5

    def __init__(self, not_increasing: bool = False) -> None:
        self.not_increasing = not_increasing
        self.done: list[tuple[tuple[float, float], tuple[float, float]]] = []
        self.first: tuple[float, float] | None = None

    def _begin(self, point: tuple[float, float]) -> None:
        self.first, self.last, self.n = point, point, 1
        self.means = (0.0, 0.0, 0.0)
        # Mean and sum of squared deviations of the residuals so far: a point costs the same however long its segment is.
        self.mean = self.squares = 0.0

    def _grown(self, t: float, y: float) -> tuple[tuple[float, float, float], float, float]:
        """Means of t², ty and y² with a point more, the slope through the first point, the squared residual."""
        dt, dy = t - self.first[0], y - self.first[1]
        a, b, c = self.means
        n = self.n + 1
        a, b, c = a + (dt * dt - a) / n, b + (dt * dy - b) / n, c + (dy * dy - c) / n
        slope = b / a if a > 0 else 0.0
        return (a, b, c), slope, c - slope * b

    def add_point(self, t: float, y: float) -> None:
        if self.first is None:
            self._begin((t, y))
            return
        grown = self._grown(t, y)
        if self.n >= self.LEAST and grown[2] * self.n > self.mean + self.SPREADS * math.sqrt(self.squares / (self.n - 1)):
            self.done.append((self.first, self.last))
            self._begin(self.last)
            grown = self._grown(t, y)
        self.means, slope, residual = grown
        self.n += 1
        residual *= self.n
        off = residual - self.mean
        self.mean += off / (self.n - 1)
        self.squares += off * (residual - self.mean)
        if self.not_increasing:
            slope = min(slope, 0.0)
        self.last = (t, self.first[1] + slope * (t - self.first[0]))

    def pieces(self) -> list[tuple[tuple[float, float], tuple[float, float]]]:
        return [*self.done, (self.first, self.last)] if self.first is not None else []

    def finish(self) -> Polyline:
        return Polyline(self.pieces())
