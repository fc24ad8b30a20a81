"""Signal processing by kernels of whole cycles or blocks: smoothing, modes, wavelets, spectra, complexity, clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline.frame import Frame, Rows, by_group
from wearline.functions import kernels, ragged
from wearline.plans.graph import Step

__all__ = [
    "EMD", "EMDFilter", "FrequencyFeatures", "HurstExponent", "MultiDimensionalKMeans", "OneDimensionalKMeans", "Peaks", "ROCKET", "SavitzkyGolayTransformer",
    "SlidingNonOverlappingEMD", "SlidingNonOverlappingWaveletDecomposition",
]


def _each(frame: Frame, function: Callable[[np.ndarray], np.ndarray]) -> Frame:
    """A function of each numeric series of a cycle; names and other features stay."""
    names = frame.numeric
    done = frame.kernel({n: "double" for n in names}, lambda part: part.astype(float).apply(lambda s: pd.Series(function(s.to_numpy()))), names)
    return Frame(frame.rows, {n: done.held.get(n, h) for n, h in frame.held.items()})


def _each_together(frame: Frame, function: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Frame:
    """As :func:`_each`, of all cycles of a batch: flat values, and where each cycle starts."""
    names = frame.numeric
    done = frame.kernel({n: "double" for n in names}, lambda part, starts: {n: function(part[n].to_numpy(dtype=float), starts) for n in names}, names, together=True)
    return Frame(frame.rows, {n: done.held.get(n, h) for n, h in frame.held.items()})


class SavitzkyGolayTransformer(Step):
    """Least-squares polynomial smoothing; cycles no longer than the window stay."""

    def __init__(self, window: int, order: int = 2, *, name: str | None = None) -> None:
        super().__init__(name=name)
        if window % 2 == 0 or order >= window:
            raise ValueError("the window must be odd and longer than the order")
        self.window, self.order = window, order

    #: Windows of more rows are fitted by a kernel: the expression has a term for each pair of rows.
    MAX_TERMS = 31

    def apply(self, frame: Frame) -> Frame:
        window, order = self.window, self.order
        if window > self.MAX_TERMS:
            return _each(frame, lambda x: kernels.savitzky_golay(x, window, order))
        half = window // 2
        powers = np.vander(np.arange(window) - half, order + 1, increasing=True).astype(float)
        #: Row i gives the polynomial's value at the window's place i from the window's values.
        weights = powers @ np.linalg.pinv(powers)
        place = frame.rows.add({"at": F.row_number().over(frame.ordered) - 1, "n": F.count(F.lit(1)).over(frame.whole)})
        at, n = F.col(place["at"]), F.col(place["n"])

        def smooth(x: Column) -> Column:
            x = x.cast("double")
            near = {k: F.lag(x, -k).over(frame.ordered) if k < 0 else F.lead(x, k).over(frame.ordered) if k else x for k in range(1 - window, window)}
            value = lambda i: sum((near[j - i] * float(weights[i, j]) for j in range(window)), F.lit(0.0))
            out = F.when(n <= window, x)
            for i in range(half):
                out = out.when(at == i, value(i)).when(at == n - 1 - i, value(window - 1 - i))
            return out.otherwise(value(half))

        return frame.each(smooth)


class Peaks(Step):
    """1 at peaks, else 0; with a distance above 1, the highest of near ones stay."""

    def __init__(self, distance: float = 1, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.distance = distance

    def apply(self, frame: Frame) -> Frame:
        distance = self.distance

        def mark(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x))
            out[ragged.find_peaks(x, starts, distance)] = 1
            return out

        return _each_together(frame, mark)


class EMD(Step):
    """n empirical modes of each feature, ``{feature}_{j}``."""

    def __init__(self, n: int, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.n = n

    def apply(self, frame: Frame) -> Frame:
        n = self.n

        def run(part: pd.DataFrame, starts: np.ndarray) -> dict[str, np.ndarray]:
            found = {c: ragged.sift(part[c].to_numpy(dtype=float), starts, n) for c in part.columns}
            return {f"{c}_{j}": modes[:, j] for c, modes in found.items() for j in range(n)}

        return frame.kernel({f"{c}_{j}": "double" for c in frame.numeric for j in range(n)}, run, frame.numeric, together=True)


class EMDFilter(Step):
    """The sum of some modes; a series that has none (gaps) stays."""

    def __init__(self, n: int, min_imf: int, max_imf: int, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.n, self.min_imf, self.max_imf = n, min_imf, max_imf

    def apply(self, frame: Frame) -> Frame:
        n, a, b = self.n, self.min_imf, self.max_imf

        def run(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
            modes = ragged.sift(x, starts, n)
            # The first mode is there wherever there are any.
            return np.where(np.isnan(modes[:, 0]), x, np.nan_to_num(modes[:, a:b]).sum(axis=1))

        return _each_together(frame, run)


class SlidingNonOverlappingEMD(Step):
    """Empirical modes of each block of rows, ``imf_{i}_{feature}``; 0 where a block has fewer."""

    def __init__(self, window_size: int, max_imfs: int, keep: int | None = None, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window_size, self.max_imfs = window_size, max_imfs
        self.keep = max_imfs if keep is None else keep
        if self.keep > max_imfs:
            raise ValueError("keep must not be more than max_imfs")

    def apply(self, frame: Frame) -> Frame:
        size, most, keep = self.window_size, self.max_imfs, self.keep

        def run(part: pd.DataFrame, starts: np.ndarray) -> dict[str, np.ndarray]:
            out, own = {}, ragged.blocks(starts, len(part), size)
            for c in part.columns:
                found = np.nan_to_num(ragged.sift(part[c].to_numpy(dtype=float), own, most)[:, :keep])
                out |= {f"imf_{i}_{c}": found[:, i] for i in range(keep)}
            return out

        return frame.kernel({f"imf_{i}_{c}": "double" for c in frame.numeric for i in range(keep)}, run, frame.numeric, together=True)


class SlidingNonOverlappingWaveletDecomposition(Step):
    """Bands of each block of rows, ``wavelet_{band}_{feature}``; bands are "A4", "D1" and the like."""

    def __init__(self, window_size: int, level: int, wavelet: str, keep: Sequence[str], *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.window_size, self.level, self.wavelet, self.keep = window_size, level, wavelet, list(keep)

    def apply(self, frame: Frame) -> Frame:
        size, level, wavelet, keep = self.window_size, self.level, self.wavelet, self.keep

        def run(part: pd.DataFrame, starts: np.ndarray) -> dict[str, np.ndarray]:
            own = ragged.sizes_of(ragged.blocks(starts, len(part), size), len(part))
            out = {f"wavelet_{b}_{c}": np.empty(len(part)) for c in part.columns for b in keep}
            values = {c: part[c].to_numpy(dtype=float) for c in part.columns}
            for _, rows in ragged.by_length(own):
                for c, x in values.items():
                    found = kernels.wavelet_decompose(x[rows], wavelet, level)
                    for b in keep:
                        out[f"wavelet_{b}_{c}"][rows] = kernels.wavelet_part(found, b[0].lower(), wavelet, int(b[1:]), rows.shape[1])
            return out

        return frame.kernel({f"wavelet_{b}_{c}": "double" for c in frame.numeric for b in keep}, run, frame.numeric, together=True)


class ROCKET(Step):
    """Random convolutions of each row's features, taken as a series; one array column of 2 values a kernel."""

    def __init__(self, n_kernels: int = 1000, kernel_sizes: Sequence[int] = (7, 9, 11), random_state: int | None = 0, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.n_kernels, self.kernel_sizes, self.random_state = n_kernels, tuple(kernel_sizes), random_state

    def apply(self, frame: Frame) -> Frame:
        names = frame.numeric
        rocket = kernels.Rocket(len(names), self.n_kernels, self.kernel_sizes, self.random_state)

        def run(part: pd.DataFrame, _: np.ndarray) -> dict[str, pa.Array]:
            found = rocket(part.to_numpy(dtype=float))
            return {"rocket": pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())}

        return frame.kernel({"rocket": "array<double>"}, run, names, together=True)


class _PerCycle(Step):
    """Some numbers of each whole series: one row per cycle."""

    def names(self) -> list[str]:
        raise NotImplementedError

    def values(self, x: np.ndarray) -> np.ndarray:
        """The numbers of several series of one length: a row each."""
        raise NotImplementedError

    def apply(self, frame: Frame) -> Frame:
        chosen, names, pos, cycle, step = frame.numeric, self.names(), frame.pos, frame.cycle, self
        kind = frame.rows.df.schema[cycle].dataType.simpleString()
        columns = [f"{c}_{n}" for c in chosen for n in names]
        source = frame.rows.df.select(cycle, pos, *(frame.col(c).cast("double").alias(c) for c in chosen))

        def run(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            out = {cycle: part[cycle].iloc[starts].reset_index(drop=True), pos: 0}
            for c in chosen:
                x = part[c].to_numpy(dtype=float)
                good = ~np.isnan(x)
                x, found = x[good], np.full((len(starts), len(names)), np.nan)
                for series, rows in ragged.by_length(ragged.kept(good, starts)):
                    found[series] = step.values(x[rows])
                out |= {f"{c}_{n}": found[:, i] for i, n in enumerate(names)}
            return pd.DataFrame(out)

        schema = ", ".join([f"`{cycle}` {kind}", f"`{pos}` long", *(f"`{c}` double" for c in columns)])
        return Frame(Rows(by_group(source, [cycle], pos, run, schema, together=True), cycle, pos), {c: c for c in columns})


class FrequencyFeatures(_PerCycle):
    """Centroid, variance, skewness and kurtosis of magnitudes and of powers of the spectrum."""

    def __init__(self, compat: bool = False, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.compat = compat

    def names(self) -> list[str]:
        return [f"{of}_{m}" for of in ("fft", "power") for m in ("centroid", "variance", "skew", "kurtosis")]

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.stack(kernels.frequency_features(x, self.compat), axis=-1) if x.shape[1] else np.full((len(x), 8), np.nan)


class HurstExponent(_PerCycle):
    """The Hurst exponent by rescaled range, moving average or second differences."""

    def __init__(self, method: str = "RS", min_chunksize: int = 8, max_chunksize: int = 200, num_chunksize: int = 5, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.methods = list(kernels.HURST) if method == "all" else [method]
        if any(m not in kernels.HURST for m in self.methods):
            raise ValueError(f"unknown method {method}")
        self.sizes = (min_chunksize, max_chunksize, num_chunksize)

    def names(self) -> list[str]:
        return [f"hurst_{m.lower()}" for m in self.methods]

    def values(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] <= self.sizes[0] + 1:
            return np.full((len(x), len(self.methods)), np.nan)
        return np.stack([kernels.HURST[m](x, *self.sizes) for m in self.methods], axis=-1)


class _KMeans(Step):
    fitted = True

    def __init__(self, n_clusters: int = 5, seed: int = 0, *, name: str | None = None) -> None:
        super().__init__(name=name)
        self.n_clusters, self.seed = n_clusters, seed

    def _centres(self, frame: Frame, names: list[str]) -> list[list[float]]:
        data = frame.rows.df.select(*(frame.col(n).cast("double").alias(n) for n in names)).dropna()
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(data)
        model = KMeans(k=self.n_clusters, seed=self.seed).fit(vectors)
        return sorted([float(v) for v in c] for c in model.clusterCenters())


def _nearest(distance: Callable[[list[float]], Column], centres: list[list[float]], value: Callable[[list[float]], Column]) -> Column:
    least = F.array_min(F.array(*(F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"]
    return F.element_at(F.array(*(value(c) for c in centres)), least + 1)


class OneDimensionalKMeans(_KMeans):
    """Each value becomes the nearest centre of its feature."""

    def learn(self, frame: Frame) -> dict:
        return {n: self._centres(frame, [n]) for n in frame.numeric}

    def apply(self, frame: Frame) -> Frame:
        def one(n: str) -> Column:
            x = frame.col(n)
            return F.when(x.isNotNull(), _nearest(lambda c: F.abs(x - c[0]), self.params[n], lambda c: F.lit(c[0])))

        new = frame.rows.add({n: one(n) for n in frame.numeric if n in self.params})
        return Frame(frame.rows, {n: new.get(n, h) for n, h in frame.held.items()})


class MultiDimensionalKMeans(_KMeans):
    """Each row becomes the nearest centre."""

    def learn(self, frame: Frame) -> dict:
        return {"names": frame.numeric, "centres": self._centres(frame, frame.numeric)}

    def apply(self, frame: Frame) -> Frame:
        names, centres = self.params["names"], self.params["centres"]
        distance = lambda c: sum(((frame.col(n) - v) * (frame.col(n) - v) for n, v in zip(names, c, strict=True)), F.lit(0.0))
        new = frame.rows.add({n: _nearest(distance, centres, lambda c, i=i: F.lit(c[i])) for i, n in enumerate(names)})
        return Frame(frame.rows, {n: new.get(n, h) for n, h in frame.held.items()})
