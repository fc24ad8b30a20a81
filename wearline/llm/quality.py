"""Operator 10, a quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is cut
into chunks of ``CHUNK`` bytes (all of them), and each chunk is compressed with either dictionary.
The difference of a chunk's two sizes, divided by their sum, says which dictionary knows it better; the
mean of that over the text's chunks, by their lengths, is the text's normalised difference. It alone goes into a logistic calibration, fitted on labelled texts that the dictionaries have not seen
and weighted back to the share of each label; the text's length is no feature.

Fitting uses a bounded sample: of each label the first ``MAX_ROWS`` rows in the order of a hash of the
id, one text an id, as far as the texts stay within ``MAX_FIT_BYTES`` together; three in four go to the
dictionaries and the fourth to the calibration. Only the sample is collected; scoring reads every text whole.

Defined cases: null and empty texts are one empty chunk and get the score that the calibration gives
a difference of 0; very long texts are compressed chunk by chunk; a null label teaches nothing; without
texts of both labels every score is the share of label 1 (0.5 without labels); repeated rows give
repeated results; repeated labels count repeatedly; of several texts of one id the first by digest
teaches; ties in the order of the sample go by id; a null doc_id is scored and never held out; empty
tables give no row; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, held, id_crc, prepare, raw_bytes, table

#: Labelled rows of either label that are used to fit at most, and the bytes of their texts.
MAX_ROWS = 800
MAX_FIT_BYTES = 32 << 20
DICT_BYTES = 1 << 17
CHUNK = 512
#: Of so many texts of the sample one goes to the calibration.
CALIBRATE = 4
LEVEL = 3
#: The least score that is predicted as label 1.
CUT = 0.3
_SLOTS = 1_000_000


def cut(text: bytes, size: int = CHUNK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


class Model(NamedTuple):
    good: bytes
    bad: bytes
    #: Calibration: slope and bias of the log odds over the difference, and the range of differences seen there.
    slope: float
    bias: float
    low: float
    high: float
    #: The score where no dictionaries could be built.
    share: float


class Sizer:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL) -> None:
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_dict_id=0, write_checksum=0)
        self.both = []
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(compression_params=params)
            self.both.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress)

    def sizes(self, text: bytes) -> list[tuple[int, int, int]]:
        """Of each chunk its length and its compressed sizes (good, bad)."""
        good, bad = self.both
        return [(len(c), len(good(c)), len(bad(c))) for c in cut(text)]

    def __call__(self, text: bytes) -> float:
        """The normalised difference, above 0 where the good dictionary knows more."""
        total = weights = 0.0
        for n, good, bad in self.sizes(text):
            total += (n + 1) * (bad - good) / (bad + good)
            weights += n + 1
        return total / weights


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the bias is the last weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * weight.sum() / 100)
    penalty[-1] = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def build_dictionary(documents: list[bytes], size: int = DICT_BYTES) -> bytes:
    samples = [c for text in documents for c in cut(text, 512) if len(c) >= 32]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # Too little text to train on: the text itself is the dictionary.
        return b"".join(documents)[-size:]


def fit_rows(rows: list[tuple[int, bytes]], counts: dict[int, int]) -> Model:
    """A model from labelled texts in a fixed order; ``counts``: how many rows of each label there are in all."""
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    by = {label: [t for q, t in rows if q == label] for label in (0, 1)}
    if min(map(len, by.values())) < 2:
        return Model(b"", b"", 0.0, 0.0, 0.0, 0.0, share)
    good, bad = (build_dictionary([t for i, t in enumerate(by[label]) if i % CALIBRATE != 1]) for label in (1, 0))
    sizer = Sizer(good, bad)
    rest = [(label, t) for label in (0, 1) for t in by[label][1::CALIBRATE]]
    x = np.array([sizer(t) for _, t in rest])
    y = np.array([label for label, _ in rest], dtype=float)
    own = {label: sum(1 for q, _ in rest if q == label) for label in (0, 1)}
    weight = np.array([counts[q] / own[q] for q, _ in rest]) * len(rest) / total
    # Scaled for the penalty, which holds the slope where the labels are told apart without an error.
    scale = x.std() + 1e-9
    slope, bias = logistic(x[:, None] / scale, y, weight)
    return Model(good, bad, slope / scale, bias, x.min(), x.max(), share)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_FIT_BYTES) -> Model:
    """Fit on the first ``max_rows`` rows of either label: ``docs`` (doc_id, text), ``labels`` (doc_id, quality)."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        # Surely enough rows: the rest need not be sorted.
        share = F.when(F.col("quality") == label, F.lit(min(1.0, (2 * max_rows + 20) / n))).otherwise(share)
    some = known.withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(_SLOTS))).filter(F.col("slot") < share * _SLOTS)
    first = Window.partitionBy("quality").orderBy("slot", "doc_id")
    chosen = some.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= max_rows)
    joined = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = joined.groupBy("quality", "k").agg(F.min_by("text", F.md5("text")).alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    rows = one.withColumn("upto", upto).filter(F.col("upto") <= max_bytes).select("quality", "k", "text").collect()
    return fit_rows([(q, bytes(t)) for q, _, t in sorted(rows)], counts)


def scores_of(model: Model, documents: list[bytes], sizer: Sizer | None = None) -> np.ndarray:
    if not documents or not model.good:
        return np.full(len(documents), model.share)
    sizer = sizer or Sizer(model.good, model.bad)
    x = np.clip(np.array([sizer(t) for t in documents]), model.low, model.high)
    return 1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -30, 30)))


def _sizer(good: bytes, bad: bytes) -> Sizer:
    return held(f"quality:{hash(good)}:{hash(bad)}", lambda: Sizer(good, bad))


def score(docs: DataFrame, model: Model, text: str = "text", cut_at: float = CUT) -> DataFrame:
    """doc_id, score and predicted for every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizer = _sizer(own.good, own.bad) if own.good else None
        for batch in bounded(batches, 1):
            found = scores_of(own, raw_bytes(batch.column(1)), sizer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array((found >= cut_at).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_crc() % 5 == 0, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
