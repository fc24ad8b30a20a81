"""Operator 3, language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability is
the sum over all its segmentations into pieces, by the forward algorithm; a text's is the product
over its words (runs of letters, lower-cased, with the vocabulary's word mark in front). Piece
probabilities come from expected counts (forward-backward, a few rounds) over the words of a bounded
sample: of each language the first ``MAX_DOCS`` ids in the order of a hash, one text an id, as far as they
stay within ``MAX_FIT_BYTES`` together.

Texts are scored whole, with all lower-case letter pieces of the vocabulary and words of any length.
Many texts are cut into words at once, and each distinct word of such a batch goes through the forward
algorithm once, all words side by side; those beyond ``LONG`` letters go through it one by one, in time
proportional to their length.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text
where no language could be learned; very long texts go through in parts that end between words; ties
go to the first language by name; rows with a null lang teach nothing; a null doc_id is scored, not held
out, and teaches nothing; repeated rows give repeated results and teach once; of several texts of one
id in one language the first by digest teaches;
empty tables give no row; other columns stay.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import chunks
from .common import bounded, extended, gathered, held, id_crc, prepare, small, stored, table, texts, vocabulary_file
from .spans import SpanHash, code_points, cut_text, offsets_of

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
#: Texts of a language that are used to fit at most, and their bytes.
MAX_DOCS = 400
MAX_FIT_BYTES = 8 << 20
#: Letters of a word from which on it goes through the lattice alone.
LONG = 48
ROUNDS = 3
#: Words whose log probabilities a task remembers.
MAX_MEMO = 250_000
MAX_MEMO_CHARS = 8_000_000
BATCH_BYTES = 2 << 20
BATCH_CHARS = 2_000_000
_MARK = 0x2581
_SLOTS = 1_000_000
_TABLE_BITS = 20


class Vocabulary:
    """Lower-case letter pieces of a public vocabulary, found by hash."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            letters = piece.removeprefix(chr(_MARK))
            if (letters.isalpha() or not letters) and letters.lower() == letters:
                pieces.append(piece)
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        at = offsets_of([len(p) for p in pieces])
        self.keys = SpanHash(code_points("".join(pieces)))(at[:-1], at[1:])
        #: One more: a letter that is no piece; and one that stands for "no such piece".
        self.unknown = len(pieces)
        self.none = len(pieces) + 1
        # Two tables: a piece whose place in the first is taken goes to the second by other bits, the rest to a list.
        self.tables, rest = [], np.arange(len(pieces))
        for shift in (64 - _TABLE_BITS, 64 - 2 * _TABLE_BITS, 4):
            slots = self._slots(self.keys[rest], shift)
            places = np.full(1 << _TABLE_BITS, -1, dtype=np.int32)
            places[slots[::-1]] = rest[::-1]
            self.tables.append((shift, places))
            rest = rest[places[slots] != rest]
        if len(rest):
            raise ValueError("pieces share all their hash bits")
        # An empty place is -1 and so leads to the last key, which is no span's but for a chance of 2**-64.
        self.keys = np.append(self.keys, np.uint64(0))

    @staticmethod
    def _slots(keys: np.ndarray, shift: int) -> np.ndarray:
        return ((keys >> np.uint64(shift)) & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, ``none`` where there is none."""
        (shift, places), *others = self.tables
        found = places[self._slots(keys, shift)]
        out = np.where(self.keys[found] == keys, found, self.none)
        # Only a place that another piece holds may hide one.
        hidden = np.flatnonzero((found >= 0) & (out == self.none))
        for shift, places in others:
            found = places[self._slots(keys[hidden], shift)]
            right = (found >= 0) & (self.keys[found] == keys[hidden])
            out[hidden[right]] = found[right]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Words(NamedTuple):
    """The distinct words of a batch as one sequence of code points, and where each text has them."""

    words: list[str]
    symbols: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    #: For each occurrence, the distinct word; and the first occurrence of each text.
    inverse: np.ndarray
    docs: np.ndarray

    @classmethod
    def of(cls, words: list[str], inverse: np.ndarray, docs: np.ndarray) -> Words:
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        symbols = code_points("".join(chr(_MARK) + w for w in words))
        return cls(words, symbols, offsets_of(lengths)[:-1], lengths, inverse, docs)

    def only(self, which: np.ndarray) -> Words:
        """Some of the distinct words."""
        return Words.of([self.words[i] for i in which.tolist()], self.inverse, self.docs)


def words_of(batch: list[str]) -> Words:
    low = [t.lower() for t in batch]
    whole = "\n".join(["", *low, ""])
    letter = _letters()[code_points(whole)]
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    index: dict[str, int] = {}
    inverse = np.fromiter((index.setdefault(whole[i:j], len(index)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.int64, count=len(starts))
    # A line feed stands before each text.
    return Words.of(list(index), inverse, np.searchsorted(starts, offsets_of([len(t) + 1 for t in low])))


class Lattice:
    """All segmentations of words into pieces; words are held longest first, the first ones each alone."""

    def __init__(self, words: Words, known: Vocabulary) -> None:
        self.order = np.argsort(-words.lengths, kind="stable")
        starts, lengths = words.starts[self.order], words.lengths[self.order]
        self.known = known
        self.hash = SpanHash(words.symbols)
        self.alone = int(np.searchsorted(-lengths, -LONG, side="left"))
        self.single = list(zip(starts[: self.alone].tolist(), lengths[: self.alone].tolist(), strict=True))
        self.starts, self.lengths = starts[self.alone :], lengths[self.alone :]
        self.longest = int(self.lengths[0]) if len(self.lengths) else 0

    def pieces(self, end: int, size: int) -> np.ndarray:
        """For each word of at least ``end`` symbols, the piece of ``size`` symbols that ends there."""
        n = self.active(end)
        return self._found(self.starts[:n] + end, size)

    def _found(self, stop: np.ndarray, size: int) -> np.ndarray:
        found = self.known.find(self.hash(stop - size, stop))
        return np.where(found == self.known.none, self.known.unknown, found) if size == 1 else found

    def active(self, end: int) -> int:
        return int(np.searchsorted(-self.lengths, -end, side="right"))

    def arcs(self, start: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lattice of one word: where each piece in it begins and ends, and which it is, by end."""
        found = []
        for size in range(1, min(self.known.longest, length) + 1):
            ends = np.arange(size, length + 1)
            piece = self._found(start + ends, size)
            there = np.flatnonzero(piece != self.known.none)
            found.append(np.stack([ends[there] - size, ends[there], piece[there]]))
        begin, end, piece = np.concatenate(found, axis=1)
        order = np.argsort(end, kind="stable")
        return begin[order], end[order], piece[order]

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Log probability of each word (in the caller's order) under each column of (pieces + 2, languages)."""
        n, k = len(self.lengths), probability.shape[1]
        out = np.zeros((n, k))
        logs = np.zeros((n, k))
        ring = [np.ones((n, k))]
        for end in range(1, self.longest + 1):
            active = self.active(end)
            total = np.zeros((active, k))
            for size in range(1, min(end, self.known.longest) + 1):
                found = self.pieces(end, size)
                there = np.flatnonzero(found != self.known.none)
                if 2 * len(there) > active:
                    total += ring[-size][:active] * probability[found]
                elif len(there):
                    total[there] += ring[-size][there] * probability[found[there]]
            ring = [*ring[-(self.known.longest - 1) :], total]
            if end % 8 == 0:
                # Far from underflow again: what was divided out goes to the logarithms.
                most = np.maximum.reduce([r[:active] for r in ring])
                logs[:active] += np.log(most)
                ring = [r[:active] / most for r in ring]
            done = self.active(end + 1)
            out[done:active] = np.log(ring[-1][done:active]) + logs[done:active]
        back = np.empty((len(self.order), k))
        back[self.order[self.alone :]] = out
        if self.single:
            with np.errstate(divide="ignore"):
                weights = np.log(probability)
            for place, (start, length) in zip(self.order[: self.alone].tolist(), self.single, strict=True):
                begin, end, piece = self.arcs(start, length)
                back[place] = [_chain(begin, end, weights[piece, c], length)[-1] for c in range(k)]
        return back

    def expected(self, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece by words with these counts (in the caller's order)."""
        counts = counts[self.order].astype(float)
        out = np.zeros(len(probability))
        with np.errstate(divide="ignore"):
            weights = np.log(probability)
        for times, (start, length) in zip(counts[: self.alone].tolist(), self.single, strict=True):
            begin, end, piece = self.arcs(start, length)
            ahead = _chain(begin, end, weights[piece], length)
            behind = _chain(length - end[::-1], length - begin[::-1], weights[piece[::-1]], length)[::-1]
            uses = times * np.exp(ahead[begin] + weights[piece] + behind[end] - ahead[-1])
            out += np.bincount(piece, weights=uses, minlength=len(out))
        n, counts = len(self.lengths), counts[self.alone :]
        alpha = [np.ones(n)]
        used = []
        for end in range(1, self.longest + 1):
            active = self.active(end)
            total = np.zeros(active)
            for size in range(1, min(end, self.known.longest) + 1):
                found = self.pieces(end, size)
                there = np.flatnonzero(found != self.known.none)
                if len(there):
                    used.append((end, size, there, found[there]))
                    total[there] += alpha[end - size][there] * probability[found[there]]
            alpha.append(total)
        whole = np.concatenate([alpha[e][self.active(e + 1) : self.active(e)] for e in range(self.longest, 0, -1)]) if n else np.zeros(0)
        share = counts / np.maximum(whole, 1e-300)
        beta = [np.zeros(len(a)) for a in alpha]
        for e in range(1, self.longest + 1):
            beta[e][self.active(e + 1) : self.active(e)] = 1.0
        for end, size, there, found in reversed(used):
            flow = probability[found] * beta[end][there]
            beta[end - size][there] += flow
            out += np.bincount(found, weights=alpha[end - size][there] * flow * share[there], minlength=len(out))
        return out


def _chain(begin: np.ndarray, end: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Log sums over all paths from 0 to each place; arcs are in the order of their ends, and each place has one."""
    order = np.argsort(end, kind="stable")
    first = np.searchsorted(end[order], np.arange(1, length + 2)).tolist()
    begin, weights = begin[order].tolist(), weights[order].tolist()
    out = [0.0] * (length + 1)
    exp, log = math.exp, math.log
    for e in range(1, length + 1):
        terms = [out[begin[j]] + weights[j] for j in range(first[e - 1], first[e])]
        most = max(terms)
        out[e] = most + log(sum([exp(t - most) for t in terms])) if most > -math.inf else most
    return np.array(out)


class Model(NamedTuple):
    languages: tuple[str, ...]
    #: (pieces + 2, languages); the last row, for "no such piece", is 0.
    probability: np.ndarray


def fit_texts(by_language: dict[str, list[str]], known: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Piece probabilities by expected counts."""
    columns, names = [], []
    for name in sorted(by_language):
        words = words_of(by_language[name])
        if not len(words.lengths):
            continue
        counts = np.bincount(words.inverse, minlength=len(words.lengths))
        lattice = Lattice(words, known)
        p = np.full(known.none + 1, 1.0 / known.none)
        p[known.none] = 0.0
        for _ in range(rounds):
            uses = lattice.expected(p, counts)
            # A unit spread over all pieces: none is impossible, and an unknown letter is as rare as the rarest.
            p = (uses + 1.0 / known.none) / (uses.sum() + 1.0)
            p[known.none] = 0.0
        columns.append(p)
        names.append(name)
    return Model(tuple(names), np.stack(columns, axis=1) if columns else np.zeros((known.none + 1, 0)))


def fit(rows: DataFrame, path: str, max_docs: int = MAX_DOCS, max_bytes: int = MAX_FIT_BYTES) -> Model:
    """Fit on the first ``max_docs`` texts of each language of ``rows`` (doc_id, text, lang) in the order of a hash, within ``max_bytes``."""
    rows = rows.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    # Texts are read only for the ids that are chosen.
    narrow = rows.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(_SLOTS)).alias("slot"))
    counts = stored(narrow.groupBy("lang").agg(F.count("*").alias("n")))
    # Surely enough of a language's ids, so that the rest need not be sorted.
    share = F.least(F.lit(1.0), (2.0 * max_docs + 20) / F.col("n"))
    some = narrow.join(small(counts), "lang").filter(F.col("slot") < share * _SLOTS).select("lang", "doc_id", "slot").distinct()
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("slot", "doc_id"))).filter(F.col("k") <= max_docs)
    chosen = stored(first.select("lang", "doc_id", "k"))
    one = rows.join(small(chosen), ["lang", "doc_id"]).groupBy("lang", "k").agg(F.min_by(F.coalesce("text", F.lit("")), F.coalesce(F.md5("text"), F.lit(""))).alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    by_language: dict[str, list[str]] = {}
    for name, _, text in sorted(one.withColumn("upto", upto).filter(F.col("upto") <= max_bytes).select("lang", "k", "text").collect()):
        by_language.setdefault(name, []).append(text)
    return fit_texts(by_language, vocabulary(vocabulary_file(path)))


class Scorer:
    """Log probabilities of words, remembered from batch to batch up to a number of words."""

    def __init__(self, model: Model, known: Vocabulary, max_words: int = MAX_MEMO) -> None:
        self.model, self.known, self.max_words = model, known, max_words
        self.rows: dict[str, int] = {}
        self.chars = 0
        self.values = np.empty((1 << 12, len(model.languages)))

    def __call__(self, words: Words) -> np.ndarray:
        """A row for each distinct word."""
        if len(self.rows) > self.max_words or self.chars > MAX_MEMO_CHARS:
            self.rows.clear()
            self.chars = 0
        get = self.rows.get
        at = np.array([get(w, -1) for w in words.words], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            own = words.only(new)
            first = len(self.rows)
            at[new] = np.arange(first, first + len(new))
            if first + len(new) > len(self.values):
                bigger = np.empty((2 * (first + len(new)), self.values.shape[1]))
                bigger[:first] = self.values[:first]
                self.values = bigger
            self.values[first : first + len(new)] = Lattice(own, self.known).forward(self.model.probability)
            self.rows.update(zip(own.words, at[new].tolist(), strict=True))
            self.chars += len(own.symbols)
        return self.values[at]


def _scorer(model: Model, path: str) -> Scorer:
    """A worker keeps the scorer of the last model from task to task."""
    return held(f"language:{path}:{hash(model.languages)}:{hash(model.probability.tobytes())}", lambda: Scorer(model, vocabulary(vocabulary_file(path))))


#: Where a long text may be cut: after a character that is no letter.
_BORDER = re.compile(r"[\W\d_]")


def log_likelihoods(scorer: Scorer, batch: list[str], limit: int = BATCH_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its log probability under each language, and whether it has a word.

    A text beyond the limit goes through in parts, whose logarithms add up.
    """
    k = len(scorer.model.languages)
    if len(batch) == 1 and len(batch[0]) > limit and len(parts := cut_text(batch[0], _BORDER, limit)) > 1:
        each = [log_likelihoods(scorer, [p], len(p)) for p in parts]
        return sum(t for t, _ in each), np.any([s for _, s in each], axis=0)
    words = words_of(batch)
    if not len(words.lengths) or not k:
        return np.zeros((len(batch), k)), np.zeros(len(batch), dtype=bool)
    each = scorer(words)
    sums = np.zeros((len(words.inverse) + 1, k))
    np.cumsum(each[words.inverse], axis=0, out=sums[1:])
    return sums[words.docs[1:]] - sums[words.docs[:-1]], np.diff(words.docs) > 0


def predict(scorer: Scorer, batch: list[str], limit: int = BATCH_CHARS) -> tuple[list[str], list[float]]:
    """The likeliest language of each text, and its posterior under equal priors."""
    names = scorer.model.languages
    totals, some = log_likelihoods(scorer, batch, limit)
    if not names:
        return [UNDETERMINED] * len(batch), [0.0] * len(batch)
    best = totals.argmax(axis=1)
    score = 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
    return [names[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0).tolist()


def identify(docs: DataFrame, model: Model, path: str, text: str = "text") -> DataFrame:
    """Add lang_pred and lang_score to the rows; all columns stay, columns of those names are replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score")
    k = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value, path)
        for batch in gathered(bounded(batches, k), k, BATCH_BYTES):
            names: list[str] = []
            scores: list[float] = []
            for some in chunks(texts(batch.column(k)), BATCH_CHARS):
                a, b = predict(scorer, some)
                names += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, extended(docs, "lang_pred string, lang_score double"))


def teaches() -> Column:
    """Rows that may teach: those whose id's crc32 does not leave 2 by 4."""
    return F.coalesce(id_crc() % 4 != 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = VOCABULARY
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").filter(teaches()), path)
    found = identify(docs.select("doc_id", "text"), model, path)
    held_out = F.coalesce(id_crc() % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op3_language_id": op3_language_id}
