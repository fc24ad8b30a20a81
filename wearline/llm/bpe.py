"""Operator 5, byte-level BPE by a lazily determinised finite-state transducer.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when each adjacent pair
encodes to itself (a merge never depends on what lies beyond a token that stays whole). So every
prefix of a piece has one last token, and the encodings of its prefixes form a tree. The transducer
reads a piece byte by byte; its state is the bytes not yet settled with the last tokens of their
prefixes, and beside it stands the last emitted token, which is asked only where a token begins right
after it. A token is emitted as soon as every token start that is still possible (the end of what was read, and
each place from which the rest is the beginning of some token) has it on its way: the lookahead is
bounded by the longest token. States and transitions are built when first met and kept in a table
of bounded size; a full table is dropped and grows anew, which changes no result.

Decoding. Tokens are put together while an incremental UTF-8 machine reads them; its table has one
step for each (state, token), so that text can be given out up to the last complete character.

What a worker remembers of pieces is kept under the pieces themselves, up to a number of them and of
their characters; pieces are equal only if all their characters are.

Defined cases: a null text is empty; an empty text has no tokens; very long texts go through in parts
that end at a border of pieces, and a very long piece goes through the transducer byte by byte; of ties
between merges the leftmost goes first; rows are independent, so repeated rows give repeated results;
an empty table gives no row; only the columns doc_id and text are read, whatever others are named.
A piece that is itself a token is that token, as the tiktoken library has it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, extended, held, prepare, table, texts, vocabulary_file
from .spans import code_points, cut_text, offsets_of, ragged

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Entries of the transition tables and of the memo of whole pieces, per worker.
MAX_TRANSITIONS = 500_000
MAX_PIECES = 250_000
MAX_PIECE_CHARS = 8_000_000
#: A longer piece is encoded anew each time.
MAX_PIECE = 64
#: Code points that are cut into pieces together.
CHUNK_CHARS = 300_000

#: The split that :func:`pieces_of` does without a pattern engine; other patterns go through ``regex``.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """BPE by definition: merge the leftmost pair of the lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if best == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = MAX_TRANSITIONS) -> None:
        self.ranks = ranks
        self.max_transitions = max_transitions
        self.longest = max(map(len, ranks))
        self.bytes_of = {r: t for t, r in ranks.items()}
        #: Tokens that encode to themselves (others never come out of merges), with the two parts of their last merge.
        self.parts: dict[int, tuple[int, int] | None] = {}
        #: Tokens whose parts do not all rank below them: pairs with these are compared by definition.
        self.odd: set[int] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._derive(token, rank)
        self.tokens = {self.bytes_of[r]: r for r in self.parts}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.spines: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _derive(self, token: bytes, rank: int) -> None:
        if len(token) == 1:
            self.parts[rank] = None
            return
        parts = [token[i : i + 1] for i in range(len(token))]
        ranks, top = self.ranks, 1 << 40
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
            if best == top:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        left, right = ranks[parts[0]], ranks[parts[1]]
        self.parts[rank] = (left, right)
        low = lambda part: len(self.bytes_of[part]) == 1 or part < rank and part not in self.odd
        if not (low(left) and low(right)):
            self.odd.add(rank)

    def _clear(self) -> None:
        self.ids: dict[tuple[bytes, tuple[int, ...]], int] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...], int]] = {}
        self.if_fits: dict[int, tuple[int, tuple[int, ...], int]] = {}
        self.lasts: list[tuple[bytes, tuple[int, ...]]] = []
        self.ends: list[tuple[int, ...]] = []
        self.start = self._state(b"", (-1,))

    def _state(self, pending: bytes, last: tuple[int, ...]) -> int:
        """The number of a state, times 256; ``last[j]`` is the last token of ``pending[:j]``, -2 if no token ends there."""
        number = self.ids.get((pending, last))
        if number is None:
            number = self.ids[pending, last] = len(self.lasts)
            self.lasts.append((pending, last))
            self.ends.append(tuple(self._path(last, len(pending))))
        return number << 8

    def _path(self, last: tuple[int, ...], at: int) -> list[int]:
        found = []
        while at > 0 and last[at] >= 0:
            found.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return found[::-1]

    def _spine(self, token: int) -> tuple[list, list]:
        """The parts of a token at its right and at its left end: (bytes, made at, used up at)."""
        known = self.spines.get(token)
        if known is None:
            known = ([], [])
            for side in (1, 0):
                part, used = token, 1 << 40
                while True:
                    split = self.parts[part]
                    known[1 - side].append((self.bytes_of[part], -1 if split is None else part, used))
                    if split is None:
                        break
                    part, used = split[side], part
            self.spines[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay as they are."""
        if left < 0:
            return True
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.max_transitions:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """No merge across the border comes while both its sides are whole: of equal ranks the leftmost goes first."""
        if left in self.odd or right in self.odd:
            return merge_by_rank(self.ranks, self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        ranks = self.ranks
        for a, made_a, used_a in self._spine(left)[0]:
            for b, made_b, used_b in self._spine(right)[1]:
                if made_a < used_b and made_b < used_a and (rank := ranks.get(a + b)) is not None:
                    when = max(rank, made_a, made_b)
                    if when < used_a and (when < used_b or when == rank == used_b):
                        return False
        return True

    def _build(self, state: int, byte: int, fit: bool | None) -> tuple[int, tuple[int, ...], int]:
        """The step from a state on a byte; ``fit`` says whether a token from the state's start on may be used."""
        pending, last = self.lasts[state >> 8]
        pending += bytes((byte,))
        n = len(pending)
        at_start = self.tokens.get(pending, -1) if n <= self.longest else -1
        if at_start >= 0 and fit is None:
            step = self.steps[state | byte] = (0, (), at_start)
            return step
        new = -2
        if fit and at_start >= 0:
            new = at_start
        else:
            for start in range(max(1, n - self.longest), n):
                if last[start] != -2:
                    token = self.tokens.get(pending[start:])
                    if token is not None and self.fits(last[start], token):
                        new = token
                        break
        last = (*last, new)
        # Where the token that holds the next byte may begin, and the tokens up to there.
        settled: list[int] = []
        if pending not in self.prefixes:
            open_at = [p for p in range(1, n) if last[p] != -2 and pending[p:] in self.prefixes]
            if new != -2:
                open_at.append(n)
            ways = [self._path(last, p) for p in open_at]
            if ways:
                first, final = min(ways), max(ways)
                k = 0
                while k < min(len(first), len(final)) and first[k] == final[k]:
                    k += 1
                settled = first[:k]
        cut = sum(len(self.bytes_of[t]) for t in settled)
        if cut:
            pending, last = pending[cut:], self._rebased(last[cut:])
        step = (self._state(pending, last), tuple(settled), -1)
        if fit is None:
            self.steps[state | byte] = step
        else:
            self.if_fits[(state | byte) << 1 | fit] = step
        return step

    def _rebased(self, last: tuple[int, ...]) -> tuple[int, ...]:
        """After a cut, only positions whose tokens lead back to it remain."""
        out = [-1]
        for j in range(1, len(last)):
            start = j - len(self.bytes_of[last[j]]) if last[j] >= 0 else -1
            out.append(last[j] if start >= 0 and out[start] != -2 else -2)
        return tuple(out)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.steps) + len(self.if_fits) > self.max_transitions:
            self._clear()
        get, get_if, pairs = self.steps.get, self.if_fits.get, self.pairs.get
        state, before, out = self.start, -1, []
        for byte in piece:
            step = get(state | byte)
            if step is None:
                step = self._build(state, byte, None)
            token = step[2]
            if token >= 0:
                fit = before < 0
                if not fit:
                    fit = pairs(before << 20 | token)
                    if fit is None:
                        fit = self.fits(before, token)
                key = (state | byte) << 1 | fit
                step = get_if(key)
                if step is None:
                    step = self._build(state, byte, fit)
            state = step[0]
            if step[1]:
                out += step[1]
                before = out[-1]
        out += self.ends[state >> 8]
        return out


class Utf8Decoder:
    """Bytes of tokens to text, as soon as characters are complete.

    The machine's state is what the character begun still needs: the number of continuation bytes
    and the least and greatest value of the next one (RFC 3629). Steps by whole tokens are kept.
    """

    START = (0, 0x80, 0xBF)

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self.steps: dict[tuple[tuple[int, int, int], int], tuple[int, int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.state: tuple[int, int, int] = self.START
        self.held = b""

    @staticmethod
    def next_state(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
        """The state after a byte, None where the bytes are no UTF-8."""
        need, low, high = state
        if need:
            return (need - 1, 0x80, 0xBF) if low <= byte <= high else None
        if byte < 0x80:
            return state
        if 0xC2 <= byte <= 0xDF:
            return (1, 0x80, 0xBF)
        if 0xE0 <= byte <= 0xEF:
            return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
        if 0xF0 <= byte <= 0xF4:
            return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
        return None

    def step(self, state: tuple[int, int, int], token: int) -> tuple[int, int, int] | None:
        key = (state, token)
        if key not in self.steps:
            now: tuple[int, int, int] | None = state
            for byte in self.bytes_of[token]:
                now = self.next_state(now, byte)
                if now is None:
                    break
            self.steps[key] = now
        return self.steps[key]

    def feed(self, token: int) -> str:
        """The characters that this token completes; ValueError where the bytes are no UTF-8."""
        after = self.step(self.state, token)
        if after is None:
            raise ValueError(f"token {token} breaks a character")
        data = self.held + self.bytes_of[token]
        self.state = after
        if not after[0]:
            self.held = b""
            return data.decode()
        cut = len(data) - 1
        while data[cut] & 0xC0 == 0x80:
            cut -= 1
        self.held = data[cut:]
        return data[:cut].decode()

    def complete(self, tokens: list[int]) -> bool:
        """Whether the tokens, from a character's start, are whole characters."""
        state: tuple[int, int, int] | None = self.START
        for token in tokens:
            state = self.step(state, token)
            if state is None:
                return False
        return not state[0]


SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

#: Where a text may be cut before it is split: a word's end before one space and a letter is a border of pieces.
_BORDER = regex.compile(r"\p{L}(?= \p{L})")
#: Tokens that are decoded together.
CHUNK_TOKENS = 1 << 20


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point, by the pattern's own engine."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            points = code_points(found[0])
            out[points] = kind
    return out


def pieces_of(points: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where the matches of :data:`KNOWN_PATTERN` start; ``docs``: where texts start (non-empty ones, ascending).

    Runs of one class become pieces; of white space before a run, the last character stands apart,
    and joins the run if it is a space; an apostrophe takes the letters of a contraction.
    """
    n = len(points)
    kinds = _classes()[points]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    first = np.zeros(n + 1, dtype=bool)
    first[docs] = True
    first[n] = True
    edge |= first[:n]
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    kind = kinds[starts]
    inner = ~first[ends]  # the text goes on after the run
    spaces = (kind == SPACE) & inner
    joins = spaces & (points[ends - 1] == 0x20)
    own = np.ones(len(starts), dtype=bool)
    own[1:] &= ~joins[:-1]
    mark = np.zeros(n, dtype=bool)
    quotes = np.flatnonzero((kind == OTHER) & (ends - starts == 1) & inner & own & (points[starts] == 0x27))
    quotes = quotes[kind[quotes + 1] == LETTER] if len(quotes) else quotes
    if len(quotes):
        run = quotes + 1
        at = starts[run]
        one = points[at]
        long = ends[run] - at >= 2
        two = np.where(long, points[np.minimum(at + 1, n - 1)], 0)
        a = ord
        k = np.where(np.isin(one, [a("s"), a("t"), a("m"), a("d")]), 1, 0)
        k = np.where((two == a("e")) & ((one == a("r")) | (one == a("v"))) | (one == a("l")) & (two == a("l")), 2, k)
        run, at, k = run[k > 0], at[k > 0], k[k > 0]
        own[run] = False
        rest = at + k
        mark[rest[rest < ends[run]]] = True
    mark[starts[own]] = True
    mark[ends[spaces] - 1] = True
    return np.flatnonzero(mark)


class _Pieces(dict):
    """Pieces to their tokens, filled when first asked for."""

    def __init__(self, encode: Callable[[bytes], list[int]]) -> None:
        self.encode = encode
        self.chars = 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= MAX_PIECE:
            self[piece] = ids
            self.chars += len(piece)
        return ids

    def trim(self, pieces: int, chars: int = MAX_PIECE_CHARS) -> None:
        if len(self) > pieces or self.chars > chars:
            self.clear()
            self.chars = 0


class Codec:
    """Texts to token ids and back, many at a time."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, max_pieces: int = MAX_PIECES) -> None:
        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.decoder = Utf8Decoder(self.transducer.bytes_of)
        self.split: Callable | None = None if pattern == KNOWN_PATTERN else regex.compile(pattern).finditer
        self.max_pieces = max_pieces
        self.memo = _Pieces(self.transducer.encode)
        top = max(self.ranks.values()) + 1
        lengths = np.zeros(top, dtype=np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.token_lengths = lengths
        self.token_offsets = np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.transducer.bytes_of.get(r, b"") for r in range(top)), dtype=np.uint8)
        self.closed = np.array([r in self.transducer.bytes_of and self.decoder.step(Utf8Decoder.START, r) == Utf8Decoder.START for r in range(top)])

    def _starts(self, text: str, points: np.ndarray, docs: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.split is None:
            return pieces_of(points, docs)
        return np.array([m.start() for d, e in zip(docs, ends, strict=True) for m in self.split(text, int(d), int(e))], dtype=np.int64)

    def encode(self, batch: list[str], limit: int = CHUNK_CHARS) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and where each text's begin (one more at the end).

        A text beyond the limit goes through in parts, whose tokens are the whole text's.
        """
        if self.split is None and len(batch) == 1 and len(batch[0]) > limit:
            tokens = np.concatenate([self._encode([part])[0] for part in cut_text(batch[0], _BORDER, limit)])
            return tokens, np.array([0, len(tokens)])
        return self._encode(batch)

    def _encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(batch)
        at = offsets_of([len(t) for t in batch])
        if not text:
            return np.zeros(0, dtype=np.int64), np.zeros(len(batch) + 1, dtype=np.int64)
        points = code_points(text)
        filled = at[:-1][np.diff(at) > 0]
        starts = self._starts(text, points, filled, np.append(filled[1:], len(text)))
        bounds = [*starts.tolist(), len(text)]
        self.memo.trim(self.max_pieces)
        found = [self.memo[text[i:j]] for i, j in pairwise(bounds)]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        upto = offsets_of(counts)
        tokens = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(upto[-1]))
        return tokens, upto[np.searchsorted(starts, at)]

    def decode(self, tokens: np.ndarray) -> bytes:
        parts = (tokens[i : i + CHUNK_TOKENS] for i in range(0, len(tokens), CHUNK_TOKENS))
        return b"".join(self.token_bytes[ragged(self.token_offsets[p], self.token_lengths[p])].tobytes() for p in parts)

    def whole_characters(self, tokens: np.ndarray) -> bool:
        """Whether the tokens decode to UTF-8: only runs of tokens that are not whole characters go through the machine."""
        open_at = np.flatnonzero(~self.closed[tokens])
        if not len(open_at):
            return True
        runs = np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1)
        return all(self.decoder.complete(tokens[r].tolist()) for r in runs)


def codec(path: str, pattern: str) -> Codec:
    """A worker's codec; a name without a folder is looked up where the worker runs."""
    return held(f"bpe:{path}:{pattern}", lambda: Codec(vocabulary_file(path), pattern))


def chunks(batch: list[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of up to ``limit`` characters together; a longer one stands alone, whole."""
    some: list[str] = []
    size = 0
    for text in batch:
        if some and size + len(text) > limit:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def tokenize(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """Add ``tokens`` (array of int) to the rows; all columns stay, a column of that name is replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop("tokens")
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in bounded(batches, k):
            parts, lengths = [np.zeros(0, dtype=np.int64)], []
            for some in chunks(texts(batch.column(k))):
                tokens, at = own.encode(some)
                parts.append(tokens)
                lengths += np.diff(at).tolist()
            values = pa.array(np.concatenate(parts).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets_of(lengths), type=pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "tokens"])

    return docs.mapInArrow(run, extended(docs, "tokens array<int>"))


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", with_tokens: bool = False) -> DataFrame:
    """Encode, decode and digest each text: doc_id, n_tokens, ids_sha256, decoded_sha256, utf8_whole, and tokens if wanted."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in bounded(batches, 1):
            rows: list[tuple[int, str, str, bool]] = []
            parts = [np.zeros(0, dtype=np.int64)]
            for some in chunks(texts(batch.column(1))):
                tokens, at = own.encode(some)
                if with_tokens:
                    parts.append(tokens)
                for i in range(len(some)):
                    ids = tokens[at[i] : at[i + 1]]
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), own.whole_characters(ids)))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            arrays = [batch.column(0), *(pa.array(list(c), type=t) for c, t in zip(columns, kinds, strict=True))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "utf8_whole"]
            if with_tokens:
                offsets = pa.array(offsets_of(list(columns[0])), type=pa.int32())
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).astype(np.int32))))
                names.append("tokens")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, utf8_whole boolean" + ", tokens array<int>" * with_tokens
    return docs.select("doc_id", text).mapInArrow(run, schema)


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), RANKS)


QUERIES = {"op5_byte_level_bpe": op5_byte_level_bpe}
