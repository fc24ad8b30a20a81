"""Operator 6, secret scans by assignment-aware lexing.

Three base patterns come first (an assignment to a sensitive word, an access key id, a long
hexadecimal run). Then a lexer reads each assignment around ``=``, ``:``, ``:=`` or ``=>``: the name
on its left (an identifier, bare or quoted, dotted or dashed) and the expression on its right (string
literals, bare words and names, joined by ``+``). Names stand for the literal last assigned to them
before, so a value reaches a sensitive name through constants too, from however many literals it is
put together. A literal's score is the sensitivity of the names it flows to, times how much the whole
value looks like a key and not like a word or a placeholder. Literals that score at least ``THRESHOLD``
and lie in no base span are added.

Names and values have any length; a bare word ends at ``=`` (but for the padding of base64), so each
character belongs to one name and one value and a text is read in time proportional to its length.

Defined cases: a null text is empty; an empty text has no span; very long texts are read whole; of
ties, spans with one start are listed as :data:`KINDS` has them and then by their end; repeated rows
give repeated results; an empty table gives no row; other columns stay, but one called ``secrets``, which
is replaced. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded, extended, prepare, table, texts

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_MARK = bytes(0x68 if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66 else 0x20 for b in range(256))
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: How sensitive a name is by the words in it; the most sensitive counts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0,
    "signingkey": 0.9, "encryptionkey": 0.9, "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "key": 0.5, "pass": 0.7, "pw": 0.7,
}
_STEMS = ("pass", "secret", "token", "key", "pwd", "pw", "credential", "bearer", "auth")
#: Values that stand for a secret and are none.
PLACEHOLDERS = frozenset("changeme example placeholder password secret token none null true false undefined redacted hidden default dummy test your_password your_token".split())
THRESHOLD = 0.5
#: The first characters of a value that are kept: more than a placeholder or a telling prefix has.
_HEAD = 16

_OPERATOR = re.compile(r":=|=>|[=:]")
#: A name, read backwards from its end.
_EMAN = re.compile(r"[\w.\-]+", re.ASCII)
_ATOM = re.compile(
    r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|(?:(?:b|r|f|u)(?=["']))?([A-Za-z0-9_+/.~!@#$%^&*-]+(?:={1,2}(?![=\w"'`]))?))""", re.ASCII
)
_PLUS = re.compile(r"[ \t]*\+(?![+=])")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z", re.ASCII)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    #: The secret itself, inside the span.
    value_start: int
    value_end: int
    score: float


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(stem in low for stem in _ASSIGN_STEMS):
        found += [Span(m.start(), m.end(), "assign", m.start(2), m.end(2), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [Span(m.start(), m.end(), "access", m.start(), m.end(), 1.0) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # One byte for each code point, but for those beyond Latin-1, which become "?".
    if b"h" * LEAST["hex"] in text.encode("latin-1", "replace").translate(_HEX_MARK):
        found += [Span(m.start(), m.end(), "hex", m.start(), m.end(), 1.0) for m in _HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return found


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _SPLIT.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *pairs]), default=0.0)


class Profile(NamedTuple):
    """What tells a key from other values; that of a joined value follows from those of its parts."""

    size: float
    head: str
    #: Which kinds of characters occur: lower case, upper case, digits, others; and the space.
    kinds: tuple[bool, bool, bool, bool, bool]
    #: How often each character occurs; those beyond ASCII share 128 symbols.
    counts: dict[int, float]

    @classmethod
    def of(cls, literal: str) -> Profile:
        found = Counter(literal)
        counts: Counter[int] = Counter()
        for c, n in found.items():
            counts[ord(c) if ord(c) < 128 else 128 + ord(c) % 128] += n
        kinds = *(any(f(c) for c in found) for f in (str.islower, str.isupper, str.isdigit)), any(not c.isalnum() for c in found), " " in found
        return cls(len(literal), literal[:_HEAD], kinds, counts)

    def joined(self, other: Profile) -> Profile:
        # Only proportions matter in long values, such as names that double themselves line by line.
        scale = 2.0**-30 if self.size + other.size > 2.0**60 else 1.0
        counts = {c: n * scale for c, n in self.counts.items()}
        for c, n in other.counts.items():
            counts[c] = counts.get(c, 0.0) + n * scale
        kinds = tuple(a or b for a, b in zip(self.kinds, other.kinds, strict=True))
        return Profile((self.size + other.size) * scale, (self.head + other.head)[:_HEAD], kinds, counts)

    def keyness(self) -> float:
        low = self.head.lower()
        lower, upper, digit, other, space = self.kinds
        if self.size < 8 or (self.size <= _HEAD and low in PLACEHOLDERS) or low.startswith(("${", "<", "{{", "%(", "http://", "https://", "/", "./")) or space:
            return 0.0
        bits = -sum(c / self.size * math.log2(c / self.size) for c in self.counts.values() if c)
        mixed = digit or lower + upper + digit + other >= 3
        return min(1.0, bits / 3.0) * (1.0 if mixed else 0.4)


def keyness(literal: str) -> float:
    """From 0 to 1, how much a literal looks like a key: long enough, mixed, no placeholder, no prose."""
    return Profile.of(literal).keyness()


class Value:
    """The literals that a value is put together from: one of its own, or those of other values."""

    __slots__ = ("parts", "place", "seen")

    def __init__(self, place: tuple[int, int] | None, parts: tuple[Value, ...] = ()) -> None:
        self.place, self.parts, self.seen = place, parts, False


class Assignment(NamedTuple):
    name: str
    #: Of the expression: literals (start, end) and names (text).
    parts: tuple[tuple[int, int] | str, ...]


def assignments(text: str) -> Iterator[Assignment]:
    """The assignments of a text, in order."""
    border = 0
    for op in _OPERATOR.finditer(text):
        at, since, border = op.start(), border, op.end()
        if text[op.end() : op.end() + 1] in ("=", "/", ">") or text[at - 1 : at] in ("=", "!", "<", ">", ":"):
            continue
        # A name holds no operator, so it begins after the last one.
        left = text[since:at].rstrip(" \t").rstrip("\"'`] \t")
        run = _EMAN.match(left[::-1])
        name = run[0][::-1].lstrip("0123456789.-") if run else ""
        if not name:
            continue
        parts: list[tuple[int, int] | str] = []
        end = op.end()
        while (atom := _ATOM.match(text, end)) is not None:
            group = atom.lastindex or 4
            if group == 4 and _IDENTIFIER.match(atom[4]) and not any(c.isdigit() for c in atom[4]):
                parts.append(atom[4])
            if group != 4 or not parts or not isinstance(parts[-1], str):
                parts.append((atom.start(group), atom.end(group)))
            end = atom.end()
            plus = _PLUS.match(text, end)
            if plus is None:
                break
            end = plus.end()
        if parts:
            yield Assignment(name, tuple(parts))


def literal_spans(text: str) -> list[Span]:
    """Literals that flow to sensitive names, with their scores."""
    low = text.lower()
    if not ("=" in low or ":" in low) or not any(stem in low for stem in _STEMS):
        return []
    known: dict[str, tuple[Value, Profile]] = {}
    judged: list[tuple[float, Value]] = []
    for found in assignments(text):
        parts: list[tuple[Value, Profile]] = []
        for part in found.parts:
            if not isinstance(part, str):
                parts.append((Value(part), Profile.of(text[part[0] : part[1]])))
            elif part in known:
                parts.append(known[part])
        if not parts:
            known.pop(found.name, None)
            continue
        value, profile = parts[0]
        if len(parts) > 1:
            value, profile = Value(None, tuple(v for v, _ in parts)), reduce(Profile.joined, (p for _, p in parts))
        known[found.name] = value, profile
        # What is put together is judged together: each part belongs to the key.
        score = sensitivity(found.name) * profile.keyness()
        if score >= THRESHOLD:
            judged.append((score, value))
    # The highest scores first: each value hands its literals the first score that reaches it.
    scores: dict[tuple[int, int], float] = {}
    for score, value in sorted(judged, key=lambda j: -j[0]):
        reached = [value]
        while reached:
            now = reached.pop()
            if now.seen:
                continue
            now.seen = True
            if now.place is not None:
                scores.setdefault(now.place, score)
            reached += now.parts
    return [Span(s, e, "literal", s, e, round(x, 4)) for (s, e), x in scores.items() if e > s]


def spans_of(text: str) -> list[Span]:
    """All spans, by start and then by kind."""
    base = base_spans(text)
    # Of the base spans that begin at or before a literal, the furthest end decides whether one covers it.
    starts = sorted(s.start for s in base)
    ends = list(accumulate((s.end for s in sorted(base, key=lambda s: s.start)), max))
    added = [s for s in literal_spans(text) if not (k := bisect_right(starts, s.start)) or ends[k - 1] < s.end]
    return sorted([*base, *added], key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redacted(text: str, spans: list[Span], mask: str = "[redacted]") -> str:
    """The text with every secret value replaced."""
    out, at = [], 0
    for start, end in sorted((s.value_start, s.value_end) for s in spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets``, an array of (kind, start, end, value_start, value_end, score), to the rows; other columns stay."""
    prepare(docs.sparkSession)
    docs = docs.drop("secrets")
    k = docs.columns.index(text)
    fields = (("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32()), ("score", pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, k):
            lists = [[s._asdict() for s in spans_of(t)] for t in texts(batch.column(k))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.struct(list(fields))))], [*batch.schema.names, "secrets"])

    return docs.mapInArrow(run, extended(docs, "secrets array<struct<kind:string,start:int,end:int,value_start:int,value_end:int,score:double>>"))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows and columns with all secret values masked; ``n_chars`` follows where the text changes. A null text stays null."""
    prepare(docs.sparkSession)
    k = docs.columns.index(text)
    n = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, k):
            columns = list(batch.columns)
            old = columns[k].to_pylist()
            new = [t if not t or not (spans := spans_of(t)) else redacted(t, spans) for t in old]
            columns[k] = pa.array(new, columns[k].type)
            if n is not None:
                counts = [c if a == b else len(b) for a, b, c in zip(old, new, columns[n].to_pylist(), strict=True)]
                columns[n] = pa.array(counts, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"] != "literal")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op6_secret_scan": op6_secret_scan}
