"""Operator 7, media columns by signature sniffing.

An Aho-Corasick automaton over the magic bytes of the known formats reads a blob once. Each place
it finds goes to the format's validator, which walks the structure (chunks, segments, pages, size
fields, checksums) and says how long the object is, or that there is none. The object at offset 0
gives the blob's true type and so corrects a declared one; objects that begin later are carved,
outermost first, except those inside the outer one's plain samples when that is all it holds.

``wrap`` stores any bytes losslessly as 8-bit samples of a WAV file; ``unwrap`` reads them back from
the carved data chunk.

Defined cases: a null text is empty; an empty text is stored as 64 zero bytes; a blob that begins
with no valid object is ``application/octet-stream``; of ties, objects with one offset, the longest
comes first and then the first by type; repeated rows give repeated results; an empty table gives no
row; text_as_media reads no columns but doc_id and its text, sniff_column keeps all but those that it
adds. Blobs are read whole; a WAV file holds less than 4 GB, a Spark string 2 GB.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, extended, prepare, raw_bytes, table

UNKNOWN = "application/octet-stream"
UNIT = 64


def _wav(b: bytes, at: int) -> int | None:
    """RIFF size, WAVE, a format chunk and a data chunk that fit."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    seen, p = set(), at + 12
    while p + 8 <= end:
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + size > end:
            return None
        seen.add(b[p : p + 4])
        p += 8 + size + (size & 1)
    return end - at if {b"fmt ", b"data"} <= seen else None


def _png(b: bytes, at: int) -> int | None:
    """Chunks with right checksums, from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        stop = p + 12 + size
        if stop > len(b) or (kind == b"IHDR") != first or zlib.crc32(b[p + 4 : p + 8 + size]) != int.from_bytes(b[stop - 4 : stop], "big"):
            return None
        if kind == b"IEND":
            return stop - at
        p, first = stop, False
    return None


def _gif(b: bytes, at: int) -> int | None:
    """Screen, colour tables and blocks up to the trailer."""
    if len(b) < at + 13:
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    """Segments with lengths, a frame and a scan, and the end marker."""
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        if marker == 0xD9:
            return p + 2 - at if frame else None
        if marker in (0x01, 0xFF) or 0xD0 <= marker <= 0xD8:
            return None
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2:
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if marker == 0xDA:
            while 0 <= (p := b.find(b"\xff", p)) and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(b):
                return None
            if b[p + 1] == 0xD9:
                return p + 2 - at if frame else None
    return None


_TRAILER = re.compile(rb"startxref[\r\n\t ]+(\d{1,10})[\r\n\t ]+%%EOF")
_TABLE = re.compile(rb"xref|\d{1,10} \d{1,5} obj")
#: Trailers of PDFs inside a PDF that come before its own first one, at most.
INNER_TRAILERS = 16


class _Once:
    """What a pattern finds in a blob, for as long as that blob is asked about."""

    def __init__(self, find: Callable[[bytes], object]) -> None:
        self.find, self.blob, self.found = find, None, None

    def __call__(self, blob: bytes):  # noqa: ANN204
        if self.blob is not blob:
            self.blob, self.found = blob, self.find(blob)
        return self.found


_trailers = _Once(lambda b: [(m.start(), m.end(), int(m[1])) for m in _TRAILER.finditer(b)])


def _pdf(b: bytes, at: int) -> int | None:
    """A version, and trailers whose offset, from the header on, leads to a table of cross references; the last of them ends it."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    found = _trailers(b)
    k = bisect_left(found, (at,))
    end, other = None, 0
    for j in range(k, len(found)):
        start, stop, offset = found[j]
        # An update comes after all that it updates.
        if (end or 0) <= at + offset < start and _TABLE.match(b, at + offset):
            end = stop
        elif end is not None or other == INNER_TRAILERS:
            break
        else:
            other += 1
    return end - at if end else None


def _zip_ends(b: bytes) -> dict[int, int]:
    """By the place of its first entry, where an archive ends: its end record leads back to it."""
    out: dict[int, int] = {}
    end = b.find(b"PK\x05\x06")
    while 0 <= end and end + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        start = end - size - offset
        if start >= 0 and end + 22 + note <= len(b) and b[start + offset : start + offset + 4] == b"PK\x01\x02":
            out.setdefault(start, end + 22 + note)
        end = b.find(b"PK\x05\x06", end + 4)
    return out


_zips = _Once(_zip_ends)


def _zip(b: bytes, at: int) -> int | None:
    """The end record, whose counts and sizes lead back to the first entry."""
    end = _zips(b).get(at)
    return end - at if end else None


def _gzip(b: bytes, at: int) -> int | None:
    """A member that inflates to its checksum."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    inflate = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not inflate.eof:
            inflate.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return None
    return min(p, len(b)) - len(inflate.unused_data) - at if inflate.eof else None


def _bmp(b: bytes, at: int) -> int | None:
    """File size, pixel offset and a known header size."""
    if len(b) < at + 26:
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    fits = not reserved and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels <= size <= len(b) - at
    return size if fits else None


def _ogg(b: bytes, at: int) -> int | None:
    """Pages up to one that ends the stream."""
    p = at
    while b[p : p + 5] == b"OggS\x00" and p + 27 <= len(b):
        n = b[p + 26]
        stop = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if stop > len(b):
            return None
        if b[p + 5] & 4:
            return stop - at
        p = stop
    return None


def _crc_table(polynomial: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return out


#: Checksums of FLAC: of a frame's header (x^8 + x^2 + x + 1) and of the frame (x^16 + x^15 + x^2 + 1).
_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Samples of a block by its code, where a header does not write them out.
_BLOCKS = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
#: A frame whose stream does not tell the greatest size is looked for in so many bytes.
MAX_FRAME = 1 << 20


def _flac_header(b: bytes, p: int) -> tuple[int, int] | None:
    """Length of a frame's header and samples of its block, if the header is sound."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8:
        return None
    block, rate, lead = b[p + 2] >> 4, b[p + 2] & 15, b[p + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if block == 0 or rate == 15 or lead == 0xFF or lead >= 0x80 and more < 1:
        return None
    q = p + 5 + more
    extra = {6: 1, 7: 2}.get(block, 0)
    samples = int.from_bytes(b[q : q + extra], "big") + 1 if extra else _BLOCKS[block]
    q += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for byte in b[p : q + 1]:
        crc = _CRC8[crc ^ byte]
    return (q + 1 - p, samples) if q < len(b) and not crc else None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks, the first being the stream's, and frames, each up to its checksum, until all samples are there."""
    p, first = at + 4, True
    total = most = 0
    while True:
        if p + 4 > len(b):
            return None
        kind, size = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind & 0x7F or size != 34) or p + 4 + size > len(b):
            return None
        if first:
            most = int.from_bytes(b[p + 11 : p + 14], "big") or MAX_FRAME
            total = int.from_bytes(b[p + 17 : p + 22], "big") & 0xFFFFFFFFF
        p, first = p + 4 + size, False
        if kind & 0x80:
            break
    done, end = 0, None
    while (header := _flac_header(b, p)) is not None and not (total and done >= total):
        crc, least = 0, p + header[0] + 3
        done += header[1]
        last = total and done >= total
        stop = None
        for q, byte in enumerate(memoryview(b)[p : p + most], p + 1):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ byte]
            # A frame with its checksum leaves 0; another frame, the stream's end or the blob's follows.
            if not crc and q >= least and (last or q == len(b) or _flac_header(b, q) is not None or not total):
                stop = q
                break
        if stop is None:
            return None
        p = end = stop
    return end - at if end and (not total or done >= total) else None


class Format(NamedTuple):
    mime: str
    magic: tuple[bytes, ...]
    length: Callable[[bytes, int], int | None]


#: Magic bytes as the formats' specifications have them.
FORMATS = (
    Format("audio/wav", (b"RIFF",), _wav),
    Format("image/png", (b"\x89PNG\r\n\x1a\n",), _png),
    Format("image/gif", (b"GIF87a", b"GIF89a"), _gif),
    Format("image/jpeg", (b"\xff\xd8\xff",), _jpeg),
    Format("application/pdf", (b"%PDF-",), _pdf),
    Format("application/zip", (b"PK\x03\x04",), _zip),
    Format("application/gzip", (b"\x1f\x8b\x08",), _gzip),
    Format("image/bmp", (b"BM",), _bmp),
    Format("audio/ogg", (b"OggS",), _ogg),
    Format("audio/flac", (b"fLaC",), _flac),
)


class Found(NamedTuple):
    mime: str
    offset: int
    length: int


@functools.lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, form in enumerate(FORMATS):
        for magic in form.magic:
            out.add_word(magic.decode("latin-1"), (k, len(magic)))
    out.make_automaton()
    return out


def objects(blob: bytes) -> list[Found]:
    """Every validated object of a blob, by offset, inner ones included."""
    out = []
    # One character for each byte.
    for last, (k, size) in _automaton().iter(blob.decode("latin-1")):
        at = last - size + 1
        length = FORMATS[k].length(blob, at)
        if length:
            out.append(Found(FORMATS[k].mime, at, length))
    return sorted(out, key=lambda f: (f.offset, -f.length, f.mime))


def sniff(blob: bytes) -> tuple[str, list[Found]]:
    """The true type of a blob and the objects carved from it (those inside carved ones are left in them)."""
    found = objects(blob)
    mime = found[0].mime if found and found[0].offset == 0 else UNKNOWN
    carved, end = [], 0
    for f in found:
        if f.offset and f.offset >= end:
            carved.append(f)
            end = f.offset + f.length
    return mime, carved


def payload_of(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes, filled with zeros to a positive multiple of ``unit``."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


def wrap(payload: bytes, rate: int = 8000) -> bytes:
    """A WAV file whose 8-bit samples are the payload."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + (len(payload) & 1), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) & 1)


def unwrap(blob: bytes) -> memoryview:
    """The samples of a WAV file that begins at offset 0; ValueError where there is none."""
    if _wav(blob, 0) is None or blob[:4] != b"RIFF":
        raise ValueError("no WAV file")
    p = 12
    while blob[p : p + 4] != b"data":
        size = int.from_bytes(blob[p + 4 : p + 8], "little")
        p += 8 + size + (size & 1)
    size = int.from_bytes(blob[p + 4 : p + 8], "little")
    return memoryview(blob)[p + 8 : p + 8 + size]


def feature(mime: str, samples: memoryview, carved: list[Found]) -> str:
    """Type, number and sum of samples, crossings of the middle, and what is embedded."""
    values = np.frombuffer(samples, dtype=np.uint8)
    high = values >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    inside = ",".join(f"{f.mime}@{f.offset}+{f.length}" for f in carved)
    return f"{mime};samples={len(values)};sum={int(values.sum(dtype=np.int64))};crossings={crossings};embedded=[{inside}]"


def sniff_column(rows: DataFrame, blob: str, declared: str | None = None) -> DataFrame:
    """Add mime, corrected (the declared type was another) and carved (mime, offset, length) to rows with a binary column.

    A null blob is empty and so of no known type; a null or missing declared type is not corrected.
    Columns of the added names are replaced.
    """
    prepare(rows.sparkSession)
    rows = rows.drop("mime", "corrected", "carved")
    k = rows.columns.index(blob)
    d = rows.columns.index(declared) if declared else None
    carved_type = pa.list_(pa.struct([("mime", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, k):
            found = [sniff(b) for b in raw_bytes(batch.column(k))]
            said = batch.column(d).to_pylist() if d is not None else [None] * len(found)
            new = [
                pa.array([m for m, _ in found], pa.string()),
                pa.array([s is not None and s != m for s, (m, _) in zip(said, found, strict=True)], pa.bool_()),
                pa.array([[f._asdict() for f in c] for _, c in found], carved_type),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "mime", "corrected", "carved"])

    return rows.mapInArrow(run, extended(rows, "mime string, corrected boolean, carved array<struct<mime:string,offset:long,length:long>>"))


_RESULT = (
    ("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"),
    ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"),
)


def store_and_read(text: bytes) -> tuple:
    """Store a text as samples, sniff the stored form, read the samples back and describe them."""
    media = wrap(payload_of(text))
    mime, carved = sniff(media)
    samples = unwrap(media)
    return (
        len(text),
        len(samples),
        hashlib.sha256(samples).hexdigest(),
        zlib.crc32(samples[-UNIT:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        feature(mime, samples, carved),
    )


def text_as_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and what :func:`store_and_read` gives for each text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            columns = list(zip(*map(store_and_read, raw_bytes(batch.column(1))), strict=True)) or [()] * len(_RESULT)
            arrays = [pa.array(list(c), t) for c, (_, t, _) in zip(columns, _RESULT, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(n for n, _, _ in _RESULT)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {s}" for n, _, s in _RESULT))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_as_media(table(spark, sf_dir, "documents"))


QUERIES = {"op7_media_columns": op7_media_columns}
