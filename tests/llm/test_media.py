"""Signature sniffing, carving and storing."""

from __future__ import annotations

import time
import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from wearline.llm import media


def png(data=b"x" * 20):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + b"\0" * 9 + b"\x02\x02\x44\x01\0" + b"\x3b"


def zipped():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "hello")
    return held.getvalue()


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4


def jpeg():
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 1, 1, 1) + b"\1\x11\0"
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + frame + b"\xff\xda" + struct.pack(">H", 8) + b"\1\1\0\0\x3f\0" + b"\x12\xff\0\x34" + b"\xff\xd9"


def ogg():
    return b"OggS\0\x06" + b"\0" * 20 + b"\1\4data"


def pdf():
    return b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"


def flac():
    """Two frames of 192 equal 8-bit samples each."""
    def crc(data, polynomial, bits):
        value = 0
        for bit in "".join(f"{b:08b}" for b in data) + "0" * bits:
            top = value >> (bits - 1)
            value = (value << 1 | int(bit)) & ((1 << bits) - 1)
            value ^= polynomial if top else 0
        return value.to_bytes(bits // 8, "big")

    info = struct.pack(">HH", 192, 192) + b"\0" * 6 + ((8000 << 44) | (7 << 36) | 384).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC\x80\0\0\x22" + info
    for number in (0, 1):
        head = bytes((0xFF, 0xF8, 0x10, 0x02, number))
        frame = head + crc(head, 0x07, 8) + b"\0" + bytes((100 + number,))
        out += frame + crc(frame, 0x8005, 16)
    return out


ALL = {"image/png": png(), "image/gif": gif(), "application/zip": zipped(), "image/bmp": bmp(), "image/jpeg": jpeg(), "audio/ogg": ogg(), "application/pdf": pdf(), "audio/flac": flac(), "application/gzip": gzip.compress(b"text"), "audio/wav": media.wrap(b"12345678")}


@pytest.mark.parametrize("mime", ALL)
def test_formats_alone_carved_and_broken(mime):
    blob = ALL[mime]
    assert media.sniff(blob)[0] == mime
    found = media.sniff(b"junk " + blob + b" tail")
    assert found[0] == media.UNKNOWN and media.Found(mime, 5, len(blob)) in found[1]
    assert media.sniff(blob[: len(blob) // 2])[0] == media.UNKNOWN


def test_carving_takes_the_outermost():
    inner = png()
    outer = media.wrap(inner)
    found = media.sniff(b"a" * 10 + outer + gif())[1]
    assert [(f.mime, f.offset) for f in found] == [("audio/wav", 10), ("image/gif", 10 + len(outer))]
    assert [f.mime for f in media.sniff(outer)[1]] == ["image/png"]


@given(data=st.binary(max_size=300))
def test_stored_bytes_come_back(data):
    n, size, digest, tail, stored, stored_digest, feature = media.store_and_read(data)
    payload = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
    assert (n, size, stored) == (len(data), len(payload), len(payload) + 44) and size % 64 == 0 and size > 0
    assert digest == hashlib.sha256(payload).hexdigest() and tail == zlib.crc32(payload[-64:])
    assert bytes(media.unwrap(media.wrap(payload))) == payload and feature.startswith("audio/wav;")


def test_declared_types_are_corrected(spark):
    rows = [(1, png(), "image/jpeg", "x"), (2, png(), "image/png", "x"), (3, None, "image/png", "x"), (None, b"", None, "x")]
    own = spark.createDataFrame(rows, "id int, blob binary, declared string, mime string")
    found = {r["id"]: r for r in media.sniff_column(own, "blob", "declared").collect()}
    assert (found[1]["mime"], found[1]["corrected"]) == ("image/png", True) and not found[2]["corrected"]
    assert found[3]["mime"] == media.UNKNOWN and found[3]["corrected"] and not found[None]["corrected"]


def test_query_and_cases(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op7_media_columns(spark, sf).collect():
        assert tuple(r)[1:] == media.store_and_read((texts[r["doc_id"]] or "").encode())
    rows = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "é" * 500_000, 0)], "doc_id long, text string, n_bytes int")
    found = sorted((r["n_bytes"], r["payload_bytes"]) for r in media.text_as_media(rows).collect())
    assert found == [(0, 64), (0, 64), (1_000_000, 1_000_000)]
    assert media.text_as_media(rows.limit(0)).count() == 0


def test_objects_end_where_they_end():
    for mime in ("application/pdf", "audio/flac", "application/zip"):
        one = ALL[mime]
        two = media.sniff(b"x" + one + b"between" + one + b"after")[1]
        assert [(f.mime, f.offset, f.length) for f in two if f.mime == mime] == [(mime, 1, len(one)), (mime, 8 + len(one), len(one))]
    updated = pdf() + b"\n2 0 obj\n<<>>\nendobj\nstartxref\n%d\n%%%%EOF" % (len(pdf()) + 1)
    assert media.sniff(updated + b" tail " + pdf())[1] == [media.Found("application/pdf", len(updated) + 6, len(pdf()))]
    assert media.objects(updated)[0].length == len(updated)
    assert media.sniff(flac()[:-1] + b"\0")[0] == media.UNKNOWN


@pytest.mark.parametrize("unit", [b"%PDF-1.4 ", b"PK\3\4", b"%PDF-1.4 startxref\n1\n%%EOF ", b"GIF89a", b"\xff\xd8\xff", b"BM", b"OggS\0"])
def test_time_follows_length(unit):
    def seconds(n):
        blob = unit * (n // len(unit))
        began = time.perf_counter()
        media.sniff(blob)
        return time.perf_counter() - began

    small, large = min(seconds(250_000) for _ in range(2)), min(seconds(1_000_000) for _ in range(2))
    assert large < max(0.5, 8 * small)


def test_query_against_brute_force(spark, sf):
    """Every column of the query worked out beside it, from the text alone."""
    from wearline.llm.media import op7_media_columns

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in op7_media_columns(spark, sf).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        size = len(payload)
        file = b"RIFF" + (36 + size).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("1000000001000100401f0000401f000001000800") + b"data" + size.to_bytes(4, "little") + payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), size, len(file))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(file).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        crossed = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:], strict=False))
        assert r["feature"].startswith(f"audio/wav;samples={size};sum={sum(payload)};crossings={crossed};embedded=[")
