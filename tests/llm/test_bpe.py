"""Byte-level BPE against the tiktoken library and against merging by definition."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wearline.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def split(codec, batch):
    tokens, at = codec.encode(batch)
    return [tokens[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


TEXTS = ["", " ", "a", "don't 'tis we'll'", "x  y \n\n z\t", " 　 é漢字😀 12²½", "'s's 's ''s", "aaaa" * 500, " " * 300 + "x", "\x1c a\x85b", "naïve café ", "\r\n\r\n  end  "]


def test_known_texts(own, library):
    assert split(own, TEXTS) == [library.encode_ordinary(t) for t in TEXTS]
    assert split(own, ["", "", "ab"]) == [[], [], library.encode_ordinary("ab")]


ODD = st.text(alphabet=st.sampled_from(list(" '\n\t abcdestmrvl12é漢😀.,!² ")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(batch=st.lists(st.one_of(st.text(max_size=40), ODD), min_size=1, max_size=6))
def test_any_batch(own, library, batch):
    found = split(own, batch)
    for text, ids in zip(batch, found, strict=True):
        assert ids == library.encode_ordinary(text)
        assert own.decode(np.array(ids, dtype=np.int64)) == text.encode() and own.whole_characters(np.array(ids, dtype=np.int64))


@settings(max_examples=300, deadline=None)
@given(piece=st.binary(min_size=1, max_size=40))
def test_any_bytes_by_definition(own, piece):
    expected = [own.ranks[piece]] if piece in own.ranks else bpe.merge_by_rank(own.ranks, piece)
    assert own.transducer.encode(piece) == expected


def test_full_tables_change_nothing(library, own):
    small = bpe.Transducer(own.ranks, max_transitions=50)
    words = [w.encode() for w in regex.findall(public_tokenizers.PATTERN, "The quick unbelievable brownish antidisestablishmentarianism jumps " * 3)]
    assert [small.encode(w) for w in words] == [own.transducer.encode(w) for w in words]


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab é'\n1.  ")), max_size=120), limit=st.integers(1, 30))
def test_parts_of_a_long_text_have_its_tokens(own, text, limit):
    tokens, at = own.encode([text], limit)
    assert tokens.tolist() == own.encode([text])[0].tolist() and at.tolist() == [0, len(tokens)]


def test_other_patterns_go_through_the_engine(own):
    other = bpe.Codec(PATH, r"\w+|\W+")
    assert split(other, ["ab cd"])[0] == [t for p in ("ab", " ", "cd") for t in own.transducer.encode(p.encode())]


def test_streaming_decoder(own):
    text = "é漢😀 naïve"
    decoder = bpe.Utf8Decoder(own.transducer.bytes_of)
    ids = [own.ranks[bytes([b])] for b in text.encode()]
    parts = [decoder.feed(t) for t in ids]
    assert "".join(parts) == text and parts[0] == "" and parts[1] == "é" and decoder.complete(ids)
    assert not decoder.complete(ids[:1])
    decoder.reset()
    with pytest.raises(ValueError):
        decoder.feed(own.ranks[b"\xff"])


@given(data=st.binary(max_size=12))
def test_machine_knows_utf8(data):
    state = bpe.Utf8Decoder.START
    for b in data:
        state = bpe.Utf8Decoder.next_state(state, b) if state else None
    try:
        data.decode()
        valid = True
    except UnicodeDecodeError:
        valid = False
    assert valid == (state == bpe.Utf8Decoder.START)


def test_query_and_defined_cases(spark, library, sf):
    rows = [(1, None, "x"), (2, "", "x"), (None, "two words", None), (2, "don't", "x"), (2, "don't", "x"), (5, "word " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    found = bpe.round_trip(docs, PATH, with_tokens=True).collect()
    assert len(found) == 6 and all(r["utf8_whole"] for r in found)
    for (_, text, _), r in zip(sorted(rows, key=str), sorted(found, key=lambda r: str((r["doc_id"],))), strict=True):
        assert r["n_tokens"] == len(r["tokens"])
    by = {r["ids_sha256"]: r for r in found}
    for _, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        r = by[hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()]
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    assert bpe.tokenize(docs, PATH).columns == ["doc_id", "text", "tokens"]
    for r in bpe.op5_byte_level_bpe(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())


def test_pieces_of_one_pattern_stay_apart(spark):
    """Words that polynomial hashes modulo 2**64 confuse: each keeps its own tokens."""
    words = ["".join("ba"[bin(i).count("1") & 1 ^ flip] for i in range(n)) for n in (1024, 2048, 4096) for flip in (0, 1)]
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string").coalesce(1)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    found = {r["doc_id"]: r for r in bpe.round_trip(docs, bpe.RANKS, with_tokens=True).collect()}
    for k, word in enumerate(words):
        assert list(found[k]["tokens"]) == library.encode_ordinary(word)
        assert found[k]["decoded_sha256"] == hashlib.sha256(word.encode()).hexdigest()
