"""Language identification: the forward algorithm by definition, held-out accuracy, defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest

from wearline.llm import language
from wearline.llm.spans import SpanHash, code_points

PATH = public_tokenizers.path(language.VOCABULARY)


@pytest.fixture(scope="module")
def known():
    return language.vocabulary(PATH)


def test_lookup_finds_every_piece_and_nothing_else(known):
    for k in range(0, len(known.pieces), 97):
        points = code_points(known.pieces[k])
        assert known.find(SpanHash(points)(np.array([0]), np.array([len(points)])))[0] == k
    points = code_points("qxzqxzqx")
    assert known.find(SpanHash(points)(np.array([0]), np.array([8])))[0] == known.none


def by_definition(word, known, p):
    """The sum over all segmentations, piece by piece."""
    index = {piece: k for k, piece in enumerate(known.pieces)}
    text = "▁" + word
    alpha = [1.0] + [0.0] * len(text)
    for end in range(1, len(text) + 1):
        for size in range(1, min(end, 40) + 1):
            k = index.get(text[end - size : end], known.unknown if size == 1 else known.none)
            alpha[end] += alpha[end - size] * p[k]
    return np.log(alpha[-1])


def test_forward_sums_all_segmentations(known):
    p = np.random.RandomState(0).rand(known.none + 1, 2)
    p[known.none] = 0
    p /= p.sum(axis=0)
    batch = ["hello the straße x internationalization", "a", "", "1 2 3", "éçàü漢 the"]
    words = language.words_of(batch)
    logs = language.Lattice(words, known).forward(p)
    for k, (s, n) in enumerate(zip(words.starts, words.lengths, strict=True)):
        word = "".join(map(chr, words.symbols[s + 1 : s + n]))
        for column in (0, 1):
            assert np.isclose(logs[k, column], by_definition(word, known, p[:, column]))
    assert np.diff(words.docs).tolist() == [5, 1, 0, 0, 2]


def test_expected_counts_explain_each_letter(known):
    words = language.words_of(["banana band", "a band"])
    counts = np.bincount(words.inverse)
    p = np.full(known.none + 1, 1 / known.none)
    p[known.none] = 0
    uses = language.Lattice(words, known).expected(p, counts)
    sizes = np.array([len(x) for x in known.pieces] + [1, 0])
    assert np.isclose((uses * sizes).sum(), (words.lengths * counts).sum())


def test_very_long_words_do_not_underflow(known):
    model = language.fit_texts({"a": ["the cat sat on the mat"], "b": ["der hund war im haus"]}, known)
    names, scores = language.predict(language.Scorer(model, known), ["thecat" * 50_000, "hund" * 9, "!!", "der hund " * 20_000])
    assert names == ["a", "b", "und", "b"] and all(0 <= s <= 1 for s in scores)


def test_parts_of_a_long_text_add_up(known):
    scorer = language.Scorer(language.fit_texts({"a": ["the cat sat"], "b": ["der hund"]}, known), known)
    text = "the hund, der cat! 12 éa sat " * 20
    whole, some = language.log_likelihoods(scorer, [text])
    parts, _ = language.log_likelihoods(scorer, [text], limit=7)
    assert np.allclose(whole, parts) and some.all()


def test_memory_of_words_changes_nothing(known):
    model = language.fit_texts({"a": ["the cat sat"], "b": ["der hund"]}, known)
    batches = [["the cat", "hund der"], ["sat hund", "katze"], ["the the", "mat"]]
    small, large = language.Scorer(model, known, max_words=1), language.Scorer(model, known)
    assert [language.predict(small, b) for b in batches] == [language.predict(large, b) for b in batches]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = language.op3_language_id(spark, sf).collect()
    assert len(found) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_table_cases(spark, known):
    model = language.fit_texts({"a": ["the cat sat on the mat"], "b": ["der hund war im haus"]}, known)
    rows = [(1, None, None), (2, "", "x"), (None, "the cat", "y"), (3, "12 !?", None), (3, "12 !?", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    found = language.identify(docs, model, PATH).collect()
    assert sorted((r["lang_pred"], r["lang_score"] > 0) for r in found) == [("a", True), ("und", False), ("und", False), ("und", False), ("und", False)]
    assert language.identify(docs.limit(0), model, PATH).count() == 0
    empty = language.fit(docs.select("doc_id", "text", language.F.lit(None).cast("string").alias("lang")), PATH)
    assert empty.languages == () and {r["lang_pred"] for r in language.identify(docs, empty, PATH).collect()} == {"und"}


def test_all_lower_case_pieces_are_used(known):
    model = language.sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = {p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (p := model.id_to_piece(i)).strip("\u2581").isalpha() and p == p.lower() and "\u2581" not in p[1:]}
    assert own <= set(known.pieces) and known.longest > 8


@pytest.mark.parametrize("size", [47, 48, 49, 100, 400, 10_000])
def test_long_words_are_summed_whole(known, size):
    p = np.random.RandomState(1).rand(known.none + 1, 2)
    p[known.none] = 0
    p /= p.sum(axis=0)
    word = ("internationalizationthestraßequx" * (size // 32 + 1))[: size - 1]
    text, index = "▁" + word, {piece: k for k, piece in enumerate(known.pieces)}
    logs = np.log(p)
    for column in (0, 1):
        alpha = [0.0]
        for end in range(1, size + 1):
            terms = [alpha[end - n] + logs[k, column] for n in range(1, min(end, 40) + 1) if (k := index.get(text[end - n : end], known.unknown if n == 1 else known.none)) != known.none]
            alpha.append(np.logaddexp.reduce(terms))
        found = language.Lattice(language.words_of([word, "other words beside"][:: 1 if column else -1]), known).forward(p)
        assert np.isclose(found[0 if column else -1, column], alpha[-1], rtol=1e-9)


def test_long_words_teach(known):
    words = language.words_of(["banana" * 60 + " banana"])
    p = np.full(known.none + 1, 1 / known.none)
    p[known.none] = 0
    uses = language.Lattice(words, known).expected(p, np.array([1, 2]))
    sizes = np.array([len(x) for x in known.pieces] + [1, 0])
    assert np.isclose((uses * sizes).sum(), 361 + 2 * 7)


def test_query_against_brute_force(spark, tmp_path):
    """The whole query on a small table: learned and scored by definition, word by word."""
    say = {"a": "the cat sat on the mat near our house", "b": "der hund war im haus und schlief", "c": "el gato duerme en la casa grande"}
    rows = [(i, " ".join(say[lang].split()[i % 4 :]), lang if i % 7 else None) for i, lang in enumerate("abc" * 12)] + [(100, None, "a"), (101, "1 2", "b"), (None, "la casa", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    own = language.vocabulary(PATH)
    teach = {}
    for d, t, lang in rows:
        if lang and d is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            teach.setdefault(lang, []).append(t or "")
    model = language.fit_texts(teach, own)
    for r in language.op3_language_id(spark, str(tmp_path)).collect():
        words = "".join(c if c.isalpha() else " " for c in (dict((d, t) for d, t, _ in rows)[r["doc_id"]] or "").lower()).split()
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        totals = np.array([sum(by_definition(w, own, model.probability[:, c]) for w in words) for c in range(3)])
        assert r["lang_pred"] == model.languages[totals.argmax()]
        assert np.isclose(r["score"], 1 / np.exp(totals - totals.max()).sum())
