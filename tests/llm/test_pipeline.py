"""The pipeline's stages on a small corpus whose right results are known, and its contract."""

from __future__ import annotations

import shutil

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_neardup import brute as classes
from wearline.llm import bpe, neardup, secrets


@pytest.fixture(scope="module")
def folder(tmp_path_factory, sf):
    own = tmp_path_factory.mktemp("tables")
    shutil.copy(f"{sf}/documents.parquet", own / "documents.parquet")
    shutil.copy(f"{sf}/benchmark.parquet", own / "benchmark.parquet")
    return str(own)


def test_whole_run_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs if any(c.isalpha() for c in r["text"] or "")]
    kept = {d for d, _, c in classes(rows, neardup.Rule()) if d == c}
    rows = [r for r in rows if r[0] in kept]
    bad = {r[0] for r in leaks(rows, items) if r[2]}
    expected = {d: secrets.redacted(t, secrets.spans_of(t)) for d, t in rows if d not in bad}
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(found) == set(expected) and bad
    # No document that stays holds a whole window of an item.
    assert not any(r[2] for r in leaks([(d, dict(rows)[d]) for d in found], items))
    for d, text in expected.items():
        assert list(found[d]["tokens"]) == library.encode_ordinary(text)


def test_stages_keep_columns_and_clashing_names(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, hit_spans int, item_ids int, secrets int, tokens int, n int, node int"
    rows = [(1, "the words of a text that is here", "en", "s", 30, "own", 1, 2, 3, 4, 5, 6), (2, None, None, None, None, None, None, None, None, None, None, None), (3, "die wörter password=abcdef99", "de", "s", 28, "x", 1, 2, 3, 4, 5, 6)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        ids = sorted(r["doc_id"] for r in out.collect())
        assert ids == ([1, 3] if name == "language_id" else [1, 2, 3]), name
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.mask_secrets(spark, docs, folder).filter("doc_id = 3").first()["text"] == "die wörter password=[redacted]"
    assert corpus_pipeline.identify_language(spark, docs, folder).filter("doc_id = 1").first()["lang_pred"] == "own"
    assert corpus_pipeline.tokenize(spark, docs, folder).count() == 3


def test_repeated_rows_leave_one(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()] == [1]
