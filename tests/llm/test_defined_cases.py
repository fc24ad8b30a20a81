"""Every operator on one table of odd rows: nulls, empty and very long texts, repeated rows, names that clash, and no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wearline.llm import bpe, chat, decontaminate, html, language, licenses, media, neardup, quality, secrets

LONG = "word " * 300_000
ROWS = [(1, None), (2, ""), (3, LONG), (3, LONG), (4, "a" * 200_000), (None, "some text"), (None, None), (5, "api_secret = 'Ab3dEf9hIj2k'")]
#: Names that operators use for what they add or carry.
CLASH = ["n", "node", "key", "tokens", "secrets", "licenses", "lang_pred", "lang_score", "hit_spans", "item_ids", "n_words", "n_hit", "score", "predicted", "cluster", "block", "mime", "carved", "component_id", "kept"]


def identify(docs):
    known = language.vocabulary(language.vocabulary_file(language.VOCABULARY))
    return language.identify(docs, language.fit_texts({"a": ["the word"], "b": ["das wort"]}, known), language.VOCABULARY)


def search(docs):
    items = docs.sparkSession.createDataFrame([(1, "word word word"), (None, None)], "item_id long, text string")
    return decontaminate.search_benchmark(docs, items)


def score(docs):
    return quality.score(docs, quality.fit_rows([(q, (b"good %d " if q else b"## %d ") % i * 30) for i in range(20) for q in (0, 1)], {0: 20, 1: 20}))


def chats(docs):
    return chat.format_conversations(docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text", "n"))


#: The operator and how many rows it leaves.
OPERATORS = {
    "chat": (chats, 6),
    "html": (lambda docs: html.extract(docs.withColumnRenamed("text", "html").withColumn("text", F.lit(1))), 8),
    "language": (identify, 8),
    "decontaminate": (search, 8),
    "bpe": (lambda docs: bpe.tokenize(docs, bpe.RANKS), 8),
    "bpe_digests": (lambda docs: bpe.round_trip(docs, bpe.RANKS), 8),
    "secrets": (secrets.find_secrets, 8),
    "redact": (secrets.redact, 8),
    "media": (media.text_as_media, 8),
    "licenses": (licenses.scan, 8),
    "near_duplicates": (neardup.near_duplicates, 8),
    # The repeated row goes; null and empty texts stay, each by itself.
    "deduplicate": (neardup.deduplicate, 7),
    "quality": (score, 8),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    operator, left = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *(F.lit(7).alias(c) for c in CLASH))
    out = operator(docs)
    rows = out.collect()
    assert len(rows) == left and len(set(out.columns)) == len(out.columns)
    # Equal rows, equal results.
    if "doc_id" in out.columns and left == 8:
        same = [r for r in rows if r["doc_id"] == 3]
        assert len(same) == 2 and same[0] == same[1]
    assert operator(docs.limit(0)).count() == 0
