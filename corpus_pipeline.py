"""A corpus pipeline: language identification, near-duplicates, decontamination, secrets, tokens.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Rows are never sampled; a stage drops or changes only what its operator decides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import bpe, decontaminate, language, neardup, secrets
from wearline.llm.common import prepare, table
from wearline.shipping import checkpoint_dir

#: Documents whose language is less sure than this are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def _apart(docs: DataFrame, names: list[str]) -> DataFrame:
    """Own columns of these names out of an operator's way; :func:`_back` restores them."""
    return docs.withColumnsRenamed({n: f"__own_{n}" for n in names if n in docs.columns})


def _back(found: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    return found.select(*(F.col(f"__own_{c}").alias(c) if c in names else F.col(c) for c in columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language; it is learned from the documents themselves."""
    prepare(spark)
    path = language.VOCABULARY
    model = language.fit(docs.select("doc_id", "text", "lang").filter(language.teaches()), path)
    names = ["lang_pred", "lang_score"]
    found = language.identify(_apart(docs, names), model, path)
    sure = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE)
    return _back(found.filter(sure), docs.columns, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates (five words, similarity 0.8)."""
    prepare(spark)
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document in which a benchmark window occurs, however long the document is around it."""
    prepare(spark)
    names = ["n_words", "hit_spans", "item_ids"]
    found = decontaminate.search_benchmark(_apart(docs, names), table(spark, sf_dir, "benchmark"))
    return _back(found.filter(decontaminate.n_hit() == 0), docs.columns, names)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secret values in the texts; n_chars follows."""
    prepare(spark)
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of the bytes decoded from them."""
    return bpe.round_trip(docs, bpe.RANKS, with_tokens=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is a table in the shared folder."""
    prepare(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: A language model, a forest of hashes and merges of bytes are not SQL's; tests compare with brute force.
ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
