"""Operator 4, benchmark decontamination by Wu-Manber search over words.

The alphabet is words: A-Z lower-cased, runs of ``[0-9a-z]`` and of any character beyond ASCII. The
patterns are the windows of the benchmark items: 13 consecutive words, or the whole of a shorter
item. For patterns of at least m words, a shift table tells, for each block of two words, how far
the search may jump when it stands at that block; an unknown block jumps m - 1 words. Where the
shift is zero, a bucket chosen by the last words gives the few windows to compare directly.
Patterns of similar length share a search, so that a short item does not shorten all jumps.

Benchmark items are read in blocks of at most ``MAX_BLOCK_BYTES`` of text (their sum is measured
first); each block is broadcast once and searched in all documents. One block is one scan without any
shuffle. With more, each scan reads the texts and writes only the documents it has found, by id and
digest; what the blocks have found meets there, and joins the documents at the end. The corpus itself
is never written, and one block's windows are in memory at a time.

Defined cases: null, empty and wordless texts have no words, are never hit, and as items have no
windows; very long texts are searched whole; ties (a window of several items) count for each of them;
repeated items count once per item_id; a null item_id is written as an empty string; repeated documents
give repeated rows; empty tables give no row, or no hit; other columns stay, those of the added names
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, extended, held, prepare, raw_bytes, stored, table

WINDOW = 13
#: Text of the benchmark that is broadcast at once.
MAX_BLOCK_BYTES = 16 << 20
#: Upper ends of the pattern lengths that share a search.
_LENGTHS = (1, 3, 7)

_WORD_BYTES = bytes(
    b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Search:
    """Wu-Manber search for patterns (lists of words) of at least ``m`` words."""

    def __init__(self, patterns: list[tuple[bytes, ...]]) -> None:
        self.m = m = min(map(len, patterns))
        self.block = b = min(2, m)
        self.tail = min(m, 4)
        self.jump = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[list[bytes]]] = {}
        for pattern in patterns:
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.jump), m - end)
            self.bucket.setdefault(pattern[m - self.tail : m], []).append(list(pattern))

    def __call__(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Start and pattern of each occurrence."""
        m, b, tail, jump, n = self.m, self.block, self.tail, self.jump, len(words)
        shift, bucket = self.shift.get, self.bucket.get
        end = m
        while end <= n:
            step = shift(tuple(words[end - b : end]), jump)
            if step:
                end += step
                continue
            for pattern in bucket(tuple(words[end - tail : end]), ()):
                if words[end - m : end - m + len(pattern)] == pattern:
                    yield end - m, tuple(pattern)
            end += 1


class Matcher:
    """All windows of a block of items, grouped by length."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.items: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for pattern in windows_of(words_of(text), window):
                self.items.setdefault(pattern, set()).add(item)
        groups: dict[int, list[tuple[bytes, ...]]] = {}
        for pattern in self.items:
            groups.setdefault(sum(len(pattern) > top for top in _LENGTHS), []).append(pattern)
        self.searches = [Search(patterns) for _, patterns in sorted(groups.items())]

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The places hit (start, end) and the items of the windows that occur."""
        places, items = [], set()
        for search in self.searches:
            for start, pattern in search(words):
                places.append((start, start + len(pattern)))
                items |= self.items[pattern]
        return places, items


def merged(places: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_FOUND = "n_words long, hit_spans array<struct<start:int,end:int>>, item_ids array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(docs: DataFrame, text: str, items: Broadcast, window: int, only_hit: bool = False) -> DataFrame:
    """Add the found columns to the rows; or keep only the rows that are hit."""
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        matcher = held(f"decontaminate:{window}:{hash(tuple(own))}", lambda: Matcher(own, window))
        for batch in bounded(batches, k):
            n_words, spans, ids = [], [], []
            for raw in raw_bytes(batch.column(k)):
                words = words_of(raw)
                places, found = matcher(words)
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in merged(places)])
                ids.append(sorted(found))
            new = [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(ids, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n_words", "hit_spans", "item_ids"])
            yield out.filter(pa.array([bool(s) for s in spans])) if only_hit else out

    return docs.mapInArrow(run, extended(docs, _FOUND))


#: The words of a text, as the matcher takes them (A-Z is lower-cased, so it belongs to them).
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _merged_spans(spans: Column) -> Column:
    """Sorted spans (start, end) of several blocks as :func:`merged` has them; only documents that are hit have any."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (x["start"] <= F.get(out, F.size(out) - 1)["end"]), grown).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def search_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Add n_words, hit_spans (word positions, merged, ends exclusive) and item_ids (sorted) to documents.

    ``benchmark`` has the columns item_id and text. Columns of the added names are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("n_words", "hit_spans", "item_ids")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t"))
    items = items.filter(F.col("t").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("i")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // max_block_bytes))
    gathered = lambda rows: spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in rows.collect()])
    if blocks == 1:
        return _scan(docs, text, gathered(items), window)
    # Equal texts are hit alike: one row stands for them.
    narrow = docs.select(F.col(text).alias("text"))
    found = None
    for block in range(blocks):
        own = gathered(items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block))
        hit = stored(_scan(narrow, "text", own, window, only_hit=True).select(_text_key("text").alias("k"), "hit_spans", "item_ids").dropDuplicates(["k"]))
        own.destroy()
        found = hit if found is None else found.unionByName(hit)
    found = found.groupBy("k").agg(_merged_spans(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    joined = docs.alias("d").join(stored(found).alias("f"), _text_key(f"d.{text}") == F.col("f.k"), "left")
    words = F.coalesce(F.size(F.regexp_extract_all(F.col(f"d.{text}"), F.lit(_WORD), F.lit(0))), F.lit(0)).cast("long")
    return joined.select(
        "d.*",
        words.alias("n_words"),
        F.coalesce("f.hit_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("hit_spans"),
        F.coalesce("f.item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def _text_key(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))


def contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search_benchmark(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


QUERIES = {"op4_decontamination": op4_decontamination}

_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op4_decontamination": f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
grams AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT r, i, n, item FROM grams JOIN windows USING (n, gram)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits) AS h, unnest(range(i, i + n)) AS t(p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
}
