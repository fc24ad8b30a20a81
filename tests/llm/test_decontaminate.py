"""Decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re

from wearline.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=13):
    patterns = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - window + 1)) if words else ():
            patterns.setdefault(tuple(words[i : i + window]), set()).add("" if item is None else str(item))
    lengths = sorted({len(p) for p in patterns})
    for doc, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (own := patterns.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        yield doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def run(spark, docs, items, **kwargs):
    own = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int")
    found = d.search_benchmark(own.select("doc_id", "text", "n_words"), spark.createDataFrame(items, "item_id long, text string"), **kwargs).withColumn("n_hit", d.n_hit()).withColumn("c", d.contaminated())
    return sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["item_ids"]), hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest(), r["c"]) for r in found.collect())


def cases():
    random.seed(5)
    vocabulary = ["the", "of", "a", "é", "x1", "ÄB", "word", "漢字"]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, say(random.choice([1, 2, 3, 5, 8, 12, 13, 14, 20, 40]))) for i in range(40)] + [(3, "repeated item"), (100, None), (101, " ... "), (None, "no id at all here")]
    docs = []
    for i in range(120):
        text = say(random.randint(0, 60))
        if i % 3 == 0:
            text += " " + random.choice([t for _, t in items if t]).upper() + "! " + say(random.randint(0, 30))
        docs.append((i, text))
    return docs + [(500, None), (501, ""), (502, "..."), (503, "the " * 5000), (7, docs[7][1])], items


def test_brute_force_and_blocks(spark):
    docs, items = cases()
    expected = sorted(brute(docs, items))
    assert run(spark, docs, items) == expected
    assert run(spark, docs, items, max_block_bytes=300) == expected


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = sorted(tuple(r) for r in d.op4_decontamination(spark, sf).collect())
    assert found == sorted(brute(docs, items)) and any(r[-1] for r in found)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], [])[0][2:4] == (0, 0)


def test_search_skips():
    search = d.Search([tuple(b"abcdefghijklm"[i : i + 1] for i in range(13))])
    assert search.jump == 12 and list(search([b"z"] * 100)) == []
