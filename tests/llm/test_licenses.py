"""License scans against full alignment."""

from __future__ import annotations

import time
import random

import numpy as np

from wearline.llm import licenses
from wearline.llm.decontaminate import words_of


def test_align_is_the_longest_common_subsequence_in_its_band():
    random.seed(2)
    for _ in range(200):
        template = np.array([random.randint(1, 4) for _ in range(random.randint(1, 12))])
        text = np.array([random.randint(1, 4) for _ in range(len(template) + 2 * licenses.BAND)])
        best = np.zeros((len(template) + 1, len(text) + 1), dtype=int)
        for i in range(len(template)):
            for j in range(len(text)):
                inside = i <= j <= i + 2 * licenses.BAND
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if inside and template[i] == text[j] else 0)
        matched, first, last = licenses.align(template, text)
        assert matched == best[-1, -1]
        if matched:
            assert text[first] in template and 0 <= first <= last < len(text)


def names(text):
    own = licenses.scanner(licenses.TEMPLATES)
    return [m.license for m in own.matches(words_of(text.encode()))]


def test_known_notices():
    assert names("Code. Licensed under the Apache License, Version 2.0. More.") == ["Apache-2.0"]
    assert names("x released under the MIT license; x") == ["MIT"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"] and names("Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert names("a license under which the version of the software is free") == [] and names("") == []
    twice = "Released under the MIT License. " + "word " * 40 + "Released under the MIT License."
    assert names(twice) == ["MIT", "MIT"]


def test_edited_long_notice():
    words = dict((n, t) for n, t in licenses.TEMPLATES if len(t) > 200)["MIT"].split()
    random.seed(1)
    kept = [w for w in words if random.random() > 0.08]
    kept[10:10] = ["inserted", "words"]
    found = licenses.scanner(licenses.TEMPLATES).matches(words_of(("zz " * 50 + " ".join(kept)).encode()))
    assert [m.license for m in found] == ["MIT"] and found[0].coverage > 0.8 and found[0].first >= 50


def test_every_template_finds_itself():
    for name, text in licenses.TEMPLATES:
        assert name in names(f"before {text} after")


def test_table_cases(spark, sf):
    text = "é " * 1000 + "Licensed under the Apache License, Version 2.0. end"
    rows = [(1, None, "x"), (2, "", "x"), (None, text, "x"), (None, text, "x")]
    own = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    found = licenses.scan(own).collect()
    assert sorted(len(r["licenses"]) for r in found) == [0, 0, 1, 1]
    hit = next(r for r in found if r["licenses"])["licenses"][0]
    assert text[hit["start"] : hit["end"]] == "Licensed under the Apache License, Version 2.0" and hit["coverage"] == 1
    assert licenses.scan(own.limit(0)).count() == 0
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    result = licenses.op8_license_scan(spark, sf).collect()
    assert len(result) == len(docs)
    for r in result:
        assert ("CC-BY-NC-4.0" in r["licenses"]) == ("Licensed under CC BY-NC 4.0." in docs[r["doc_id"]])


def test_versions_are_told_apart():
    own = licenses.Scanner()
    names = lambda t: [m.license for m in own.matches(licenses.words_of(t.encode()))]
    assert names("It is licensed under the GNU General Public License, version 2 here") == ["GPL-2.0"]
    assert names("It is licensed under the GNU General Public License, version 3 here") == ["GPL-3.0"]
    assert names("It is licensed under the GNU General Public License, version 1 here") == []
    assert names("All rights reserved.") == ["rights-reserved"]


def test_time_follows_length():
    own = licenses.Scanner()

    def seconds(n):
        words = licenses.words_of(("Licensed under the MIT License and more words here " * n).encode())
        began = time.perf_counter()
        assert len(own.matches(words)) == n
        return time.perf_counter() - began

    small, large = seconds(2000), seconds(8000)
    assert large < max(0.5, 8 * small)


def test_query_against_alignment_of_everything(spark, sf):
    """Fingerprints lose nothing: each template aligned with each window of each text finds the same licenses."""
    own = licenses.Scanner()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in licenses.op8_license_scan(spark, sf).collect()}
    assert len(found) == len(rows)
    for row in rows:
        words = licenses.words_of((row["text"] or "").encode())
        expected = set()
        ids = [own.ids.get(w, 0) for w in words]
        for t, sequence in enumerate(own.sequences):
            template = sequence.tolist()
            # Short templates occur whole or with a word or two changed: compared at every place, word by word.
            for at in range(len(ids) - len(template) + 1):
                if template[0] in ids[at : at + 2] and sum(a == b for a, b in zip(ids[at:], template, strict=False)) == len(template):
                    expected.add(own.names[t])
        assert expected <= set(filter(None, found[row["doc_id"]]["licenses"].split(",")))
        if not expected:
            assert found[row["doc_id"]]["coverage"] < 1.0
