"""The compression classifier: held-out quality of its scores, defined cases."""

from __future__ import annotations

import zlib

import numpy as np

from wearline.llm import quality


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    good = y.sum()
    return (rank[y == 1].sum() - good * (good - 1) / 2) / (good * (len(y) - good))


def test_held_out_scores(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = quality.op10_quality_classifier(spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    held = [(truth[r["doc_id"]], r["score"]) for r in found if r["held_out"] and truth.get(r["doc_id"]) is not None]
    y, score = np.array([a for a, _ in held]), np.array([b for _, b in held])
    assert auc(y, score) > 0.97 and ((score >= 0.3) == y).mean() > 0.95


def test_every_chunk_counts():
    good, bad = (quality.build_dictionary([w * 200]) for w in (b"good words here ", b"### bad ### "))
    sizer = quality.Sizer(good, bad)
    text = b"good words here " * 500
    each = sizer.sizes(text)
    assert each == [sizer.sizes(c)[0] for c in quality.cut(text)] and all(g < b for _, g, b in each)
    assert np.isclose(sizer(text), np.average([(b - g) / (b + g) for _, g, b in each], weights=[n + 1 for n, _, _ in each]))
    assert b"".join(quality.cut(text)) == text and quality.cut(b"") == [b""]


def test_logistic_finds_a_known_line():
    random = np.random.RandomState(0)
    x = random.standard_normal((4000, 2))
    y = (random.rand(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    w = quality.logistic(x, y, np.ones(4000), ridge=1e-6)
    assert np.allclose(w, [2, -1, 0.5], atol=0.25)


def test_cases(spark):
    rows = [(1, None), (2, ""), (None, "x " * 100_000), (3, "good"), (3, "good")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 0), (3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    assert {r["score"] for r in quality.score(docs, model).collect()} == {1.0}
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5} and quality.score(docs.limit(0), none).count() == 0
    texts = [(q, (b"fine prose about things %d " % i) * 20 if q else (b"@@@ ### $$$ %d " % i) * 20) for i in range(40) for q in (0, 1)]
    fitted = quality.fit_rows(texts, {0: 40, 1: 40})
    scores = quality.scores_of(fitted, [b"", b"fine prose about things", b"### $$$ @@@"])
    assert scores[1] > 0.5 > scores[2] and 0 <= scores[0] <= 1


def test_query_against_brute_force(spark, tmp_path):
    """The query's scores from the labelled texts alone: sizes by the library, calibration by the fitted line."""
    import zstandard

    say = {0: "@@@ ### $$$ %d ", 1: "fine prose about things %d "}
    rows = [(i, say[i % 2] % i * (3 + i % 5)) for i in range(120)] + [(500, None), (501, ""), (None, say[1] % 7)]
    labels = [(i, i % 2) for i in range(120)] + [(500, 1), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 5], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), seen)
    params = zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0)
    size = lambda data, chunk: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data), compression_params=params).compress(chunk))
    texts = {d: (t or "").encode() for d, t in rows}
    for r in quality.op10_quality_classifier(spark, str(tmp_path)).collect():
        text = texts[r["doc_id"]]
        chunks = [text[i : i + 512] for i in range(0, max(1, len(text)), 512)]
        both = [(size(model.good, c), size(model.bad, c), len(c) + 1) for c in chunks]
        x = min(max(sum(w * (b - g) / (b + g) for g, b, w in both) / sum(w for _, _, w in both), model.low), model.high)
        assert np.isclose(r["score"], 1 / (1 + np.exp(-(model.slope * x + model.bias)))) and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_the_sample_does_not_depend_on_the_run(spark):
    rows = [(i % 50, f"text {i} " * (1 + i % 7)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 3, "doc_id long, quality int")
    fits = [quality.fit(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(parts), labels.repartition(parts), max_rows=20) for step, parts in ((1, 2), (-1, 7))]
    assert fits[0] == fits[1]
