"""Near-duplicate classes against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from wearline.llm import graph, neardup

SPACE = re.compile("[\x20\x09-\x0d]+")


def shingles(text, n):
    words = [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, rule):
    """Row index to class: a union-find over all pairs of different sets."""
    sets = [shingles(t, rule.words) for _, t in rows]
    distinct = list({s for s in sets if s})
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(a & b) >= rule.percent * len(a | b):
                parent[find(a)] = find(b)
    least = {}
    for (doc, _), s in zip(rows, sets, strict=True):
        if s and doc is not None:
            least[find(s)] = min(doc, least.get(find(s), doc))
    return [(doc, len(s), least.get(find(s)) if s else doc) for (doc, _), s in zip(rows, sets, strict=True)]


def edited(words, share, vocabulary):
    return [random.choice(vocabulary) if random.random() < share else w for w in words]


def corpus(seed=3):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [random.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(say(random.randint(3, 120))) for _ in range(60)]
    base = say(150)
    # A large group whose members differ by anything up to a tenth of their words.
    texts += [" ".join(edited(base, random.random() * 0.1, vocabulary)) for _ in range(90)]
    for t in texts[:20]:
        texts += [t, t.upper(), " \t" + t.replace(" ", "\n") + " "]
        words = t.split()
        texts.append(" ".join([*words[: len(words) // 2], "new", *words[len(words) // 2 :]]))
    # A chain in which only neighbours are alike.
    link = say(100)
    for i in range(25):
        link = [*link[3:], *say(3)]
        texts.append(" ".join(link))
    texts += ["", " \n", "one", "ONE", "two words", "two  words", "two words more", "é è", "É È"]
    rows = [(i, t) for i, t in enumerate(texts)]
    random.shuffle(rows)
    return [*rows, (5000, None), (None, texts[0]), (None, "null id alone here now"), (7, texts[7]), (7, "same id another text altogether yes")]


@pytest.mark.parametrize(("rule", "block"), [(neardup.Rule(3, 85), 1500), (neardup.Rule(5, 80), 1500), (neardup.Rule(3, 85), 20)])
def test_all_pairs(spark, monkeypatch, rule, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(5)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, rule).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(found, key=key) == sorted(brute(rows, rule), key=key)


def test_one_stays_of_each_class(spark):
    rows = [r for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    left = [r["doc_id"] for r in neardup.deduplicate(docs).collect()]
    expected = brute(rows, neardup.Rule())
    classes = {c for _, _, c in expected}
    assert set(left) >= classes and len(left) == len(set(left)) or 7 in left
    assert {d for d in left if d != 7} == {d for d, _, c in expected if d == c and d != 7}


def test_null_and_repeated_ids_lose_no_class(spark):
    a, b, x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "abxy")
    rows = [(7, a), (None, a), (None, b), (2, x), (5, x), (5, y)]
    left = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(7, a), (None, b), (2, x), (5, y)], key=str)
    # Near copies under one id, or under none, leave one.
    rows = [(None, a), (None, a + " end"), (3, b), (3, b + " end"), (None, b), (None, ""), (None, ""), (4, None)]
    left = [tuple(r) for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(left) == 4 and {(d, (t or "")[:1]) for d, t in left} == {(None, "a"), (3, "b"), (None, ""), (4, "")}


def test_one_row_stays_of_each_class_of_the_whole_corpus(spark):
    rows = corpus()
    rows += [(None if i % 3 == 0 else d, t) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(5)
    left = [(r["doc_id"], r["text"]) for r in neardup.deduplicate(docs).collect()]
    # Classes by text alone: each text gets an id of its own.
    texts = list(dict.fromkeys(t for _, t in rows))
    of = {t: c for t, (_, _, c) in zip(texts, brute(list(enumerate(texts)), neardup.Rule()), strict=True)}
    worded = [(d, t) for d, t in left if shingles(t, 5)]
    assert sorted(of[t] for _, t in worded) == sorted({of[t] for t in texts if shingles(t, 5)})
    least = {}
    for d, t in rows:
        least.setdefault(of[t], set()).add(d)
    assert all(d == min((i for i in least[of[t]] if i is not None), default=None) for d, t in worded)
    assert {r for r in left if not shingles(r[1], 5)} == {r for r in rows if not shingles(r[1], 5)}


def test_empty_and_alone(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == []
    one = spark.createDataFrame([(4, None), (5, "x")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(one).collect())) == [(4, 0, 4, True), (5, 1, 5, True)]


def test_long_text_is_whole(spark):
    text = " ".join(f"a{i}" for i in range(60_000))
    rows = [(1, text), (2, text + " end"), (3, text[: len(text) // 2])]
    found = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_shingles"] == 59_996 and [found[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 3]


def test_block_components_are_exact():
    random.seed(0)
    for _ in range(20):
        sets = [np.unique(np.array([random.randint(0, 60) for _ in range(random.randint(1, 40))], dtype=np.uint64)) for _ in range(40)]
        label = neardup.Block(sets, 50).labels()
        parent = list(range(40))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(40):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 50 * (len(sets[i]) + len(sets[j]) - common):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        assert [find(i) for i in range(40)] == label.tolist()


def test_depth_follows_the_threshold():
    assert neardup.Rule(3, 85).least_depth == 4 and neardup.Rule(5, 80).least_depth == 3
    for rule in (neardup.Rule(3, 85), neardup.Rule(5, 80)):
        assert (1 - (rule.percent / 100) ** rule.least_depth) ** neardup.TREES <= neardup.MISS


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (None, 5)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(rows, "a long, b long")).collect()))
    assert {found[i] for i in range(61)} == {0} and found[101] == 100 and len(found) == 63


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


def test_words_of_one_pattern_stay_apart(spark):
    rows = [(k, w) for k, w in enumerate(thue_morse(n, *ab) for n in (1024, 2048, 4096) for ab in ("ab", "ba"))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(k, k) for k in range(6)]


@pytest.mark.parametrize("changed", [6, 12])
def test_recall_in_a_crowd(spark, changed):
    """Texts that share half their words crowd every region; pairs just over the threshold are planted among them."""
    random.seed(8)
    rule = neardup.Rule(3, 85)
    common = [f"c{i}" for i in range(120)]
    fresh = iter(range(10**9))
    rows, pairs = [], []
    for k in range(3000):
        words = common + [f"w{next(fresh)}" for _ in range(60)]
        rows.append((2 * k, " ".join(words)))
        if k % 3 == 0:
            twin = list(words)
            twin[150 : 150 + changed] = [f"w{next(fresh)}" for _ in range(changed)]
            rows.append((2 * k + 1, " ".join(twin)))
            a, b = shingles(rows[-1][1], 3), shingles(rows[-2][1], 3)
            if 100 * len(a & b) >= 85 * len(a | b):
                pairs.append((2 * k, 2 * k + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, rule).collect()}
    assert len(pairs) == 1000
    # 6 words leave a similarity of 0.91, 12 of 0.854.
    caught = sum(found[a] == found[b] for a, b in pairs)
    print("caught", caught)
    assert caught >= (1000 if changed == 6 else 995)
    assert len(set(found.values())) == 4000 - caught


def test_links_of_a_dense_group_are_few(spark):
    """A star an order at most: far fewer links than the group's candidates."""
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [random.choice(vocabulary) for _ in range(200)]
    rows = [(i, " ".join(edited(base, 0.02, vocabulary))) for i in range(1500)]
    rule = neardup.Rule(3, 85)
    nodes = neardup.features(spark.createDataFrame(rows, "doc_id long, text string"), rule).filter("orders IS NOT NULL").dropDuplicates(["node"]).cache()
    links = neardup.neighbours(nodes, rule).cache()
    assert graph.components(links).select("root").distinct().count() == 1
    assert links.count() <= 8 * nodes.count()
    print("links a node", links.count() / nodes.count())


def test_parts_of_a_long_text_have_its_shingles():
    random.seed(4)
    for _ in range(300):
        text = "".join(random.choice([" ", "\t\n", "a", "b", "Cc", "é", "dd "]) for _ in range(random.randint(0, 80))).encode()
        words = random.randint(1, 4)
        whole = neardup.shingle_sets([text], words)[0]
        assert np.array_equal(whole, neardup.shingle_sets([text], words, limit=random.randint(1, 20))[0])
