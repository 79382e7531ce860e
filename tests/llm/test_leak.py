import random

import numpy as np

from marginalia.llm.leak import FMIndex, leaked_items, leaked_spans, suffix_order
from marginalia.llm.words import words

DOC, ITEM = "doc_id long, text string", "item_id long, suite string, text string"


def test_words():
    assert words("Don't STOP²x_ÉÀ語1́b") == ["don", "t", "stop²x", "éà語1", "b"]
    assert words(None) == words("") == words(" .-_ ") == []


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(25):
        t = np.concatenate((rng.integers(1, 4, rng.integers(1, 200)), [0])).astype(np.int32)
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffix_order(t, 4).tolist() == order
        index = FMIndex(t, 4, 3)
        assert index.locate(np.arange(len(t))).tolist() == order
        patterns = rng.integers(1, 4, (20, 3))
        which, lo, hi = index.search(patterns)
        found = {k: {order[r] for r in range(a, b)} for k, a, b in zip(which.tolist(), lo.tolist(), hi.tolist(), strict=True)}
        for k, p in enumerate(patterns.tolist()):
            assert found.get(k, set()) == {i for i in range(len(t) - 2) if t[i : i + 3].tolist() == p}


def spans(docs, items, n):
    out = set()
    for d, text in docs:
        w = words(text)
        for i, _, other in items:
            v = words(other)
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            hits = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows]
            while hits:
                a = b = hits.pop(0)
                while hits and hits[0] <= b + n:
                    b = hits.pop(0)
                out.add((d, i, a, b + n))
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, "s", say(rng.randrange(2, 40))) for i in range(15)] + [(90, "s", None), (91, "s", ""), (92, "s", "one two")]
    docs = [(d, f"{say(20)} other {items[rng.randrange(15)][2]}! {say(30)}") for d in range(40)] + [(100, None), (101, ""), (102, " - "), (103, items[3][2] + " x " + items[3][2])]
    n = 5
    a, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = [tuple(r) for r in leaked_spans(a, b, window=n).collect()]
    assert len(got) == len(set(got)) and set(got) == spans(docs, items, n)
    pairs = {(d, i) for d, i, _, _ in got}
    long = [(d, " ".join(t for _, t in docs[d : d + 12])) for d in range(0, 28, 6)]
    cut = [tuple(r) for r in leaked_spans(spark.createDataFrame(long, DOC).coalesce(1), b, window=n, shard_words=60, block_words=50).collect()]
    assert len(cut) == len(set(cut)) and set(cut) == spans(long, items, n)
    small = leaked_items(a, b, window=n, shard_words=60, block_words=50).collect()
    assert {tuple(r) for r in small} == pairs and len(small) == len(pairs)


def test_repeats_and_extra_columns(spark):
    text = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, 7), (1, text, 8), (2, text.upper(), 9)], DOC + ", item_id int")
    items = spark.createDataFrame([(5, "a", text), (5, "b", text), (6, "c", text), (None, "d", text)], ITEM)
    assert sorted(tuple(r) for r in leaked_items(docs, items).collect()) == [(1, 5), (1, 6), (2, 5), (2, 6)]


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert leaked_items(docs, items).count() == 0
    assert leaked_items(spark.createDataFrame([(1, "a b")], DOC), items).columns == ["doc_id", "item_id"]
