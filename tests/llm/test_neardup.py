import random

import numpy as np

from marginalia.llm.neardup import duplicate_classes, near_duplicates, row_pairs, shingles, sketch
from marginalia.llm.words import words

ROW = "chunk_id long, text string, n int, id string"


def brute(rows, threshold, size, least):
    sets = {}
    for i, text in rows:
        w = words(text)
        if len(w) >= max(1, least):
            k = min(size, len(w))
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def corpus(seed=5):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    rows = []
    for i in range(60):
        base = say(rng.randrange(30, 120))
        for _ in range(rng.randrange(1, 5)):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + k, rows[0][1]) for k in range(6)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "only three words"), (2004, "Only, three WORDS!"), (2005, "word " * 30_000)]
    return rows


def test_pairs_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], ROW)
    got = [tuple(r) for r in row_pairs(near_duplicates(df, "chunk_id", threshold=0.7, size=3, least_words=30)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7, 3, 30)


def test_large_classes_are_joined_in_blocks(spark, monkeypatch):
    from marginalia.llm import neardup

    monkeypatch.setattr(neardup, "CLASS_BLOCK", 3)
    rows = corpus(6)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], ROW)
    got = [tuple(r) for r in row_pairs(near_duplicates(df, "chunk_id")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.8, 5, 1)


def test_classes(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "A b c d e f g h i J."), (3, "x y"), (4, None)]
    got = {r.chunk_id: (r.class_id, r.n_links) for r in duplicate_classes(spark.createDataFrame([(i, t, 0, "") for i, t in rows], ROW), "chunk_id").collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 0)}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(1, 1 << 62, 700, dtype=np.uint64), rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    a, b = np.concatenate((shared, own[:150])), np.concatenate((shared, own[150:]))
    regs = sketch([a, b], 4096)
    assert abs((regs[0] == regs[1]).mean() - 0.7) < 0.05
    assert (sketch([shingles(["a"], 3)]) == sketch([shingles(["a"], 5)])).all()


def test_empty(spark):
    df = spark.createDataFrame([], ROW)
    assert duplicate_classes(df, "chunk_id").count() == 0
    assert row_pairs(near_duplicates(df, "chunk_id")).count() == 0
