import random

from marginalia.llm.components import connected_groups

PAIR = "source string, target string"


def brute(pairs):
    group = {}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        if a and b and a.strip() and b.strip():
            a, b = a.strip(), b.strip()
            group.setdefault(a, a)
            group.setdefault(b, b)
            x, y = top(a), top(b)
            group[max(x, y)] = min(x, y)
    return {x: top(x) for x in group}


def run(spark, pairs):
    rows = connected_groups(spark.createDataFrame(pairs, PAIR)).collect()
    assert len(rows) == len({r.note_path for r in rows})
    return {r.note_path: r.group_path for r in rows}


def test_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(60)}.md", f"n{rng.randrange(60)}.md") for _ in range(45)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]  # a chain
    pairs += [("hub", f"s{i}") for i in range(50)]  # a star
    pairs += [(None, "x"), ("", "y"), (" \t", "z"), ("p", None), (" pad ", "pad2"), ("self", "self"), ("pad2", " pad"), ("é", "Z"), ("hub", "s1"), ("s1", "hub")]
    assert run(spark, pairs) == brute(pairs)


def test_hot_nodes_are_joined_by_broadcast(spark, monkeypatch):
    from marginalia.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "MOST_HOT", 10**6)
    pairs = [("a", f"s{i}") for i in range(60)] + [("b", f"t{i}") for i in range(20)]
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None), (" ", "a")]) == {}
