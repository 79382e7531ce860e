import collections
import random

import pytest

from marginalia.operators import skew
from marginalia.operators.graph import bridge_notes, cluster_members, components, link_clusters, undirected

EDGE = "source string, target string"


def brute(edges):
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def parts(without=None):
        seen, out = set(), []
        for s in near:
            if s == without or s in seen:
                continue
            todo, part = [s], {s}
            while todo:
                for y in near[todo.pop()]:
                    if y != without and y not in part:
                        part.add(y)
                        todo.append(y)
            seen |= part
            out.append(part)
        return out

    whole = parts()
    points = {v: (k, len(near[v])) for v in near if (k := len(parts(v)) - len(whole)) > 0}
    return {x: min(p) for p in whole for x in p}, points


@pytest.mark.parametrize("hot", [10**9, 5])
def test_random_graphs(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(38)] + [("hub", f"s{i}") for i in range(20)]
    df = spark.createDataFrame(edges, EDGE)
    label, points = brute(edges)
    assert {r.node: r.component for r in components(undirected(df)).collect()} == label
    assert {r.node: (r.score, r.connections) for r in bridge_notes(df, 10**6 if hot > 5 else 0).collect()} == points


def test_a_long_chain(spark):
    name = lambda i: f"n{i:05d}"
    df = spark.range(5000).selectExpr("format_string('n%05d', id) AS source", "format_string('n%05d', id + 1) AS target")
    assert {r.component for r in components(undirected(df)).collect()} == {name(0)}
    assert {r.node: r.score for r in bridge_notes(df).collect()} == {name(i): 1 for i in range(1, 5000)}


def test_cluster_members(spark):
    df = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(5)] + [("b0", "b1"), ("b1", "b2"), ("c0", "c1")], EDGE)
    got = [(r.component, r["size"], r.node, r.position, r.truncated) for r in cluster_members(df, 3, 5, 4).orderBy("component", "position").collect()]
    assert got == [("a0", 6, f"a{i}", i + 1, True) for i in range(4)] + [("b0", 3, f"b{i}", i + 1, False) for i in range(3)]


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([("a1", "bridge"), ("a2", "bridge"), ("bridge", "b1"), ("bridge", "b2")], {"bridge": (3, 4)}),
        ([("a", "b"), ("b", "c"), ("c", "a")], {}),
    ],
)
def test_bridges(spark, edges, want):
    assert {r.node: (r.score, r.connections) for r in bridge_notes(spark.createDataFrame(edges, EDGE)).collect()} == want


def test_two_clusters(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "f")], EDGE)
    assert sorted(tuple(r) for r in link_clusters(df, 2).collect()) == [("a", 3, 3, 1.0), ("d", 2, 1, 1.0)]


def test_empty(spark):
    df = spark.createDataFrame([], EDGE)
    assert link_clusters(df).count() == 0 and bridge_notes(df).count() == 0
