"""Graph questions over resolved links: degrees, clusters, bridge notes.

All algorithms are joins and aggregations over edge tables. None collects a component.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.lineage import Scratch
from marginalia.functions.strings import is_blank, present, stem
from marginalia.operators.skew import hot_bound, join_unique

SIBLING_BUCKETS = 64
# Pairs of a cluster that one task may hold.
IN_TASK = 200_000


def note_edges(links: DataFrame, folder: str | None = None) -> DataFrame:
    """Directed edges (source, target) between notes, each once: internal links that have both paths and count as resolved."""
    inner = links.where(F.coalesce(F.col("link_type") != "external", F.lit(True)) & F.coalesce("is_resolved", F.lit(False)))
    own = inner.where(~is_blank(F.col("from_note_path")) & ~is_blank(F.col("to_note_path")))
    own = own.where(F.col("from_note_path").startswith(folder.strip("/") + "/")) if folder else own
    return own.select(F.col("from_note_path").alias("source"), F.col("to_note_path").alias("target")).distinct()


def node_degrees(links: DataFrame) -> DataFrame:
    """(path, label, outlinks, backlinks): internal links out of each note, resolved or not, and resolved ones into it.

    Occurrences count, not distinct edges. The label is the least title that the note's links give, else the stem with spaces for hyphens and
    underscores, capitalised.
    """
    inner = links.where(F.coalesce(F.col("link_type") != "external", F.lit(True)))
    out = inner.where(~is_blank(F.col("from_note_path"))).groupBy(F.col("from_note_path").alias("path")).agg(F.count("*").alias("outlinks"), F.min(present(F.col("from_note_title"))).alias("title"))
    into = inner.where(F.coalesce("is_resolved", F.lit(False)) & ~is_blank(F.col("to_note_path"))).groupBy(F.col("to_note_path").alias("path")).agg(F.count("*").alias("backlinks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    label = F.initcap(F.translate(stem(F.col("path")), "-_", "  "))
    return out.join(into, "path", "full_outer").select("path", F.coalesce("title", label).alias("label"), zero("outlinks"), zero("backlinks"))


def unlinked_notes(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Notes of the catalog that are no node of the graph, as (path)."""
    nodes = node_degrees(links).select("path")
    return catalog.where("deleted_at IS NULL").where(~is_blank(F.col("path"))).select("path").distinct().join(nodes, "path", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, each once, without loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def numbered(pairs: DataFrame, disk: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Edges (x, y) of ``pairs`` (a, b) by numbers, their nodes (v, name, n), and the number of edge ends.

    Numbers are in the order of the names; ``n`` tells in how many pairs a node stands. Nodes with many pairs are joined without moving these.
    """
    ends = pairs.select(F.col("a").alias("name")).unionAll(pairs.select("b")).groupBy("name").agg(F.count("*").alias("n"))
    ordered = ends.repartitionByRange("name").sortWithinPartitions("name")
    nodes, seen = disk.measured(ordered.select(F.monotonically_increasing_id().alias("v"), "name", "n"), total=F.sum("n"), most=F.max("n"))
    total = seen["total"] or 0
    counts = nodes if (seen["most"] or 0) > hot_bound(total) else None
    out = pairs
    for side, number in (("a", "x"), ("b", "y")):
        known = nodes.select(F.col("name").alias(side), F.col("v").alias(number))
        out = join_unique(out, known, side, counts.select(F.col("name").alias(side), "n"), total) if counts else out.join(known, side)
    return disk.table(out.select("x", "y")), nodes, total


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the least node of the node's connected component, for every node of ``pairs`` (a, b).

    Nodes are numbered in their order. Two star operations alternate until nothing changes: each node links its larger neighbours to
    its least one, then its smaller ones and itself. Both are one aggregation and one join; edges never grow in number, and rounds
    with the logarithm of the longest path. A round is one job; only tables in which a node may be hot are written in between.
    """
    disk = Scratch(pairs.sparkSession, "components")
    edges, nodes, total = numbered(pairs, disk)
    mark = None
    while True:
        held = []

        def reused(df: DataFrame, total: int = total, held: list = held) -> DataFrame:
            if total <= hot_bound(total):
                return df
            held.append(disk.table(df))
            return held[-1]

        both = edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = reused(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n")))
        star = join_unique(both, least.select("x", "m"), "x", least.select("x", "n"), total)
        large = reused(star.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        own = reused(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        tied = join_unique(large, own.select("u", "m"), "u", own.select("u", "n"), total)
        small = tied.select(F.col("v").alias("y"), F.col("m").alias("x")).unionAll(own.select(F.col("u").alias("y"), F.col("m").alias("x")))
        after = small.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        after, now = disk.measured(after, n=F.count("*"), a=F.bit_xor(F.xxhash64("x", "y")), b=F.sum(F.xxhash64("y", "x").cast("decimal(38,0)")))
        disk.drop(edges, *held)
        edges, total = after, 2 * now["n"]
        if now == mark:
            break
        mark = now

    heads = edges.groupBy("x").agg(F.count("*").alias("n"))
    label = edges.select(F.col("y").alias("v"), F.col("x").alias("c")).unionByName(heads.select(F.col("x").alias("v"), F.col("x").alias("c")))
    named = label.join(nodes.select("v", F.col("name").alias("node")), "v").select("node", "c")
    of_head = nodes.select(F.col("v").alias("c"), F.col("name").alias("component"))
    return join_unique(named, of_head, "c", heads.select(F.col("x").alias("c"), (F.col("n") + 1).alias("n")), total).select("node", "component")


def link_clusters(edges: DataFrame, min_size: int = 3) -> DataFrame:
    """Clusters of at least ``min_size`` notes, as (component, size, n_edges, density); a cluster is named by its least note.

    Density is the share of all pairs of its notes that are linked, to three places.
    """
    disk = Scratch(edges.sparkSession, "clusters")
    pairs = disk.table(undirected(edges))
    return _measured_clusters(pairs, disk.table(components(pairs)), min_size)


def _measured_clusters(pairs: DataFrame, label: DataFrame, min_size: int) -> DataFrame:
    sizes = label.groupBy("component").agg(F.count("*").alias("size"))
    inner = _with_component(pairs, label).groupBy("component").agg(F.count("*").alias("n_edges"))
    big = sizes.where(F.col("size") >= min_size).join(inner, "component")
    density = F.round(F.col("n_edges") / (F.col("size") * (F.col("size") - 1) / 2), 3)
    return big.select("component", "size", "n_edges", density.alias("density"))


def cluster_members(edges: DataFrame, min_size: int = 3, clusters: int = 20, notes: int = 20) -> DataFrame:
    """The first ``notes`` notes, by path, of each of the ``clusters`` largest clusters, as (component, size, n_edges, density, node, position,
    truncated); ``truncated`` tells that the cluster has more. Ties between clusters go by name."""
    disk = Scratch(edges.sparkSession, "clusters")
    pairs = disk.table(undirected(edges))
    label = disk.table(components(pairs))
    top = _measured_clusters(pairs, label, min_size).orderBy(F.desc("size"), "component").limit(clusters)
    inside = label.join(F.broadcast(top), "component")
    # A task's first notes of a cluster suffice for the first of all: clusters of any size are thinned before they meet.
    part = F.spark_partition_id()
    near = inside.withColumn("p", part).withColumn("r", F.row_number().over(Window.partitionBy("component", "p").orderBy("node"))).where(F.col("r") <= notes)
    ranked = near.withColumn("position", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("position") <= notes)
    return ranked.select("component", "size", "n_edges", "density", "node", "position", (F.col("size") > notes).alias("truncated"))


def cut_points(u: list, v: list) -> list[tuple[object, int]]:
    """The articulation points of one component's edges, with the number of parts that come loose (depth-first search)."""
    near: dict = {}
    for a, b in zip(u, v, strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    start = min(near)
    found_at, low, loose = {start: 0}, {start: 0}, dict.fromkeys(near, 0)
    path = [(start, None, iter(near[start]))]
    while path:
        node, parent, left = path[-1]
        for other in left:
            if other not in found_at:
                found_at[other] = low[other] = len(found_at)
                path.append((other, node, iter(near[other])))
                break
            if other != parent:
                low[node] = min(low[node], found_at[other])
        else:
            path.pop()
            if parent is not None:
                low[parent] = min(low[parent], low[node])
                loose[parent] += low[node] >= found_at[parent]
    loose[start] -= 1
    return [(node, n) for node, n in loose.items() if n > 0]


def bridge_notes(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """Articulation points, as (node, score, connections): notes without which their cluster falls apart.

    ``score`` is the number of parts that come loose, ``connections`` the distinct neighbours. Clusters of at most ``in_task``
    pairs are searched in a task each, larger ones by rounds of joins (``_bridges_by_levels``); both give the same.
    """
    disk = Scratch(edges.sparkSession, "clusters")
    pairs = disk.table(undirected(edges))
    label = disk.table(components(pairs))
    placed = disk.table(_with_component(pairs, label))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    large = disk.table(sizes.where(F.col("n") > in_task).select("component"))

    def run(table: pa.Table) -> pa.Table:
        found = cut_points(table.column("a").to_pylist(), table.column("b").to_pylist())
        return pa.table({"node": pa.array([p for p, _ in found], pa.string()), "score": pa.array([n for _, n in found], pa.int64())})

    points = placed.join(F.broadcast(large), "component", "left_anti").groupBy("component").applyInArrow(run, "node string, score long")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("connections"))
    out = points.join(degree, "node").select("node", "score", "connections")
    if large.isEmpty():
        return out
    big = placed.join(F.broadcast(large), "component", "left_semi")
    return out.unionByName(_bridges_by_levels(disk.table(big.select("a", "b")), label.join(F.broadcast(large), "component", "left_semi")))


def _with_component(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """``pairs`` with the component of their first node; a node may have any number of pairs."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    return join_unique(pairs, label.withColumnRenamed("node", "a"), "a", counts, pairs.count())


def _bridges_by_levels(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """``bridge_notes`` of clusters of any size, from their distinct pairs (a, b) and components.

    After Tarjan and Vishkin, level by level of a breadth-first tree: subtree sizes go up, preorder numbers go down by prefix
    sums among siblings, the least and greatest number that a subtree reaches go up. Tree edges that share a circle are then
    connected; each class of them is a block, and a note in several blocks holds them together. The number of rounds is the
    depth of the tree.
    """
    disk = Scratch(pairs.sparkSession, "bridges")
    both = disk.table(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    degree = disk.table(both.groupBy("u").agg(F.count("*").alias("n")))
    n_ends = degree.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    levels = [disk.table(label.where("node = component").select("node", F.lit(None).cast("string").alias("parent"), F.col("component").alias("root")))]
    seen = levels[0].select("node")
    while True:
        front = levels[-1].select(F.col("node").alias("u"), "root")
        reached = join_unique(both, front, "u", degree, n_ends).groupBy("v").agg(F.min(F.struct("u", "root")).alias("p"))
        fresh = reached.join(seen.withColumnRenamed("node", "v"), "v", "left_anti").select(F.col("v").alias("node"), F.col("p.u").alias("parent"), F.col("p.root").alias("root"))
        fresh = disk.table(fresh)
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = disk.table(seen.unionByName(fresh.select("node")))

    sizes, below = [None] * len(levels), None
    for d in range(len(levels) - 1, -1, -1):
        own = levels[d].select("node", "parent", "root")
        if below is None:
            sized = own.withColumn("size", F.lit(1).cast("long"))
        else:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("s"))
            sized = own.join(sums, "node", "left").select("node", "parent", "root", (1 + F.coalesce("s", F.lit(0))).alias("size"))
        sizes[d] = below = disk.table(sized)

    numbered = [disk.table(sizes[0].withColumn("pre", F.lit(0).cast("long")))]  # numbers are compared within a cluster only
    for d in range(1, len(levels)):
        up = numbered[-1].select(F.col("node").alias("parent"), F.col("pre").alias("p"))
        cut = sizes[d].withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS)))
        sums = cut.groupBy("parent", "bucket").agg(F.sum("size").alias("s"))
        earlier = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        start = sums.join(up, "parent").select("parent", "bucket", (F.col("p") + 1 + F.coalesce(F.sum("s").over(earlier), F.lit(0))).alias("start"))
        siblings = Window.partitionBy("parent", "bucket").orderBy("node")
        placed = cut.withColumn("before", F.sum("size").over(siblings) - F.col("size")).join(start, ["parent", "bucket"])
        numbered.append(disk.table(placed.select("node", "parent", "root", "size", (F.col("start") + F.col("before")).alias("pre"))))

    tree = numbered[0]
    for n in numbered[1:]:
        tree = tree.unionByName(n.select(tree.columns))
    tree = disk.table(tree)
    place = tree.select("node", "pre", "size", "parent")
    of = lambda c: place.select(F.col("node").alias(c), F.col("pre").alias("p" + c), F.col("size").alias("s" + c), F.col("parent").alias("f" + c))
    far = join_unique(join_unique(both, of("u"), "u", degree, n_ends), of("v"), "v", degree.withColumnRenamed("u", "v"), n_ends)
    back = disk.table(far.where("NOT (u <=> fv OR v <=> fu)"))
    reach = back.groupBy(F.col("u").alias("node")).agg(F.min("pv").alias("lo"), F.max("pv").alias("hi"))

    spans, below = [], None
    for d in range(len(levels) - 1, -1, -1):
        own = numbered[d].join(reach, "node", "left")
        lo, hi = F.least("pre", "lo"), F.greatest("pre", "hi")
        if below is not None:
            sub = below.groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("cl"), F.max("high").alias("ch"))
            own = own.join(sub, "node", "left")
            lo, hi = F.least(lo, "cl"), F.greatest(hi, "ch")
        below = disk.table(own.select("node", "parent", "pre", "size", lo.alias("low"), hi.alias("high")))
        spans.append(below)
    reached = spans[0]
    for s in spans[1:]:
        reached = reached.unionByName(s)
    reached = disk.table(reached)

    # A tree edge is named by its lower end. Two are joined if a circle runs through both.
    unrelated = back.where("pu + su <= pv").select(F.col("u").alias("a"), F.col("v").alias("b"))
    kids = reached.where("parent IS NOT NULL")
    up = reached.select(F.col("node").alias("parent"), F.col("pre").alias("pp"), F.col("size").alias("ps"), F.col("parent").alias("grand"))
    leaving = kids.join(up, "parent").where("grand IS NOT NULL AND (low < pp OR high >= pp + ps)").select(F.col("parent").alias("a"), F.col("node").alias("b"))
    joined = unrelated.unionByName(leaving).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    blocks = components(joined)
    of_edge = kids.join(blocks, "node", "left").select("node", "parent", F.coalesce("component", "node").alias("block"))
    held = of_edge.select("node", "block").unionByName(of_edge.select(F.col("parent").alias("node"), "block")).distinct()
    points = held.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return points.join(degree.select(F.col("u").alias("node"), F.col("n").alias("connections")), "node").select("node", (F.col("n") - 1).alias("score"), "connections")
