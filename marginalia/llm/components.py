"""Consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.lineage import Scratch
from marginalia.functions.strings import present, strip
from marginalia.operators.graph import numbered
from marginalia.operators.skew import hot_bound, join_unique


def _clean_pairs(edges: DataFrame, source: str, target: str) -> DataFrame:
    a, b = strip(F.col(source).cast("string")), strip(F.col(target).cast("string"))
    pairs = edges.select(a.alias("a"), b.alias("b")).where(present(F.col("a")).isNotNull() & present(F.col("b")).isNotNull())
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_groups(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """One row per node as (note_path, group_path): the least node, by code points, that pairs link it to.

    Hash-to-min: every node holds a cluster, at first itself and its neighbours. In a round it sends the cluster to the
    cluster's least member and that member to all others; what a node receives is its next cluster. Rounds end when every node
    but the least of its cluster holds nothing but that one, for then no message would bring anything new: the least node of a group
    holds the group. Their number grows with the logarithm of the longest path. Clusters are rows (node, member), never collections,
    so a giant group is spread like any table; the rows of a node that has more of them than a task should hold are joined where
    they are. A node that holds only the least member is told by it and sends no message, as it could only tell it what it knows.
    Nodes are numbers in the order of their names; each round is written to the shared folder.

    Ends are trimmed of white space; pairs with a null or blank end are left out. A node paired with itself alone is its own
    group. Repeated and reversed pairs count once, other columns are ignored, an empty table gives no rows.
    """
    disk = Scratch(edges.sparkSession, "groups")
    pairs, nodes, _ = numbered(disk.table(_clean_pairs(edges, source, target)), disk)
    clusters = pairs.select(F.inline(F.array(*(F.struct(F.col(v).alias("v"), F.col(u).alias("u")) for v in "xy" for u in "xy")))).distinct()
    clusters = disk.table(clusters)
    while True:
        sizes = clusters.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        open_ = F.count_if((F.col("m") < F.col("v")) & (F.col("n") > 1))
        least, seen = disk.measured(sizes, open=open_, total=F.sum("n"), most=F.max("n"))
        if not seen["open"]:
            break
        known = least.select("v", "m", (F.col("n") == 1).alias("told"))
        if seen["most"] > hot_bound(seen["total"]):
            sent = join_unique(clusters, known, "v", least.select("v", "n"), seen["total"])
        else:
            sent = clusters.join(known, "v")
        news = sent.where("v = m OR NOT told").select(F.inline(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))))
        after = disk.table(news.distinct())
        disk.drop(clusters, least)
        clusters = after

    named = nodes.select("v", "name").join(least.select("v", "m"), "v").select(F.col("name").alias("note_path"), "m")
    heads = least.where("v = m").join(nodes.select("v", "name"), "v").select("m", "n", F.col("name").alias("group_path"))
    return join_unique(named, heads.select("m", "group_path"), "m", heads.select("m", "n"), seen["total"] or 0).select("note_path", "group_path")
