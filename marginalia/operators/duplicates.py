"""Near-duplicate notes by the cosine of their vectors.

Vectors that are equal are one class. All classes are compared, block against block. ``likely_pairs`` is an approximate option: banded
random hyperplanes, where vectors that agree in all signs of a band meet and are compared exactly. Bands are wide for high thresholds;
their number follows from the recall asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.lineage import Scratch
from marginalia.functions.vectors import dot, norm
from marginalia.operators.graph import IN_TASK, components
from marginalia.operators.skew import join_unique

SEED = 20_240_101
# Of the exact search: vectors in a block at most, and below which more blocks are not worth it; rows of a product at a time.
BLOCK, LEAST_BLOCK, STRIP = 4096, 256, 256
BLOCK_BYTES, PAIR_BYTES = 32 << 20, 16 << 20
MOST_TASKS = 5000


def bands_for(threshold: float, recall: float, bits: int) -> int:
    """Bands so that a pair at the threshold meets in one with probability ``recall``."""
    if threshold <= 0:
        raise ValueError("signs do not select at a threshold of 0 or less: use similar_pairs")
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    return 1 if agree == 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def bits_for(threshold: float) -> int:
    """Signs per band: many where near pairs agree in nearly all of them, few for low thresholds."""
    return 16 if threshold >= 0.9 else 12 if threshold >= 0.8 else 8 if threshold >= 0.6 else 6


def _signs(batches: Iterator[pa.RecordBatch], bands: int, bits: int) -> Iterator[pa.RecordBatch]:
    planes = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        if planes is None:
            planes = np.random.default_rng(SEED).standard_normal((x.shape[1], bands * bits))
        on = (x @ planes > 0).reshape(len(x), bands, bits)
        keys = on @ (1 << np.arange(bits, dtype=np.int64))
        ends = np.arange(0, keys.size + 1, bands, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().astype(np.int64)))], names=["id", "bands"])


def _is_usable(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & (norm(v) > 0), F.lit(False))


def _usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    return own.where(_is_usable(F.col("v")))


def vector_classes(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, class_id) of every row with a usable vector: rows with equal vectors share a class, named by its least id."""
    own = _usable(rows, id_col, vector)
    heads = own.groupBy("v").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_unique(own, heads.select("v", "class_id"), "v", heads.select("v", "n"), total).select("id", "class_id")


def _heads(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): one row per class of equal vectors, with its least id."""
    return _usable(rows, id_col, vector).groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


def _read_block(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sides, ids, vectors and lengths of a group's rows."""
    sides = np.concatenate([b.column("side").to_numpy(zero_copy_only=False) for b in batches])
    ids = np.concatenate([b.column("id").to_numpy() for b in batches])
    x = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) for b in batches])
    return sides, ids, x, np.sqrt((x * x).sum(axis=1))


def _close(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs between two blocks, or within one if there is no second side.

    A matrix product, strip by strip, rules out what lies clearly below the threshold; the rest is computed pair by pair, so that
    a similarity does not depend on how the vectors are blocked.
    """
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    sides, ids, x, length = _read_block(some)
    unit = x / length[:, None]
    left = np.flatnonzero(sides == 0)
    right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
    own = right is left
    step = max(1, PAIR_BYTES // (8 * x.shape[1]))
    for at in range(0, len(left), STRIP):
        strip = left[at : at + STRIP]
        p, q = np.nonzero(unit[strip] @ unit[right].T >= threshold - 1e-9)
        p, q = strip[p], right[q]
        if own:
            p, q = p[(once := ids[p] < ids[q])], q[once]
        for k in range(0, len(p), step):
            i, j = p[k : k + step], q[k : k + step]
            cosine = (x[i] * x[j]).sum(axis=1) / (length[i] * length[j])
            keep = cosine >= threshold
            a, b = ids[i[keep]], ids[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cosine[keep])], names=["a", "b", "similarity"])


def similar_pairs(rows: DataFrame, id_col: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """All pairs (a, b, similarity), a < b, of classes of equal vectors whose cosine is at least ``threshold``.

    Every class is compared to every other: blocks of at most ``BLOCK`` vectors and ``BLOCK_BYTES`` meet in pairs, a group each, so
    no task holds more than two blocks, and only pairs that count leave it. A class is named by its least id;
    ``vector_classes`` has its other members. Null and zero vectors are in no pair.
    """
    spark = rows.sparkSession
    heads = Scratch(spark, "similar").table(_heads(rows, id_col, vector))
    n, width = heads.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, width or 1))))
    busy = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    blocks = max(1, math.ceil(n / most), min(busy, math.ceil(n / LEAST_BLOCK)))
    placed = heads.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # The row's block is the first side of the meetings with itself and later blocks, the second side of those with earlier ones.
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = other.select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("o") < F.col("block")).cast("int").alias("side"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _close(batches, threshold)

    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    return met.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(run, "a long, b long, similarity double")


def likely_pairs(rows: DataFrame, id_col: str, vector: str, threshold: float = 0.9, recall: float = 0.99) -> DataFrame:
    """An approximation of ``similar_pairs`` for high thresholds over many vectors: it loses pairs.

    What is returned is exact; of the pairs at the threshold a share of ``recall`` is found by design, of closer ones more.
    Vectors that share a band's key meet in one join without blocks. The threshold must be over 0.
    """
    disk = Scratch(rows.sparkSession, "likely")
    heads = disk.table(_heads(rows, id_col, vector))
    bits = bits_for(threshold)
    bands = bands_for(threshold, recall, bits)
    keyed = heads.mapInArrow(lambda it: _signs(it, bands, bits), "id long, bands array<long>").select("id", F.posexplode("bands").alias("band", "key"))
    a, b = keyed.select(F.col("id").alias("a"), "band", "key"), keyed.select(F.col("id").alias("b"), "band", "key")
    met = a.join(b, ["band", "key"]).where("a < b").select("a", "b").distinct()
    both = met.join(heads.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(heads.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    cosine = dot(F.col("va"), F.col("vb")) / (norm(F.col("va")) * norm(F.col("vb")))
    return both.select("a", "b", cosine.alias("similarity")).where(F.col("similarity") >= threshold)


def _sequential(table: pa.Table) -> pa.Table:
    """``greedy_groups`` of the pairs of one component, item by item."""
    earlier: dict[int, list[tuple[int, float]]] = {}
    for a, b, similarity in zip(*(table.column(c).to_pylist() for c in ("a", "b", "similarity")), strict=True):
        earlier.setdefault(b, []).append((a, similarity))
    joined: dict[int, tuple[int, float]] = {}
    for b in sorted(earlier):
        if seeds := [x for x in earlier[b] if x[0] not in joined]:
            joined[b] = min(seeds)
    return pa.table({"seed": pa.array([s for s, _ in joined.values()], pa.int64()), "member": pa.array(list(joined), pa.int64()), "similarity": pa.array([x for _, x in joined.values()], pa.float64())})


def greedy_groups(pairs: DataFrame, in_task: int = IN_TASK, rounds: int = 10) -> DataFrame:
    """(seed, member, similarity): each item joins the first earlier item that it matches and that is itself a seed.

    Items are taken in order of id. Components of at most ``in_task`` pairs are gone through in a task each. Larger ones are settled in rounds of joins, until
    none is left: an item without an earlier undecided or seed item that it matches is a seed. One whose first such item is a
    seed joins it; any other waits, since an earlier undecided item may still become its seed. After every ``rounds`` rounds
    what is left is cut into components again. Both ways give the result of a sequential pass.
    """
    disk = Scratch(pairs.sparkSession, "greedy")
    open_ = disk.table(pairs.select("a", "b", "similarity"))
    groups = None

    def add(df: DataFrame) -> None:
        nonlocal groups
        groups = df if groups is None else groups.unionByName(df)

    while not open_.isEmpty():
        label = components(open_.select("a", "b")).withColumnRenamed("node", "a")
        placed = disk.table(join_unique(open_, label, "a", open_.groupBy("a").agg(F.count("*").alias("n")), open_.count()))
        large = F.broadcast(disk.table(placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > in_task).select("component")))
        add(disk.table(placed.join(large, "component", "left_anti").groupBy("component").applyInArrow(_sequential, "seed long, member long, similarity double")))
        rest = disk.table(placed.join(large, "component", "left_semi").select("a", "b", "similarity"))
        disk.drop(open_, placed)
        open_ = rest
        for _ in range(rounds):
            if open_.isEmpty():
                break
            # Pairs stay open while a is undecided or a seed and b is undecided.
            seeds = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            first = open_.groupBy("b").agg(F.min(F.struct("a", "similarity")).alias("s")).select(F.col("s.a").alias("a"), "b", "s.similarity")
            taken = disk.table(first.join(seeds, "a", "left_semi").select(F.col("a").alias("seed"), F.col("b").alias("member"), "similarity"))
            add(taken)
            members = taken.select(F.col("member").alias("b"))
            rest = disk.table(open_.join(members, "b", "left_anti").join(members.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b", "similarity"))
            disk.drop(open_)
            open_ = rest
    return groups if groups is not None else pairs.select(F.col("a").alias("seed"), F.col("b").alias("member"), "similarity")


def linked_classes(rows: DataFrame, id_col: str, vector: str, pairs: DataFrame) -> DataFrame:
    """(id, class_id, n_links) of every row: its class of equal vectors and the number of other classes that ``pairs`` link to it.

    Rows without a usable vector have no class and no link.
    """
    classes = Scratch(rows.sparkSession, "linked").table(vector_classes(rows, id_col, vector))
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("n"))
    total = classes.count()
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    counted = join_unique(classes, links, "class_id", sizes, total, "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    others = rows.where(~_is_usable(F.col(vector))).select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return counted.unionByName(others)


def with_copies(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """``groups`` of classes as groups of rows: copies of a member join its seed, copies of any other row form or join its own group."""
    copies = classes.where("id <> class_id")
    in_group = copies.join(groups.select(F.col("member").alias("class_id"), "seed", "similarity"), "class_id").select("seed", F.col("id").alias("member"), "similarity")
    own = copies.join(groups.select(F.col("member").alias("class_id")), "class_id", "left_anti").select(F.col("class_id").alias("seed"), F.col("id").alias("member"), F.lit(1.0).alias("similarity"))
    return groups.select("seed", "member", "similarity").unionByName(in_group).unionByName(own)


def group_summary(groups: DataFrame) -> DataFrame:
    """(seed, size, avg_similarity): members with the seed, and their mean similarity to it."""
    return groups.groupBy("seed").agg((F.count("*") + 1).alias("size"), F.avg("similarity").alias("avg_similarity"))
