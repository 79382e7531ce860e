"""Joins that survive hot keys without relying on runtime re-planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000
MOST_HOT = 100_000


def is_hot(n: Column, total: int) -> Column:
    """True for keys of more rows than a task should hold.

    That is over ``HOT_ROWS`` rows; in tables of over ``HOT_ROWS * MOST_HOT`` rows (ten billion) the bound rises with the table, so that
    by arithmetic there are never more than ``MOST_HOT`` hot keys to broadcast.
    """
    return n > hot_bound(total)


def hot_bound(total: int) -> int:
    return max(HOT_ROWS, total // MOST_HOT)


def join_unique(big: DataFrame, unique: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined ("inner" or "left") on ``key`` to ``unique``, which has one row per key.

    ``counts`` (``key``, ``n``) tells how often a key stands in ``big``, ``total`` is their sum. The rows that hot keys have
    in ``unique`` are broadcast, at most ``MOST_HOT`` rows, so the rows of ``big`` that have them never move; all other
    keys are shuffled. Where no key can be hot this is a plain join.
    """
    if total <= hot_bound(total):
        return big.join(unique, key, how)
    hot = counts.where(is_hot(F.col("n"), total)).select(key)
    marked = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = F.broadcast(unique.join(F.broadcast(hot), key, "left_semi"))
    there = marked.where("_hot").drop("_hot").join(few, key, how)
    moved = marked.where("_hot IS NULL").drop("_hot").join(unique, key, how)
    return there.unionByName(moved)


def join_any(big: DataFrame, small: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """``big`` joined on ``key`` to ``small``, in which a key may have several rows; either side may have hot keys.

    The rows of a key that is hot in ``big`` are cut by a hash of the row into as many parts as its bound takes, and its rows of
    ``small`` are repeated per part. Keys that are not hot are not repeated. Only the hot keys are broadcast, the ``MOST_HOT`` largest. ``counts`` (``key``, ``n``), if known, tells how often a key stands in ``big``.
    """
    sizes = big.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = F.broadcast(sizes.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(MOST_HOT).select(key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*big.columns), parts).cast("int")).drop("_parts")
    right = small.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")
