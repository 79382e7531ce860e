"""Comparing a scan of the notes with what is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_diff(scanned: DataFrame, indexed: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """Notes that differ, as (path, change): ``new``, ``deleted`` or ``modified``.

    ``scanned`` has (path, mtime timestamp), ``indexed`` (path, modified_at ISO text). Modified means later by more than
    ``tolerance_s`` seconds than indexed; a time that cannot be read counts as modified. Both hold a path once.
    """
    v = scanned.select("path", F.col("mtime").cast("timestamp_ntz").alias("mtime"), F.lit(True).alias("here"))
    i = indexed.select("path", F.try_to_timestamp(F.replace("modified_at", F.lit(" "), F.lit("T"))).cast("timestamp_ntz").alias("seen"), F.lit(True).alias("known"))
    both = v.join(i, "path", "full_outer")
    late = F.col("mtime") > F.col("seen") + F.make_dt_interval(secs=F.lit(tolerance_s))
    change = F.when(F.col("known").isNull(), "new").when(F.col("here").isNull(), "deleted").when(F.col("seen").isNull() | late, "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def sync_totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("notes"))


def reconcile(scan: DataFrame, catalog: DataFrame) -> DataFrame:
    """What brings the catalog in line with a scan, as (path, action): ``upsert`` where a note is missing or its
    (mtime_ns, size) differ, ``delete`` where it is gone. Both hold a path once."""
    a = scan.select("path", F.struct("mtime_ns", "size").alias("now"))
    b = catalog.select("path", F.struct("mtime_ns", "size").alias("then"))
    both = a.join(b, "path", "full_outer")
    action = F.when(F.col("now").isNull(), "delete").when(F.col("then").isNull() | ~F.col("now").eqNullSafe(F.col("then")), "upsert")
    return both.select("path", action.alias("action")).where("action IS NOT NULL")


def latest_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that comes last by ``order``; of exact ties the greatest in all columns."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    last = F.max(F.struct(*order, *rest)).alias("r")
    return rows.groupBy(key).agg(last).select(key, *(F.col(f"r.{c}").alias(c) for c in rows.columns if c != key))
