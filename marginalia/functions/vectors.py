"""Vector arithmetic: as Column expressions, and blocked for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")
QUERY_BLOCK = 4096
QUERY_BYTES = 64 << 20
ROW_BYTES = 64 << 20
STRIP_ROWS = 4096
PARTS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` by its length; a zero vector stays as it is."""
    n = F.when(norm(a) > 1e-9, norm(a)).otherwise(1.0)
    return F.transform(a, lambda x: x.cast("double") / n)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine distance, squared Euclidean distance, or one less the dot product."""
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    if metric == "dot":
        return 1 - dot(a, b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def score(d: Column, precision: int = 4) -> Column:
    return F.round(1 / (1 + d), precision)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group in a batch the sum of its vectors and their number, with the batch's part."""
    context = TaskContext.get()
    at = context.partitionId() if context else 0
    for batch in batches:
        if batch.num_rows:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            groups = batch.column(0).dictionary_encode()
            codes = groups.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            present, starts = np.unique(codes[order], return_index=True)
            sums = np.add.reduceat(x[order], starts, axis=0)
            ends = np.arange(0, sums.size + 1, x.shape[1], dtype=np.int32)
            n = np.diff(np.append(starts, len(codes)))
            part = pa.array(np.full(len(present), at % PARTS, np.int32))
            yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(present)), part, pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel())), pa.array(n)], names=["g", "part", "s", "n"])
            at += 1


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of all sums of a group, which are added batch by batch."""
    total, n, first = 0.0, 0, None
    for b in batches:
        if b.num_rows:
            first = b.slice(0, 1) if first is None else first
            total = total + b.column("s").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).sum(axis=0)
            n += int(b.column("n").to_numpy().sum())
    if first is not None:
        yield pa.RecordBatch.from_arrays([first.column("g"), first.column("part"), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n])], names=["g", "part", "s", "n"])


def mean_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """The mean vector of each group as (``by``, mean). Null groups and vectors are left out.

    A task adds up each batch's vectors by group, so what is shuffled is one sum per group and batch. Sums meet in ``PARTS`` parts
    of a group first, then these: a group of any size is spread.
    """
    kind = dict(rows.dtypes)[by]
    own = rows.select(F.col(by).alias("g"), F.col(vector).alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    schema = f"g {kind}, part int, s array<double>, n long"
    sums = own.mapInArrow(_partial_sums, schema).groupBy("g", "part").applyInArrow(_added, schema).groupBy("g").applyInArrow(_added, schema)
    return sums.select(F.col("g").alias(by), F.transform("s", lambda x: x / F.col("n")).alias("mean"))


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        qn, xn = np.linalg.norm(q, axis=1, keepdims=True), np.linalg.norm(x, axis=1, keepdims=True)
        return 1 - (q / np.where(qn > 0, qn, 1)) @ (x / np.where(xn > 0, xn, 1)).T
    if metric == "dot":
        return 1 - q @ x.T
    return (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length, as rows."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def one_block(queries: DataFrame) -> pa.Table | None:
    """The queries themselves where they are at most ``QUERY_BLOCK`` vectors and ``QUERY_BYTES``, else nothing."""
    first = queries.limit(QUERY_BLOCK + 1).toArrow()
    return first if first.num_rows <= QUERY_BLOCK and first.nbytes <= QUERY_BYTES else None


def against(table: DataFrame, queries: DataFrame, kernel: Callable[[pa.Table, pa.RecordBatch], pa.RecordBatch], schema: str, block: pa.Table | None) -> DataFrame:
    """``kernel(queries, rows)`` for all queries against all rows of ``table``; both have a column ``vector`` without nulls.

    Queries that are one ``block`` are broadcast and no row moves. More of them are cut into blocks of that size, and the rows into
    blocks of ``ROW_BYTES``: a task gets one of each, so neither the driver nor a task holds more, however many there are.
    """
    if block is not None:
        shared = table.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and shared.value.num_rows:
                    yield kernel(shared.value, batch)

        return table.mapInArrow(run, schema)

    n, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    asked = max(-(-n // QUERY_BLOCK), -(-n * width * 8 // QUERY_BYTES))
    parts = max(1, -(-table.count() * width * 8 // ROW_BYTES))
    columns = table.columns
    left = table.withColumns({"rb": F.pmod(F.xxhash64(*columns), F.lit(parts)), "qb": F.explode(F.sequence(F.lit(0), F.lit(asked - 1)))})
    right = queries.withColumns({"qb": F.pmod(F.xxhash64("query_id"), F.lit(asked)).cast("int"), "rb": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})

    empty = table.sparkSession.createDataFrame([], schema).toArrow()

    def both(rows: pa.Table, q: pa.Table) -> pa.Table:
        made = [kernel(q, b) for b in rows.select(columns).to_batches(max_chunksize=STRIP_ROWS) if b.num_rows and q.num_rows]
        return pa.Table.from_batches(made) if made else empty

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(both, schema)


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, top_k: int = 10, metric: str = "cosine", skip: str | None = None) -> DataFrame:
    """The ``top_k`` nearest rows of every query as (query_id, id, distance, rank), exactly; ties by id.

    A task multiplies a block of queries (query_id, vector) with a batch of rows and keeps ``top_k`` per query, so what is shuffled
    after it is at most ``top_k`` rows per query and batch; see ``against`` for how the blocks meet. Rows whose number in
    column ``skip`` equals the query's column ``own``, or its id where there is none, are passed over: the id column itself leaves
    out the query's own row, a group column its own group. Null vectors are left out.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    own_group = F.col(skip).cast("long") if skip else F.lit(None).cast("long")
    table = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"), own_group.alias("g")).where("vector IS NOT NULL")
    own_query = F.col("own" if "own" in queries.columns else "query_id").cast("long").alias("own")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), own_query, "vector").where("vector IS NOT NULL")

    def best(q: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("id").to_numpy()
        d = np.round(distances(matrix(q["vector"]), matrix(batch.column("vector")), metric), 9)
        if skip:
            d[q["own"].to_numpy()[:, None] == batch.column("g").fill_null(-(1 << 62)).to_numpy()[None, :]] = np.inf
        k = min(top_k, len(own))
        order = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, :k]
        flat = np.take_along_axis(d, order, 1).ravel()
        keep = np.isfinite(flat)
        ids = np.repeat(q["query_id"].to_numpy(), k)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(own[order].ravel()[keep]), pa.array(flat[keep])], names=["query_id", "id", "distance"])

    found = against(table, asked, best, "query_id long, id long, distance double", one_block(asked))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
