"""Approximate nearest neighbours: an inverted file over cluster centres, laid out as partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import against, matrix, norm, one_block

INDEX_FROM_ROWS, ROWS_PER_LIST, MOST_LISTS = 5000, 8192, 256
FIT_ROWS = 100_000


def list_count(rows: int) -> int:
    return max(1, min(rows // ROWS_PER_LIST, MOST_LISTS))


def fit_centres(rows: DataFrame, vector: str, lists: int, fit_rows: int = FIT_ROWS, seed: int = 7) -> np.ndarray:
    """Unit-length cluster centres, fitted on at most about ``fit_rows`` rows drawn at random; all rows are indexed later.

    Null and zero vectors have no direction and are not fitted on. One list needs no fitting: any centre holds all rows.
    """
    rows = rows.where(F.col(vector).isNotNull())
    if lists == 1:
        return np.eye(1, len(rows.select(vector).first()[0]))
    rows = rows.where(norm(F.col(vector)) > 0)
    total = rows.count()
    drawn = rows.sample(min(1.0, fit_rows / total), seed=seed) if total > fit_rows else rows
    model = KMeans(k=lists, seed=seed, maxIter=15, distanceMeasure="cosine").fit(drawn.select(array_to_vector(vector).alias("features")))
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def assign(rows: DataFrame, id_col: str, vector: str, centres: np.ndarray) -> DataFrame:
    """Every row with its list, as (id, v, list)."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x @ shared.value.T).argmax(1).astype(np.int32))], names=["id", "v", "list"])

    table = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("v").isNotNull())
    return table.mapInArrow(run, "id long, v array<float>, list int")


def write_index(assigned: DataFrame, path: str) -> None:
    """The index as a table partitioned by list: a search reads only the lists that it probes."""
    assigned.repartition("list", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("list").parquet(path)


def search_index(index: DataFrame, queries: DataFrame, centres: np.ndarray, probes: int, top_k: int = 10) -> DataFrame:
    """The ``top_k`` nearest by cosine among the ``probes`` lists nearest to each query, as (query_id, id, distance, rank).

    Of few queries only the lists that they probe are read. Without queries there are no rows; null vectors are none.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where("vector IS NOT NULL")

    def lists_of(q: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(q["vector"])
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return unit, np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :probes]

    def run(q: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
        own, where, x, ids = batch.column("id").to_numpy(), batch.column("list").to_numpy(), matrix(batch.column("vector")), q["query_id"].to_numpy()
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        unit, lists = lists_of(q)
        out = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        for part in np.unique(where):
            near, there = np.flatnonzero((lists == part).any(1)), where == part
            if len(near):
                d = np.round(1 - unit[near] @ x[there].T, 9)
                k = min(top_k, d.shape[1])
                order = np.lexsort((np.broadcast_to(own[there], d.shape), d), axis=1)[:, :k]
                for column, values in zip(out, (np.repeat(ids[near], k), own[there][order].ravel(), np.take_along_axis(d, order, 1).ravel()), strict=True):
                    column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "id", "distance"])

    block = one_block(asked)
    few = block is not None and block.num_rows
    probed = index.where(F.col("list").isin(np.unique(lists_of(block)[1]).tolist())) if few else index
    found = against(probed.select("id", F.col("v").alias("vector"), "list"), asked, run, "query_id long, id long, distance double", block)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
