"""Ranked retrieval: candidate pools, fusion, reranking, formatting."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import against, distances, matrix, mean_vectors, one_block, score

RRF_K = 60
CANDIDATES, MOST_CANDIDATES, MULTIPLIER = 50, 500, 2
RERANK_LEAST = 10
QUERY_STRIP = 256


def candidate_count(top_k: int) -> int:
    return min(max(CANDIDATES, top_k * MULTIPLIER), MOST_CANDIDATES)


def rerank_pool(n: int, top_k: int) -> int:
    return min(n, max(top_k, min(RERANK_LEAST, top_k * MULTIPLIER)))


def fuse(rankings: list[DataFrame], top_k: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, id, rank) as (query_id, id, score, best_rank, rank).

    A row's score sums 1 / (k + rank) over the rankings it is in; ties go to the better best rank, then the lower id.
    """
    every = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "id", "rank"))
    fused = every.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "best_rank", "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def lexical_score(query: Column, text: Column) -> Column:
    """The share of a query's distinct words that a text holds: the reranker that needs no model."""
    q = F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    t = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def rerank(ranked: DataFrame, top_k: int, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """The first rows of each query ordered anew by ``scorer(query, text)``, rounded to four places, ties as before.

    ``ranked`` has (query_id, id, rank, query, text). Only the pool of ``rerank_pool`` rows is scored, so from ten results on
    reranking changes their order and never which they are.
    """
    pool = ranked.where(F.col("rank") <= rerank_pool(MOST_CANDIDATES, top_k)).withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return pool.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k)


def nearest_groups(rows: DataFrame, queries: DataFrame, by: str, vector: str, top_k: int) -> DataFrame:
    """The ``top_k`` groups nearest to every query (query_id, vector) other than the query's own, as (query_id, other, distance, rank).

    A group is as far as its nearest row, ties go by group. A task keeps the least distance per query and group of a batch, and of
    those the first ``top_k`` groups. That loses none: a group that ranks first overall ranks so in the batch of its nearest row, as
    whatever is ahead of it there is ahead of it overall. Rows without a group or vector are left out.
    """
    table = rows.select(F.col(by).cast("long").alias("g"), F.col(vector).alias("vector")).where("g IS NOT NULL AND vector IS NOT NULL")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where("vector IS NOT NULL")

    def least(q: pa.Table, batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("g").to_numpy()
        order = np.argsort(own, kind="stable")
        groups, starts = np.unique(own[order], return_index=True)
        x, vectors, ids = matrix(batch.column("vector"))[order], matrix(q["vector"]), q["query_id"].to_numpy()
        k, out = min(top_k, len(groups)), ([], [], [])
        for at in range(0, len(ids), QUERY_STRIP):
            strip = ids[at : at + QUERY_STRIP]
            d = np.round(distances(vectors[at : at + QUERY_STRIP], x, "cosine"), 9)
            best = np.minimum.reduceat(np.where(np.isfinite(d), d, np.inf), starts, axis=1)
            best[strip[:, None] == groups[None, :]] = np.inf
            first = np.argsort(best, axis=1, kind="stable")[:, :k]
            flat = np.take_along_axis(best, first, 1).ravel()
            keep = np.isfinite(flat)
            for column, values in zip(out, (np.repeat(strip, k), groups[first].ravel(), flat), strict=True):
                column.append(values[keep])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "other", "distance"])

    block = one_block(asked)
    own = table if block is not None else table.distinct()  # copies in a group would meet in one block of rows
    found = against(own, asked, least, "query_id long, other long, distance double", block)
    nearest_rows = found.groupBy("query_id", "other").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "other")
    return nearest_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def similar_groups(rows: DataFrame, groups: DataFrame, by: str, id_col: str, vector: str, top_k: int = 5) -> DataFrame:
    """Groups (notes) nearest to each group of ``groups`` (one column ``by``), as (query_id, other, distance, rank).

    A group is represented by its mean vector; another group is as far as its nearest row. All rows of all groups count, however many
    one group has. ``by`` must be a number.
    """
    means = mean_vectors(rows.join(F.broadcast(groups.select(by)), by, "left_semi"), by, vector).select(F.col(by).cast("long").alias("query_id"), F.col("mean").alias("vector"))
    return nearest_groups(rows, means, by, vector, top_k)


def formatted(results: DataFrame, distance: str = "distance", reranked: str | None = None) -> DataFrame:
    """Results with the public ``score``: the rerank score if there is one, else 1 / (1 + distance)."""
    by_distance = score(F.col(distance)) if distance in results.columns else F.lit(None).cast("double")
    own = F.coalesce(F.col(reranked), by_distance) if reranked else by_distance
    return results.withColumn("score", own)
