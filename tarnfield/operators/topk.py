"""Exact top-k over vectors, batch ground truth with boundary metadata, and recall."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.vector import batch_topk_by, l2, l2_squared


def nearest(candidates: DataFrame, query: Column, k: int, *, id_column: str = "id", vector: str = "embedding", exclude: int | None = None) -> DataFrame:
    """The k candidates nearest to one query vector, by (distance, id): one pass, k rows per task, no shuffle."""
    rows = candidates.where(F.col(id_column) != exclude) if exclude is not None else candidates
    return rows.withColumn("distance", l2(vector, query)).orderBy("distance", id_column).limit(k)


def query_blocks(queries: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """The query set in blocks of about ``rows`` rows, split by a hash of the key; a block is what may be broadcast."""
    number = max(1, -(-queries.count() // rows))
    if number == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(number)) == q) for q in range(number)]


def batch_nearest(candidates: DataFrame, queries: DataFrame, k: int, *, by: list[str] | None = None, keep: list[str] | None = None, block_rows: int = 4096) -> DataFrame:
    """Per query the k nearest candidates by (distance, id), the query itself excluded; adds rank_no.

    ``queries`` (query_id, query_vector) is a stated set, taken in blocks of ``block_rows``, the bound of what is
    broadcast; ``by`` are further columns of the candidates (workload, filter) within which ranks are formed. Ranks
    beyond k are dropped in the tasks already.
    """
    group, found = [*(by or []), "query_id"], None
    for block in query_blocks(queries, "query_id", block_rows):
        pairs = candidates.crossJoin(F.broadcast(block)).where(F.col("id") != F.col("query_id"))
        pairs = pairs.select(*group, "id", l2_squared("embedding", "query_vector").alias("distance_sq"), *(keep or []))
        best = ranked(pairs, group, [F.col("distance_sq"), F.col("id")], k)
        found = best if found is None else found.unionByName(best)
    return found


def batch_nearest_by(candidates: DataFrame, filters: Mapping[str, Column], queries: DataFrame, k: int, *, block_rows: int = 4096) -> DataFrame:
    """(filter_name, query_id, id, distance_sq, rank_no): per filter and query the k nearest candidates.

    The query set goes to the tasks in blocks of ``block_rows``, one pass over the candidates each; distances are
    matrix products that all filters share, and k rows per filter, query and batch leave a task.
    """
    found = None
    for block in query_blocks(queries, "query_id", block_rows):
        rows = block.orderBy("query_id").collect()  # one block of the stated query set
        if rows:
            part = batch_topk_by(candidates, filters, [r.query_id for r in rows], np.array([r.query_vector for r in rows], float), k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return candidates.sparkSession.createDataFrame([], "filter_name string, query_id bigint, id bigint, distance_sq double, rank_no bigint")
    return ranked(found, ["filter_name", "query_id"], [F.col("distance_sq"), F.col("id")], k)


def ranked(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of every group; rank_no is a bigint."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank_no", F.row_number().over(w).cast("bigint")).where(F.col("rank_no") <= k)


def boundary_set(df: DataFrame, group: list[str], score: str, k: int) -> DataFrame:
    """All rows whose score is at most that of the k-th (ties at the boundary included)."""
    w = Window.partitionBy(*group).orderBy(score)
    return df.withColumn("rank_no", F.rank().over(w).cast("bigint")).where(F.col("rank_no") <= k)


def truth(ranks: DataFrame, group: list[str], k: int) -> DataFrame:
    """Boundary metadata of ranks 1..k+1 (distance_sq, id, rank_no): the k ids, the k-th distance, its tolerance, how
    many rows are strictly closer, and whether the row after it ties."""
    r = F.col("rank_no")
    d = F.col("distance_sq")
    kth = F.max(F.when(r == k, d))
    ids = F.transform(F.array_sort(F.collect_list(F.when(r <= k, F.struct("rank_no", "id")))), lambda s: s["id"])
    out = ranks.groupBy(*group).agg(
        ids.alias("exact_ids"), kth.alias("kth_distance_sq"), F.max(F.when(r == k + 1, d)).alias("next_distance_sq"),
        F.transform(F.array_sort(F.collect_list(F.when(r <= k, F.struct("rank_no", "distance_sq")))), lambda s: s["distance_sq"]).alias("distances_sq"),
    )
    tol = tolerance(F.col("kth_distance_sq"))
    closer = F.size(F.filter("distances_sq", lambda x: x < F.col("kth_distance_sq") - tol))
    tied = F.coalesce(F.col("next_distance_sq") <= F.col("kth_distance_sq") + tol, F.lit(False))
    return out.select(*group, "exact_ids", "kth_distance_sq", tol.alias("tie_tolerance"), closer.cast("bigint").alias("strict_closer_count"), tied.alias("boundary_tied"))


def tolerance(kth: Column) -> Column:
    """Tie tolerance of a distance: 1e-9, or a millionth of it if that is more."""
    return F.greatest(F.lit(1e-9), F.abs(kth) * 1e-6)


def tie_aware_recall(found: DataFrame, truths: DataFrame, group: list[str], k: int) -> DataFrame:
    """Recall that accepts any distinct rows within the boundary distance: (group, hits, recall)."""
    rows = found.where(F.col("id") != F.col("query_id")).join(truths.select(*group, "kth_distance_sq", "tie_tolerance"), group)
    hit = F.when(F.col("distance_sq") <= F.col("kth_distance_sq") + F.col("tie_tolerance"), F.col("id"))
    return rows.groupBy(*group).agg(F.least(F.lit(k), F.countDistinct(hit)).cast("bigint").alias("hits")).withColumn("recall", F.col("hits") / k)


def spot_check(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """Ranks where two rankings differ by more than a substitution of tied rows."""
    x = a.select(*group, "rank_no", F.col("id").alias("id_a"), F.col("distance_sq").alias("d_a"))
    y = b.select(*group, "rank_no", F.col("id").alias("id_b"), F.col("distance_sq").alias("d_b"))
    rows = x.join(y, [*group, "rank_no"], "full_outer")
    same = (F.col("id_a") == F.col("id_b")) | (F.abs(F.col("d_a") - F.col("d_b")) <= tolerance(F.col("d_a")))
    return rows.where(~F.coalesce(same, F.lit(False)))
