"""Physical layouts: clustering by k-means or by an anchor, ordered writes, and locality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.stats import content_hash
from tarnfield.functions.vector import l2, l2_squared
from tarnfield.operators.predicate import implies
from tarnfield.operators.relational import run_lengths
from tarnfield.operators.topk import query_blocks, ranked
from tarnfield.session import new_path


def train_centroids(df: DataFrame, k: int, *, vector: str = "embedding", sample: float = 1.0, seed: int = 17, steps: int = 10) -> list[list[float]]:
    """k-means centroids (distributed training on a seeded share of the rows)."""
    rows = (df if sample >= 1 else df.sample(sample, seed)).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=steps).fit(rows)
    return [list(map(float, c)) for c in model.clusterCenters()]


def assign(df: DataFrame, centroids: list[list[float]], *, vector: str = "embedding") -> DataFrame:
    """Adds cluster_id and centroid_distance_sq of the nearest centroid (ties: the smaller number)."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "c int, centroid array<double>")
    # the centroids are a parameter of the layout: k rows
    centers = table.agg(F.array_sort(F.collect_list(F.struct("c", "centroid"))).alias("centers"))
    rows = df.crossJoin(F.broadcast(centers))
    best = F.array_min(F.transform("centers", lambda s: F.struct(l2_squared(vector, s["centroid"]).alias("d"), s["c"].alias("c"))))
    return rows.withColumn("__b", best).select(*df.columns, F.col("__b.c").alias("cluster_id"), F.col("__b.d").alias("centroid_distance_sq"))


def write_clustered(df: DataFrame, path: str, order: list[str], *, files: int = 8) -> None:
    """Files that hold ranges of the order, sorted inside: neighbours share row groups, whose statistics then prune."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class PartialLayout:
    """A clustered copy of the rows that satisfy one predicate: what a partial index is elsewhere."""

    predicate: object
    path: str

    @classmethod
    def build(cls, df: DataFrame, predicate: object, order: list[str], *, files: int = 8) -> PartialLayout:
        path = new_path(df.sparkSession, "partial")
        write_clustered(df.where(predicate.to_column()), path, order, files=files)
        return cls(predicate, path)

    def serve(self, actual: object, df: DataFrame) -> tuple[bool, DataFrame]:
        """(whether the copy is used, the rows to search): the copy if ``actual`` provably implies its predicate, else
        ``df``; the caller filters by ``actual`` either way."""
        if implies(actual, self.predicate):
            return True, df.sparkSession.read.schema(df.schema).parquet(self.path)
        return False, df


def anchor_order(df: DataFrame, anchor: Column) -> DataFrame:
    """Rows with their distance to one anchor vector, the order of an anchor layout."""
    return df.withColumn("anchor_distance", l2("embedding", anchor)).orderBy("anchor_distance", "id")


def page_of(df: DataFrame, rows_per_page: int) -> DataFrame:
    """Adds ``page``: file and block of rows of each row as it lies on disk (emulates a heap page)."""
    at = F.concat_ws(":", F.xxhash64("_metadata.file_path").cast("string"), F.floor(F.col("_metadata.row_index") / rows_per_page).cast("string"))
    return df.select(*df.columns, at.alias("page"))


def locality(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Per query: rows, page changes in rank order and distinct pages of its results."""
    return run_lengths(results.join(pages.select("id", "page"), "id"), ["query_id"], "page", ["rank_no"])


def page_order(results: DataFrame) -> DataFrame:
    """Candidates in the order of their pages; the rank they carry restores the order of the results."""
    return results.orderBy("query_id", "page", "id")


def fingerprints(df: DataFrame, columns: list[str], layout: str) -> DataFrame:
    """(logical, physical): content hash that ignores the layout, and one that includes it."""
    return df.agg(content_hash(*columns).cast("string").alias("logical"), content_hash(*columns, layout).cast("string").alias("physical"))


def probe_clusters(df: DataFrame, centroids: list[list[float]], query: list[float], probes: int) -> DataFrame:
    """Rows of the ``probes`` clusters nearest to the query (approximate search; exact within them)."""
    d = sorted((sum((a - b) ** 2 for a, b in zip(query, c)), i) for i, c in enumerate(centroids))
    return df.where(F.col("cluster_id").isin([i for _, i in d[:probes]]))


def cluster_search(df: DataFrame, centroids: list[list[float]], queries: DataFrame, k: int, probes: int, *, block_rows: int = 4096) -> DataFrame:
    """(query_id, id, distance_sq, rank_no): the k nearest rows within the ``probes`` clusters nearest to each query.

    ``df`` has (id, embedding, cluster_id). The query set goes to the tasks in blocks of ``block_rows``; a row is
    compared with the queries that probe its cluster, batch by batch, as one matrix product per cluster.
    """
    import numpy as np
    import pyarrow as pa

    centers, found = np.array(centroids, float), None
    for block in query_blocks(queries, "query_id", block_rows):
        part = block.orderBy("query_id").collect()  # one block of the stated query set
        if not part:
            continue
        ids, q = np.array([r.query_id for r in part], np.int64), np.array([r.query_vector for r in part], float)
        far = (q**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * q @ centers.T
        probed = np.argsort(far, axis=1, kind="stable")[:, :probes]

        def run(batches, ids=ids, q=q, probed=probed):
            for b in batches:
                if not b.num_rows:
                    continue
                cid, cell = b["id"].to_numpy().astype(np.int64), b["cluster_id"].to_numpy()
                x = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                for c in np.unique(cell):
                    mine, asks = np.flatnonzero(cell == c), np.flatnonzero((probed == c).any(axis=1))
                    if not len(asks):
                        continue
                    d = ((q[asks, None] - x[None, mine]) ** 2).sum(axis=2) if len(asks) * len(mine) < 100_000 else (q[asks] ** 2).sum(axis=1)[:, None] + (x[mine] ** 2).sum(axis=1) - 2 * q[asks] @ x[mine].T
                    d[ids[asks, None] == cid[mine]] = np.inf
                    kth = np.partition(d, min(k, len(mine)) - 1, axis=1)[:, min(k, len(mine)) - 1 :][:, :1]
                    i, j = np.nonzero((d <= kth + 1e-9 * (1 + np.abs(kth))) & np.isfinite(d))
                    exact = ((q[asks[i]] - x[mine[j]]) ** 2).cumsum(axis=1)[:, -1]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asks[i]]), pa.array(cid[mine[j]]), pa.array(exact)], names=["query_id", "id", "distance_sq"])

        near = df.select("id", "embedding", "cluster_id").mapInArrow(run, "query_id bigint, id bigint, distance_sq double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, id bigint, distance_sq double, rank_no bigint")
    return ranked(found, ["query_id"], [F.col("distance_sq"), F.col("id")], k)
