"""Groups of mutually similar records: k-means cells, exact links inside them, connected components over them.

Records come as vectors, or as texts that are vectorised by hashed weighted features. Vectors that share a cell are
compared: every pair that reaches the similarity is a link (int8 bounds first, double precision where those leave it
open), and each task hands on one star per local group instead of its links; the stars are joined into components over
all tasks. :func:`kmeans_groups` gives the cells themselves as clusters, with the members nearest each centroid.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.cells import Cells, Tile, blocks, copies, fit_cells, matrix, usable_vectors
from tarnfield.session import drop_stored, stored

EDGE = "id bigint, rep bigint"


def hashed_features(df: DataFrame, record: str, text: str, *, dim: int = 64, buckets: int = 1 << 18) -> DataFrame:
    """(id, vec): texts as signed hashed word features, weighted by log frequency in the text and inverse document
    frequency. Null and empty texts, and null ids, give no row (their vector would be all zero); repeated rows of an id
    give a row each.

    Words are hashed where they are read; how many texts hold a word is counted per hash bucket, of which there are
    ``buckets``, so the table of weights that goes to the tasks is bounded (words that share a bucket share a weight).
    Nothing is shuffled but that table.
    """
    words = F.filter(F.split(F.lower(F.col(f"`{text}`")), r"(?U)\W+"), lambda w: w != "")
    rows = df.where(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").cast("bigint").alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") > 0)

    def counted(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, times) of the distinct words of each row."""
        h = b["h"].flatten().to_numpy()
        row = np.repeat(np.arange(b.num_rows), b["h"].value_lengths().to_numpy(zero_copy_only=False))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, np.int64)
        return row[at], h[at], np.diff(np.r_[at, len(h)])

    def seen(batches):
        total = np.zeros(buckets + 1, np.int64)  # the last one counts the texts
        for b in batches:
            row, h, _ = counted(b)
            hit = np.unique(row * buckets + (h & (buckets - 1)))
            total[:-1] += np.bincount(hit % buckets, minlength=buckets)
            total[-1] += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = rows.mapInArrow(seen, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most buckets + 1 rows
    holders = np.zeros(buckets + 1)
    holders[[r.bucket for r in found]] = [r.n for r in found]
    shared = df.sparkSession.sparkContext.broadcast(np.log1p(holders[-1] / np.maximum(holders[:-1], 1)).astype(np.float32))

    def features(batches):
        idf = shared.value
        for b in batches:
            row, h, times = counted(b)
            sign = np.where(h >> 62 & 1, 1.0, -1.0)
            place = (h >> 18) % dim
            x = np.bincount(row * dim + place, (1 + np.log(times)) * idf[h & (buckets - 1)] * sign, b.num_rows * dim)
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(np.arange(0, len(x) + 1, dim, dtype=np.int32), pa.array(x.astype(np.float32)))], names=["id", "vec"])

    return rows.mapInArrow(features, "id bigint, vec array<float>")


def similar_groups(df: DataFrame, record: str, vector: str, *, least: float, smallest: int, dim: int = 64, probes: int = 5, per_root: float = 0.5, exact: bool = False, tile_rows: int = 16_384, **fit) -> DataFrame:
    """(cluster_key, id): components of the links "cosine at least ``least``" with at least ``smallest`` ids.

    ``cluster_key`` is the smallest id of the component. Null ids and unusable vectors are left out; repeated rows of
    an id count once; copies of a vector are linked; an empty table gives no rows.

    Links are looked for in k-means cells, each vector being placed in its ``probes`` nearest ones; regions that are
    dense in proportion to the distance of a link are compared as a whole. A single link between two vectors that have
    no other similar ones may be missed (the README has measured shares); ``exact`` compares all pairs of buckets of
    ``tile_rows`` vectors instead, which misses none and costs the square of the rows.
    """
    vectors = usable_vectors(df, record, vector, dim)
    if exact:
        buckets = max(1, math.ceil(df.count() / tile_rows))
        cells = Cells("cosine", dim, 1, np.zeros((1, dim), np.float32), np.array([buckets], np.int32), np.zeros(dim, np.float32))
    else:
        cells = fit_cells(vectors, metric="cosine", dim=dim, probes=probes, per_root=per_root, reach=math.sqrt(2 - 2 * least), rows=df, tile_rows=tile_rows, **fit)
    stars = blocks(vectors, cells, ids_kept=1).groupBy("cell", "i", "j").applyInArrow(_local_groups(cells, least), EDGE)
    edges = stored(stars.where("id <> rep").distinct(), "links")
    groups = components(edges)
    big = groups.groupBy("cluster_key").agg(F.count("*").alias("n")).where(F.col("n") >= smallest).select("cluster_key")
    return groups.join(big, "cluster_key", "left_semi").select("cluster_key", "id")


def _local_groups(cells, least: float):
    def tile(table: pa.Table) -> pa.Table:
        if (left := copies(table)) is not None:
            return pa.table({"id": left[0], "rep": left[1]})
        t = Tile(table, cells)
        label = np.arange(len(t.x))
        for a, b, sure in t.survivors(least):
            apart = label[a] != label[b]
            a, b, sure = a[apart], b[apart], sure[apart]
            check = np.flatnonzero(~sure)
            keep = sure.copy()
            keep[check] = t.similarity(a[check], b[check]) >= least
            _union(label, a[keep], b[keep])
        # equal vectors are one point; its other ids are linked to its smallest
        key = np.full(len(t.x), np.iinfo(np.int64).max)
        np.minimum.at(key, label, t.ids[t.at[:-1]])
        point = np.repeat(np.arange(len(t.x)), np.diff(t.at))
        rep = key[label[point]]
        more = rep != t.ids
        return pa.table({"id": t.ids[more], "rep": rep[more]})

    return tile


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of each linked pair; label holds a representative point of every point."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(deeper := label[label], label):
            label[:] = deeper


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(id, cluster_key): connected components of the edges (id, rep), ids that occur in an edge only.

    Alternating star contraction: each round hangs the larger neighbours of a node on its smallest neighbour, then the
    smaller ones; the edges shrink to stars around the smallest ids in about log n rounds. Each round is written to
    the shared folder; a hub's neighbours are never gathered, only the minimum per node is, and joined back.
    """
    now, mark = edges.select(F.greatest("id", "rep").alias("u"), F.least("id", "rep").alias("v")).where("u <> v"), None
    held: DataFrame | None = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = stored(small.where("u <> v").distinct(), "stars")
        seen = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if held is not None:
            drop_stored(held)
        now, held = new, new
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError("components did not settle")
    centers = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("cluster_key")).unionByName(centers.select("id", F.col("id").alias("cluster_key")))


def typical_members(groups: DataFrame, df: DataFrame, record: str, vector: str, *, dim: int = 64, members: int = 3) -> DataFrame:
    """(cluster_key, size, rank_no, id, nearness): the members nearest the centroid (mean of unit vectors) of each group."""
    v = usable_vectors(df, record, vector, dim)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    v = v.join(groups, "id").groupBy("id", "cluster_key").agg(F.first("vec").alias("vec")).withColumn("norm", norm)
    mean = v.groupBy("cluster_key").agg(F.count("*").alias("size"), F.array(*(F.avg(F.col("vec")[i] / F.col("norm")) for i in range(dim))).alias("mean"))
    dot = F.aggregate(F.zip_with("vec", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    near = v.join(mean, "cluster_key").select("cluster_key", "size", "id", (dot / F.col("norm")).alias("nearness"))
    order = Window.partitionBy("cluster_key").orderBy(F.col("nearness").desc(), "id")
    return near.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= members)


def kmeans_groups(vectors: DataFrame, *, k: int, metric: str = "cosine", dim: int = 64, members: int = 3, **fit) -> DataFrame:
    """(cluster_key, size, rank_no, id, distance): k-means clusters of (id, vec), each with its size and the members
    nearest its centroid (smaller ids first among equally near ones).

    Centroids are fitted on all rows, and every row is assigned to its nearest one; distances are those of unit vectors
    for cosine. Null ids and unusable vectors are left out, a repeated id counts once, with one of its
    vectors; fewer distinct vectors than ``k`` give fewer clusters, an empty table gives none.
    """
    rows = stored(usable_vectors(vectors, "id", "vec", dim).groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    cells = fit_cells(rows, metric=metric, dim=dim, probes=1, cells=k, fit_rows=None, **fit)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                w = cells.place(matrix(b, dim))
                home = cells.nearest(w, 1)[:, 0]
                far = np.sqrt(((w.astype(np.float64) - cells.centers[home]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(home.astype(np.int64)), pa.array(far)], names=["id", "cluster_key", "distance"])

    near = stored(rows.mapInArrow(assign, "id bigint, cluster_key bigint, distance double"), "assigned")
    sizes = near.groupBy("cluster_key").agg(F.count("*").alias("size"))
    order = Window.partitionBy("cluster_key").orderBy("distance", "id")
    best = near.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= members)  # thinned per task before the shuffle
    return best.join(sizes, "cluster_key").select("cluster_key", "size", "rank_no", "id", "distance")


def union_find(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Components of a small list of links, for tests: node -> smallest node."""
    nodes = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    label = np.arange(len(nodes))
    if pairs:
        a, b = pd.DataFrame(pairs).map(at.get).to_numpy().T
        _union(label, a, b)
    return {x: nodes[label[i]] for x, i in at.items()}
