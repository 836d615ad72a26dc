"""Most similar vectors of every vector: block matrix join over cells.

Vectors are placed in the cells nearest to them (see :mod:`tarnfield.llm.cells`), each cell is a tile whose int8
product matrix bounds every similarity from both sides, the pairs that can reach the closeness asked for are
recomputed in double precision, and each vector keeps a heap of its k best per tile; heaps are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.cells import Tile, blocks, collapse, copies, fit_cells, matrix, unit, usable_vectors
from tarnfield.session import stored

PAIR = "id_a bigint, id_b bigint, sim double"


def close_neighbours(df: DataFrame, record: str, vector: str, *, k: int, bound: float | None, metric: str = "cosine", dim: int = 64, probes: int = 3, per_root: float = 1.0, **fit) -> DataFrame:
    """(id_a, id_b, sim, rank_no): up to ``k`` most similar other records of every record among the close ones.

    Close: cosine at least ``bound``, or (metric 'l2') squared distance at most ``bound``; sim is the cosine or minus
    the squared distance; without a bound (null) all records count, near or far, which takes more ``probes``. Equal
    similarity: smaller id first. A record without close neighbours gives no row.

    Rows with a null id or an unusable vector are left out; repeated rows of an id count once, and an id with several
    different vectors is as near as its nearest one. Copies of a vector are neighbours of each other. An empty
    table gives no rows. The result loses pairs only where two vectors share none of their ``probes`` cells; the
    README has the measured recall.
    """
    vectors = usable_vectors(df, record, vector, dim)
    # the distance of the farthest close pair; without a bound there is none, and cells stay as they are
    reach = 0.0 if bound is None else float(np.sqrt(2 - 2 * bound if metric == "cosine" else bound))
    bound = (-2.0 if metric == "cosine" else float("inf")) if bound is None else bound
    cells = fit_cells(vectors, metric=metric, dim=dim, probes=probes, per_root=per_root, reach=reach, rows=df, **fit)

    def tile(table: pa.Table) -> pa.Table:
        if (left := copies(table)) is not None:
            return pa.table({"id_a": left[0], "id_b": left[1], "sim": pa.nulls(len(left[0]), pa.float64())})
        t = Tile(table, cells)
        src, dst, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        least = bound if metric == "cosine" else -bound

        def heap() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((t.ids[t.at[dst]], -sim, src))
            s = src[order]
            rank = np.arange(len(s)) - np.searchsorted(s, s)
            best = order[rank < k]
            return src[best], dst[best], sim[best]

        for a, b, both in t.best(bound, k):
            own = t.owned(a, b)
            a, b = a[own], b[own]
            v = t.similarity(a, b)
            ok = v >= least
            a, b, v = a[ok], b[ok], v[ok]
            src, dst, sim = (np.r_[src, a, b], np.r_[dst, b, a], np.r_[sim, v, v]) if both else (np.r_[src, a], np.r_[dst, b], np.r_[sim, v])
            if len(src) > 2_000_000:
                src, dst, sim = heap()
        src, dst, sim = heap()
        out_a, out_b, out_s = [], [], []
        size = np.diff(t.at)
        single = (size[src] == 1) & (size[dst] == 1)
        out_a.append(t.ids[t.at[src[single]]])
        out_b.append(t.ids[t.at[dst[single]]])
        out_s.append(sim[single])
        for p, q, v in zip(src[~single], dst[~single], sim[~single]):
            a, b = t.ids[t.at[p] : t.at[p + 1]], t.ids[t.at[q] : t.at[q + 1]][: k + 1]
            out_a.append(np.repeat(a, len(b)))
            out_b.append(np.tile(b, len(a)))
            out_s.append(np.full(len(a) * len(b), v))
        if t.i == t.j:  # copies, once: in the first of their cells
            for p in np.flatnonzero((size > 1) & (t.near[:, 0] == t.cell)):
                a, b = t.ids[t.at[p] : t.at[p + 1]], t.ids[t.at[p] : t.at[p + 1]][: k + 1]
                out_a.append(np.repeat(a, len(b)))
                out_b.append(np.tile(b, len(a)))
                out_s.append(np.repeat(t.similarity(np.array([p]), np.array([p])), len(a) * len(b)))
        a, b, v = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_s)
        ok = a != b
        return pa.table({"id_a": a[ok], "id_b": b[ok], "sim": v[ok]})

    found = blocks(vectors, cells, ids_kept=k + 1).groupBy("cell", "i", "j").applyInArrow(tile, PAIR)
    found = stored(found.groupBy("id_a", "id_b").agg(F.max("sim").alias("sim")), "neighbours")
    best = _heaps(found.where("sim IS NOT NULL"), k)
    # ids past the k + 1 smallest copies of a task chunk: their nearest are the k smallest copies
    more = found.where("sim IS NULL").select(F.col("id_a").alias("id"), F.col("id_b").alias("rep"))
    lists = more.join(best.select(F.col("id_a").alias("rep"), "id_b", "sim"), "rep")
    tail = lists.select(F.col("id").alias("id_a"), "id_b", "sim").unionByName(lists.groupBy("id", "rep").agg(F.max("sim").alias("sim")).select(F.col("id").alias("id_a"), F.col("rep").alias("id_b"), "sim"))
    return best.unionByName(_heaps(tail.where("id_a <> id_b").dropDuplicates(["id_a", "id_b"]), k))


def _heaps(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id_a").orderBy(F.col("sim").desc(), F.col("id_b"))
    return pairs.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k)


def search(df: DataFrame, record: str, vector: str, queries: DataFrame, *, k: int, metric: str = "cosine", dim: int = 64, block_rows: int = 4096) -> DataFrame:
    """(id_a, id_b, sim, rank_no): the exact ``k`` most similar other records of each query (id, vec), near or far.

    The queries are a stated set and are compared with all rows in blocks: block q of the queries meets every batch of
    rows, int8 bounds leave the pairs that can enter a heap, those are recomputed in double precision. Queries are
    taken to the tasks ``block_rows`` at a time (bounded: block_rows * dim numbers), one pass over the rows each.
    """
    rows = usable_vectors(df, record, vector, dim)
    asked = usable_vectors(queries, "id", "vec", dim).dropDuplicates(["id"])
    n = asked.count()
    number = max(1, -(-n // block_rows))
    result = None
    for q in range(number):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(number)) == q).collect()  # one block of the stated queries
        if not part:
            continue
        ids = np.array([r.id for r in part], np.int64)
        x = np.array([r.vec for r in part], np.float32)
        found = rows.mapInArrow(_scan(ids, x, k, metric, dim), PAIR)
        best = _heaps(found.groupBy("id_a", "id_b").agg(F.max("sim").alias("sim")), k)
        best = stored(best, "search") if number > 1 else best  # a pass of its own, so that many blocks make no huge plan
        result = best if result is None else result.unionByName(best)
    return result if result is not None else df.sparkSession.createDataFrame([], PAIR + ", rank_no int")


def _scan(qids: np.ndarray, qx: np.ndarray, k: int, metric: str, dim: int, queries_at_once: int = 256):
    def prepare(x: np.ndarray) -> np.ndarray:
        return unit(x) if metric == "cosine" else x.astype(np.float64)

    def coded(w: np.ndarray) -> tuple[np.ndarray, float, float, float]:
        step = max(float(np.abs(w).max()), 1e-30) / 127
        code = np.rint(w / step)
        return code.astype(np.float32), step, float(np.sqrt(((w - code * step) ** 2).sum(axis=1).max())), float(np.sqrt((w**2).sum(axis=1).max()))

    def run(batches):
        q = prepare(qx)
        qc, qs, qe, qn = coded(q)
        qh = 0.5 * (q**2).sum(axis=1) if metric == "l2" else np.zeros(len(q))
        heap_id, heap_sim = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b, dim)
            rep, ids, at = collapse(x, b["id"].to_numpy())  # a row per (vector, id): repeats take no place of others
            per = np.diff(at)
            w = np.repeat(prepare(x[rep]), per, axis=0)
            most = int(np.unique(ids, return_counts=True)[1].max())  # rows that an id or the query itself may have with different vectors
            c, s, e, n = coded(w)
            slack = qn * e + n * qe + e * qe
            h = 0.5 * (w**2).sum(axis=1) if metric == "l2" else np.zeros(len(w))
            for first in range(0, len(q), queries_at_once):  # so many products are held at a time
                mine = slice(first, first + queries_at_once)
                own_id, own_sim, own = heap_id[mine], heap_sim[mine], len(heap_id[mine])
                # what a pair needs to enter the heap of its query, in units of the product
                worst = own_sim[:, -1] if metric == "cosine" else own_sim[:, -1] / 2 + qh[mine]
                need = (worst - slack - 1e-6 * (qn * n)) / (qs * s)
                product = qc[mine] @ c.T - (h / (qs * s)).astype(np.float32)
                # an empty heap would let everything pass: k ids and the query itself, each with as many different vectors
                # as any id has in the batch, are enough to find what can be among the k best
                places = (k + 1) * most
                if len(c) > places and not np.isfinite(worst).all():
                    kth = np.partition(product, -places, axis=1)[:, -places]
                    need = np.maximum(need, kth - (2 * slack + 1e-5 * qn * n) / (qs * s))
                hit = np.flatnonzero(product >= need[:, None].astype(np.float32))
                i, j = hit // len(c), hit % len(c)
                keep = qids[mine][i] != ids[j]
                i, j = i[keep], j[keep]
                sim = np.empty(len(i))
                for t in range(0, len(i), 65_536):
                    a, d = q[mine][i[t : t + 65_536]], w[j[t : t + 65_536]]
                    sim[t : t + 65_536] = np.einsum("ij,ij->i", a, d) if metric == "cosine" else -np.einsum("ij,ij->i", a - d, a - d)
                full = own_id >= 0
                qa = np.r_[np.nonzero(full)[0], i]
                ia, sa = np.r_[own_id[full], ids[j]], np.r_[own_sim[full], sim]
                order = np.lexsort((ia, -sa, qa))
                qa, ia, sa = qa[order], ia[order], sa[order]
                fresh = np.r_[True, (qa[1:] != qa[:-1]) | (ia[1:] != ia[:-1])] if len(qa) else np.empty(0, bool)  # repeated rows are equal, so adjacent
                qa, ia, sa = qa[fresh], ia[fresh], sa[fresh]
                rank = np.arange(len(qa)) - np.searchsorted(qa, qa)
                top = rank < k
                own_id[:], own_sim[:] = -1, -np.inf
                own_id[qa[top], rank[top]], own_sim[qa[top], rank[top]] = ia[top], sa[top]
        full = heap_id >= 0
        yield pa.RecordBatch.from_arrays([pa.array(qids[np.nonzero(full)[0]]), pa.array(heap_id[full]), pa.array(heap_sim[full])], names=["id_a", "id_b", "sim"])

    return run
