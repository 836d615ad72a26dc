"""Vector expressions. Sums run left to right in double precision, so results do not depend on the partitioning."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance; null if either vector is null or holds a null."""
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    return F.sqrt(l2_squared(a, b))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null for an all-zero vector."""
    return F.nullif(dot(a, b), F.lit(None).cast("double")) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalized(a: Column | str) -> Column:
    """The vector scaled to length 1; an all-zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, _d(a)).otherwise(F.transform(_d(a), lambda x: x / n))


def is_valid(a: Column | str) -> Column:
    """Whether a vector can be a candidate: its length is above 0 (null counts as invalid)."""
    return F.coalesce(norm(a) > 0, F.lit(False))


def literal(vector: Sequence[float]) -> Column:
    """A vector constant (folded once; works for negative elements too)."""
    return F.array(*(F.lit(float(x)) for x in vector))


def parse_vector(text: Column | str) -> Column:
    """Vector from its text form ``[x,y,...]``."""
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.cast("float"))


def vector_text(a: Column | str) -> Column:
    """Text form ``[x,y,...]`` of a vector."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def batch_topk(candidates: DataFrame, query_ids: Sequence[int], queries: np.ndarray, k: int, *, id_column: str = "id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, id, distance_sq): per query and Arrow batch the k nearest candidates, for a final ranking.

    The norm expansion on a matrix product only selects; distances that leave are direct double-precision
    differences, and the selection keeps a margin for its rounding. ``queries`` are a stated, bounded set.
    """
    return batch_topk_by(candidates, {"": F.lit(True)}, query_ids, queries, k, id_column=id_column, vector=vector, exclude_self=exclude_self).drop("filter_name")


def batch_topk_by(candidates: DataFrame, filters: Mapping[str, Column], query_ids: Sequence[int], queries: np.ndarray, k: int, *, id_column: str = "id", vector: str = "embedding", exclude_self: bool = True, queries_at_once: int = 256) -> DataFrame:
    """(filter_name, query_id, id, distance_sq): the same for each of several filters over the candidates.

    A row's distances are computed once, however many filters it satisfies: the filters travel as the bits of one
    number per row, and each of them picks its k best from the same matrix. A null filter is not satisfied.
    """
    ids, q, names = np.asarray(query_ids, np.int64), np.asarray(queries, np.float64), list(filters)
    words = [names[s : s + 62] for s in range(0, len(names), 62)]
    bits = [sum((F.when(filters[n], F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, n in enumerate(word)), F.lit(0).cast("bigint")) for word in words]
    rows = candidates.select(F.col(id_column).alias("id"), F.col(vector).alias("vec"), *(b.alias(f"bits{i}") for i, b in enumerate(bits)))
    rows = rows.where(F.greatest(*(F.col(f"bits{i}") for i in range(len(words))), F.lit(0)) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qn = (q**2).sum(axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            cid = b["id"].to_numpy(zero_copy_only=False).astype(np.int64)
            x = b["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            xn, flags = (x**2).sum(axis=1), [b[f"bits{i}"].to_numpy() for i in range(len(words))]
            for s in range(0, len(ids), queries_at_once):
                part = slice(s, s + queries_at_once)
                near = qn[part, None] + xn[None] - 2 * q[part] @ x.T
                if exclude_self:
                    near[ids[part, None] == cid[None]] = np.inf
                for n, name in enumerate(names):
                    mine = np.flatnonzero(flags[n // 62] >> (n % 62) & 1)
                    if not len(mine):
                        continue
                    own = near[:, mine] if len(mine) < len(cid) else near
                    m = min(k, len(mine))
                    kth = np.partition(own, m - 1, axis=1)[:, m - 1 : m]
                    i, j = np.nonzero((own <= kth + 1e-9 * (1 + np.abs(kth))) & np.isfinite(own))
                    j = mine[j]
                    d = ((q[part][i] - x[j]) ** 2).cumsum(axis=1)[:, -1]  # left to right, as the expression does
                    order = np.lexsort((cid[j], d, i))
                    i, j, d = i[order], j[order], d[order]
                    top = np.arange(len(i)) - np.searchsorted(i, i) < k
                    yield pa.RecordBatch.from_arrays([pa.array([name] * int(top.sum()), pa.string()), pa.array(ids[part][i[top]]), pa.array(cid[j[top]]), pa.array(d[top])], names=["filter_name", "query_id", "id", "distance_sq"])

    return rows.mapInArrow(run, "filter_name string, query_id bigint, id bigint, distance_sq double")
