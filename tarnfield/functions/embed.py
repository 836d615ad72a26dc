"""Text embeddings: TF-IDF over words and word pairs, reduced by a truncated decomposition, scaled to length 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.session import stored


def text_embeddings(df: DataFrame, record: str, text: str, *, dim: int = 128, vocabulary: int = 8192, min_df: float = 5, max_df: float = 0.8, passes: int = 4, seed: int = 17) -> DataFrame:
    """(id, embedding): one vector per record with text. Terms in fewer than ``min_df`` records or more than a share
    ``max_df`` of them (numbers of 1 and more are counts) are left out; of the rest the ``vocabulary`` most frequent ones
    are kept, which bounds the basis that is held.

    The decomposition is a truncated one by power iteration from a seeded random start: in each pass every task adds
    up its share of A'(A Q) over its rows (A the TF-IDF rows, Q a basis of ``vocabulary`` x ``dim``), the shares are
    merged by blocks of terms, and the driver orthonormalises the basis. Fewer usable terms than ``dim`` leave the rest
    of the vector 0; a text without usable terms has an all-zero vector.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(record).alias("id"), F.col(text).alias("text"))
    for step in (RegexTokenizer(inputCol="text", outputCol="raw", pattern=r"(?U)\W+"), StopWordsRemover(inputCol="raw", outputCol="words"), NGram(n=2, inputCol="words", outputCol="pairs")):
        rows = step.transform(rows)
    counts = rows.select("id", F.explode(F.concat("words", "pairs")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    counts = stored(counts, "term-counts")
    records = df.where(F.col(text).isNotNull()).count()
    known = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    least, most = (x if x >= 1 else x * records for x in (min_df, max_df))
    known = known.where((F.col("df") >= least) & (F.col("df") <= most)).orderBy(F.col("n").desc(), "term").limit(vocabulary)
    # at most `vocabulary` rows, so one task numbers them and they are broadcast
    known = stored(known.select("term", (F.row_number().over(Window.orderBy(F.col("n").desc(), "term")) - 1).alias("at"), F.log((F.lit(records) + 1) / (F.col("df") + 1)).alias("idf")), "vocabulary")
    terms = known.count()
    weighted = counts.join(F.broadcast(known), "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("tf") * F.col("idf")).alias("w")))).alias("v"))
    # texts without usable terms keep an empty list
    sparse = stored(rows.select("id").join(weighted, "id", "left").select("id", F.coalesce(F.col("v.at"), F.expr("array()")).cast("array<int>").alias("at"), F.coalesce(F.col("v.w"), F.expr("array()")).cast("array<double>").alias("w")), "tfidf")
    basis = _basis(sparse, terms, min(dim, terms), passes, seed)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, dim), np.float64)
            if basis.shape[1]:
                x[:, : basis.shape[1]] = _times(b, basis)
            n = np.sqrt((x**2).sum(axis=1, keepdims=True))
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), pa.array(x.ravel()))], names=["id", "embedding"])

    return sparse.mapInArrow(project, f"id {dict(sparse.dtypes)['id']}, embedding array<float>")


def _times(b: pa.RecordBatch, basis: np.ndarray) -> np.ndarray:
    """A Q for the rows of a batch."""
    at, w = b["at"], b["w"].flatten().to_numpy()
    size = np.diff(at.offsets.to_numpy())
    out = np.zeros((b.num_rows, basis.shape[1]))
    some = np.flatnonzero(size)
    if len(some):
        ends = np.r_[0, np.cumsum(size[some])[:-1]]
        for s in range(0, basis.shape[1], 16):  # a few columns at a time: the gathered rows stay small
            out[some, s : s + 16] = np.add.reduceat(basis[at.flatten().to_numpy()][:, s : s + 16] * w[:, None], ends, axis=0)
    return out


def _basis(sparse: DataFrame, terms: int, dim: int, passes: int, seed: int, *, block: int = 512) -> np.ndarray:
    """An orthonormal basis (terms x dim) of the leading right singular vectors, the strongest first."""
    if not dim:
        return np.zeros((terms, 0))
    schema = "block int, x binary"

    def product(basis: np.ndarray):
        width = basis.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((terms, width))
            for b in batches:
                if b.num_rows:
                    y = _times(b, basis)
                    at, w = b["at"].flatten().to_numpy(), b["w"].flatten().to_numpy()
                    row = np.repeat(np.arange(b.num_rows), np.diff(b["at"].offsets.to_numpy()))
                    order = np.argsort(at, kind="stable")
                    if len(order):
                        first = np.flatnonzero(np.diff(at[order], prepend=-1))
                        for s in range(0, width, 16):
                            out[at[order][first], s : s + 16] += np.add.reduceat(y[row[order], s : s + 16] * w[order, None], first, axis=0)
            parts = [(s // block, out[s : s + block].tobytes()) for s in range(0, terms, block)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["block", "x"])

        def merge(t: pa.Table) -> pa.Table:
            return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "x": pa.array([sum(np.frombuffer(x) for x in t["x"].to_pylist()).tobytes()], pa.binary())})

        found = np.zeros((terms, width))
        for r in sparse.mapInArrow(run, schema).groupBy("block").applyInArrow(merge, schema).collect():  # terms x dim numbers in all
            found[r.block * block : (r.block + 1) * block] = np.frombuffer(bytes(r.x)).reshape(-1, width)
        return found

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, min(terms, dim + 8))))[0]
    for _ in range(max(1, passes)):
        z = product(q)
        small = q.T @ z  # of A'A in the basis: its vectors turn the basis towards the singular ones
        q = np.linalg.qr(z)[0] if _ < passes - 1 else q @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
    return q[:, :dim]
