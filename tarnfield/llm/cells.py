"""Coarse cells over vectors: usable rows, distributed k-means, and blocks of vectors per cell.

Cells that only say which pairs are compared are fitted on a bounded sample (``fit_rows``), cells that are the result
on all rows; every row is assigned. Each vector goes to its ``probes`` nearest cells, and a pair of vectors is compared
in the cells they share. Whatever is then said about a pair is computed
from the original numbers in double precision.

Skew: identical vectors are collapsed inside each task before anything is shuffled, so a group of copies costs one
vector per task; cells of a region that is dense in proportion to the distance of a pair are united; and a cell above
``tile_rows`` is cut into buckets, all pairs of which are tasks of their own, so that nothing within it is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.session import drop_stored, stored

ROW = "id bigint, vec array<float>"


def usable_vectors(df: DataFrame, record: str, vector: str, dim: int) -> DataFrame:
    """(id, vec) of the rows whose vector is not null, has ``dim`` finite elements and is not all zero."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    some = F.exists(v, lambda x: x != 0)
    return df.where(F.col(f"`{record}`").isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(finite & some).select(F.col(f"`{record}`").cast("bigint").alias("id"), v.cast("array<float>").alias("vec"))


def matrix(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    """The vectors of an Arrow batch as one float32 matrix."""
    col = batch["vec"]
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@dataclass
class Cells:
    """Fitted cells: centroids (k x dim), the number of buckets of each cell, and the origin subtracted from vectors."""

    metric: str
    dim: int
    probes: int
    centers: np.ndarray
    buckets: np.ndarray
    origin: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """What distances between cells are measured on: unit vectors for cosine, centred ones for l2 (float32)."""
        return unit(x).astype(np.float32) if self.metric == "cosine" else x - self.origin

    def nearest(self, w: np.ndarray, m: int) -> np.ndarray:
        """Indices of the m nearest cells of each row, nearest first."""
        m, half, out = min(m, len(self.centers)), 0.5 * np.einsum("ij,ij->i", self.centers, self.centers), []
        for s in range(0, len(w), 4096):
            score = w[s : s + 4096] @ self.centers.T
            score -= half
            top = np.argpartition(score, -m, axis=1)[:, -m:]
            order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
            out.append(np.take_along_axis(top, order, 1))
        return np.concatenate(out).astype(np.int32) if out else np.empty((0, m), np.int32)


def fit_cells(vectors: DataFrame, *, metric: str, dim: int, probes: int, per_root: float = 2.0, fit_rows: int | None = 65_536, rounds: int = 4, steps: int = 2, tile_rows: int = 8192, reach: float = 0.0, seed: int = 17, rows: DataFrame | None = None, cells: int | None = None) -> Cells:
    """Distributed k-means with parallel oversampled seeding on a sample of about ``fit_rows`` rows, or on all rows
    where that is None (``vectors``, which every pass then reads, should be stored).

    The number of cells is ``cells``, or ``per_root`` times the square root of the rows, so that the work per row grows
    with the root of the table. Each seeding round draws k/2 rows in one pass, with probability proportional to the
    squared distance to the seeds so far (exponential keys, the smallest ones win); the weighted seeds are reduced to k
    and moved by ``steps`` passes of Lloyd's algorithm. Sums are formed in the tasks and merged by blocks of cells; the
    driver sees a few times k rows.

    ``reach`` is the distance of the farthest pair that is looked for. Where vectors lie so close together that cells
    would part such pairs (see :func:`_united`), the cells are united, so that no pair of a dense region is lost.
    """
    n = (rows if rows is not None else vectors).count()  # of the unfiltered table where given: its files know it
    k = max(1, cells or math.ceil(per_root * math.sqrt(n)))
    share, sample = 1.0, vectors
    if fit_rows is not None:
        share = min(1.0, max(fit_rows, 32 * k) / max(n, 1))  # at least 32 rows a cell: with the root of the table, no more
        keep = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
        sample = stored(vectors.where(keep).repartition(max(8, k // 256)), "cell-sample")
    origin = np.zeros(dim, np.float32)
    if metric == "l2":
        mean = sample.select(*(F.avg(F.col("vec")[i]).alias(f"m{i}") for i in range(dim))).first()
        origin = np.array([x or 0.0 for x in mean], np.float32)
    found = Cells(metric, dim, probes, np.zeros((1, dim), np.float32), np.ones(1, np.int32), origin)
    want = max(1, k // 2)

    def draw(cells: Cells, rnd: int, want: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, rows = np.empty(0), np.empty((0, dim), np.float32)
            for b in batches:
                if not b.num_rows:
                    continue
                w = cells.place(matrix(b, dim))
                key = -np.log(hash_unit(b["id"].to_numpy(), seed, rnd)) / np.maximum(_least(w, cells.centers), 1e-12)
                keys, rows = np.r_[keys, key], np.r_[rows, w]
                best = np.argsort(keys, kind="stable")[:want]
                keys, rows = keys[best], rows[best]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.float64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "w"])

        rows = sample.mapInArrow(run, "key double, w binary").orderBy("key").limit(want).collect()
        return np.frombuffer(b"".join(bytes(r.w) for r in rows), np.float32).reshape(-1, dim)

    seeds = draw(found, 0, 1)
    if not len(seeds):
        if sample is not vectors:
            drop_stored(sample)
        return found
    for r in range(1, rounds + 1):
        found.centers = seeds
        seeds = np.unique(np.r_[seeds, draw(found, r, want)], axis=0)
    found.centers = seeds
    found.centers = _reduce_seeds(seeds, _members(sample, found)[0], k, seed)
    for _ in range(steps):
        counts, sums, squares = _members(sample, found)
        moved = counts > 0
        found.centers = found.centers.copy()
        found.centers[moved] = (sums[moved] / counts[moved, None]).astype(np.float32)
    if reach and steps:
        spread = np.sqrt(np.maximum(squares - (sums**2).sum(axis=1) / np.maximum(counts, 1), 0) / np.maximum(counts - 1, 1))
        found.centers = _united(found.centers, counts, spread, reach)
    counts, _, _ = _members(sample, found)
    if sample is not vectors:
        drop_stored(sample)
    # what is too heavy is cut into buckets (each vector is placed `probes` times)
    found.buckets = np.maximum(1, np.ceil(counts / max(share, 1e-12) * probes / tile_rows)).astype(np.int32)
    return found


def _members(sample: DataFrame, cells: Cells, *, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, vector sums and sums of squared lengths of each cell: partial sums of the tasks are merged by blocks of
    cells, and each block reaches the driver once."""
    size, dim = len(cells.centers), cells.dim
    schema = "block int, c binary, s binary, q binary"

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 3])] if rows else [pa.array([], t) for t in [pa.int32(), *[pa.binary()] * 3]], names=["block", "c", "s", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, squares = np.zeros(size), np.zeros((size, dim)), np.zeros(size)
        for b in batches:
            if b.num_rows:
                w = cells.place(matrix(b, dim))
                home = cells.nearest(w, 1)[:, 0]
                order = np.argsort(home, kind="stable")
                at = np.flatnonzero(np.diff(home[order], prepend=-1))
                counts[home[order][at]] += np.diff(np.r_[at, len(home)])
                w = w[order].astype(np.float64)
                sums[home[order][at]] += np.add.reduceat(w, at, axis=0)
                squares[home[order][at]] += np.add.reduceat((w * w).sum(axis=1), at)
        yield table([(s // block, counts[s : s + block].tobytes(), sums[s : s + block].tobytes(), squares[s : s + block].tobytes()) for s in range(0, size, block) if counts[s : s + block].any()])

    def merge(t: pa.Table) -> pa.Table:
        total = [sum(np.frombuffer(x) for x in t[c].to_pylist()) for c in ("c", "s", "q")]
        return pa.Table.from_batches([table([(t["block"][0].as_py(), *(x.tobytes() for x in total))])])

    counts, sums, squares = np.zeros(size), np.zeros((size, dim)), np.zeros(size)
    for r in sample.mapInArrow(run, schema).groupBy("block").applyInArrow(merge, schema).collect():
        part = slice(r.block * block, (r.block + 1) * block)
        counts[part], sums[part], squares[part] = np.frombuffer(r.c), np.frombuffer(r.s).reshape(-1, dim), np.frombuffer(r.q)
    return counts, sums, squares


def hash_unit(ids: np.ndarray, seed: int, rnd: int) -> np.ndarray:
    """A fixed number in (0, 1) for each row, so that reruns of a task draw the same rows."""
    start = (seed * 0xC2B2AE3D27D4EB4F + rnd * 0x165667B19E3779F9) & (1 << 64) - 1
    x = np.asarray(ids, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


def _least(w: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the nearest centre."""
    half = 0.5 * np.einsum("ij,ij->i", centers, centers)
    best = np.concatenate([(w[s : s + 4096] @ centers.T - half).max(axis=1) for s in range(0, len(w), 4096)])
    return np.maximum(np.einsum("ij,ij->i", w, w) - 2 * best, 0)


def _reduce_seeds(seeds: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over the oversampled seeds (a few times k rows), then three Lloyd steps over them."""
    if len(seeds) <= k:
        return seeds
    rng = np.random.default_rng(seed)
    norm = np.einsum("ij,ij->i", seeds, seeds)
    chosen = [int(rng.choice(len(seeds), p=weights / weights.sum()))]
    far = norm + norm[chosen[0]] - 2 * seeds @ seeds[chosen[0]]
    for _ in range(k - 1):
        p = weights * np.maximum(far, 0)
        if p.sum() <= 0:
            break
        c = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))
        chosen.append(min(c, len(seeds) - 1))
        np.minimum(far, norm + norm[chosen[-1]] - 2 * seeds @ seeds[chosen[-1]], out=far)
    centers = seeds[chosen].copy()
    for _ in range(3):
        half = 0.5 * np.einsum("ij,ij->i", centers, centers)
        home = np.concatenate([np.argmax(seeds[s : s + 2048] @ centers.T - half, axis=1) for s in range(0, len(seeds), 2048)])
        total = np.bincount(home, weights, len(centers))
        for d in range(seeds.shape[1]):
            s = np.bincount(home, weights * seeds[:, d], len(centers))
            centers[total > 0, d] = s[total > 0] / total[total > 0]
    return centers


def _united(centers: np.ndarray, counts: np.ndarray, spread: np.ndarray, reach: float, *, ratio: float = 1.4, least: int = 8) -> np.ndarray:
    """Centroids with one weighted mean for each dense region.

    How often the two vectors of a pair share a cell depends on their distance in proportion to the spread of the cell
    (root mean square distance from its centroid). A cell is dense where its spread is at most ``ratio`` times the
    distance of a pair; dense cells within ``reach`` of each other are one region, and so are cells of any kind within
    ``reach`` of one of them (over dense cells only, so that the others form no chain). A region is then compared as a
    whole, in bucket pairs.
    """
    dense = np.flatnonzero((spread <= ratio * reach) & (counts >= least))
    if not len(dense):
        return centers
    label = np.arange(len(centers))
    norm = np.einsum("ij,ij->i", centers, centers)
    # nearest dense label of every cell within reach, until nothing changes
    while True:
        before = label.copy()
        for s in range(0, len(dense), 512):
            part = dense[s : s + 512]
            near = norm[part, None] + norm[dense] - 2 * centers[part] @ centers[dense].T <= reach * reach
            low = np.where(near, label[dense], len(centers)).min(axis=1)
            np.minimum.at(label, label[part], low)
            label[part] = np.minimum(label[part], low)
        while not np.array_equal(deeper := label[label], label):
            label = deeper
        if np.array_equal(before, label):
            break
    rest = np.setdiff1d(np.arange(len(centers)), dense)
    for s in range(0, len(rest), 512):
        part = rest[s : s + 512]
        apart = norm[part, None] + norm[dense] - 2 * centers[part] @ centers[dense].T
        close = apart.min(axis=1) <= reach * reach
        label[part[close]] = label[dense[apart[close].argmin(axis=1)]]
    groups, at = np.unique(label, return_inverse=True)
    weight = np.maximum(counts, 1e-9)
    total = np.bincount(at, weight)
    return np.stack([np.bincount(at, weight * centers[:, d]) / total for d in range(centers.shape[1])], axis=1).astype(np.float32)


# ---------------------------------------------------------------- blocks

BLOCK = "cell int, i int, j int, bucket int, n int, ids binary, per binary, vecs binary, cells binary"


_PRESS: list = []  # one compressor and decompressor per process


def _press() -> list:
    if not _PRESS:
        _PRESS.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _PRESS


def pack(x: np.ndarray) -> bytes:
    """Lossless: the bytes of equal significance together, then zstd."""
    return _press()[0].compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1, x.dtype.itemsize).transpose(2, 1, 0).tobytes())


def unpack(data: bytes, n: int, dtype, width: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(_press()[1].decompress(data, max_output_size=n * width * size), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, width, n).transpose(2, 1, 0)).view(dtype).reshape(n, width)


def collapse(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors: index of a representative row, the ids sorted by (vector, id) without repeats, offsets."""
    if not len(x):
        return np.empty(0, np.int64), ids, np.zeros(1, np.int64)
    rows = np.ascontiguousarray(x + np.float32(0)).view(np.dtype((np.void, x.shape[1] * 4))).ravel()  # -0 becomes 0
    _, rep, inverse = np.unique(rows, return_index=True, return_inverse=True)
    order = np.lexsort((ids, inverse))
    inv, sorted_ids = inverse[order], ids[order]
    fresh = np.r_[True, (inv[1:] != inv[:-1]) | (sorted_ids[1:] != sorted_ids[:-1])]
    return rep, sorted_ids[fresh], np.searchsorted(inv[fresh], np.arange(len(rep) + 1))


def vector_bucket(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A bucket below n for each vector, the same for equal vectors."""
    mixed = (np.ascontiguousarray(x + np.float32(0)).view(np.uint32).astype(np.uint64) * (np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(axis=1, dtype=np.uint64)
    return ((mixed >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int32)


def blocks(vectors: DataFrame, cells: Cells, *, ids_kept: int, rows_at_once: int = 65_536) -> DataFrame:
    """One row per task chunk, cell and pair of buckets: the distinct vectors placed there, packed.

    Of a group of copies in a chunk the ``ids_kept`` smallest ids travel with the vector; rows of cell -1 hold the
    others, each with the smallest id of its group (see :func:`copies`).
    """
    dim, m = cells.dim, min(cells.probes, len(cells.centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for x, ids in _chunks(batches, dim, rows_at_once):
            rep, flat, at = collapse(x, ids)
            x = x[rep]
            per = np.minimum(np.diff(at), ids_kept)
            near = np.sort(cells.nearest(cells.place(x), m), axis=1)
            bucket = vector_bucket(x, np.full(len(x), 1 << 30, np.int64))
            rank = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
            if (more := rank >= ids_kept).any():
                rep_id = np.repeat(flat[at[:-1]], np.diff(at))
                yield _batch([(-1, part, 0, 0, int(more.sum()), flat[more].tobytes(), rep_id[more].tobytes(), b"", b"")])
            point, cell = np.repeat(np.arange(len(x)), m), near.ravel()
            b = bucket[point] % cells.buckets[cell]
            order = np.lexsort((point, b, cell))
            point, cell, b = point[order], cell[order], b[order]
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (b[1:] != b[:-1])])
            out: list[tuple] = []
            for s, e in zip(cuts, np.r_[cuts[1:], len(cell)]):
                p = point[s:e]
                own = np.concatenate([flat[at[q] : at[q] + per[q]] for q in p]) if per[p].max() > 1 else flat[at[p]]
                data = (len(p), pack(own[:, None]), pack(per[p].astype(np.int32)[:, None]), pack(x[p]), pack(near[p]))
                for t in range(cells.buckets[cell[s]]):
                    out.append((int(cell[s]), min(t, int(b[s])), max(t, int(b[s])), int(b[s]), *data))
                if len(out) >= 512:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return vectors.mapInArrow(run, BLOCK)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 5 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=["cell", "i", "j", "bucket", "n", "ids", "per", "vecs", "cells"])


def _chunks(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    xs, ids, n = [], [], 0
    for b in batches:
        if b.num_rows:
            xs.append(matrix(b, dim).copy())
            ids.append(b["id"].to_numpy().copy())
            n += b.num_rows
        if n >= rows:
            yield np.concatenate(xs), np.concatenate(ids)
            xs, ids, n = [], [], 0
    if n:
        yield np.concatenate(xs), np.concatenate(ids)


def copies(table: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
    """Of a group of rows of :func:`blocks`: (id, rep) of ids left out there, or None if the group is a tile."""
    if table["cell"][0].as_py() >= 0:
        return None
    ids, reps = (b"".join(table[c].to_pylist()) for c in ("ids", "per"))
    return np.frombuffer(ids, np.int64), np.frombuffer(reps, np.int64)


class Tile:
    """The points of one task: a cell, or a pair of buckets (i, j) of it; equal vectors are one point."""

    def __init__(self, table: pa.Table, cells: Cells):
        m = min(cells.probes, len(cells.centers))
        self.cell, self.i, self.j = (table[c][0].as_py() for c in ("cell", "i", "j"))
        xs, ids, pers, near, side = [], [], [], [], []
        for n, bucket, i, p, v, c in zip(*(table[x].to_pylist() for x in ("n", "bucket", "ids", "per", "vecs", "cells"))):
            per = unpack(p, n, np.int32, 1).ravel().astype(np.int64)
            xs.append(unpack(v, n, np.float32, cells.dim))
            ids.append(unpack(i, int(per.sum()), np.int64, 1).ravel())
            pers.append(per)
            near.append(unpack(c, n, np.int32, m))
            side.append(np.full(n, bucket))
        x, per, near, side = np.concatenate(xs), np.concatenate(pers), np.concatenate(near), np.concatenate(side)
        row = np.repeat(np.arange(len(x)), per)
        rep, self.ids, self.at = collapse(x[row], np.concatenate(ids))
        rep = row[rep]
        if self.i != self.j:  # the points of bucket i first
            order = np.argsort(side[rep] != self.i, kind="stable")
            size = np.diff(self.at)[order]
            self.ids = np.concatenate([self.ids[self.at[q] : self.at[q + 1]] for q in order])
            self.at, rep = np.r_[0, np.cumsum(size)], rep[order]
        self.x, self.near = x[rep], near[rep]
        self.first = int((side[rep] == self.i).sum()) if self.i != self.j else len(rep)
        self.metric = cells.metric
        self.exact = unit(self.x) if cells.metric == "cosine" else self.x.astype(np.float64)
        # |a - b|^2 is all that either metric needs (unit vectors: cosine = 1 - |a - b|^2 / 2), so the tile is coded
        # around its own mean: the tighter it is, the finer the int8 step and the smaller the error of a product
        w = self.exact - self.exact.mean(axis=0)
        step = max(float(np.abs(w).max()) / 127, 1e-6 if cells.metric == "cosine" else 1e-6 * max(float(np.abs(self.exact).max()), 1e-30))
        code = np.rint(w / step)
        err, norm = np.sqrt(((w - code * step) ** 2).sum(axis=1).max()), np.sqrt((w**2).sum(axis=1).max())
        half = 0.5 * (w**2).sum(axis=1)
        self.step2 = step * step
        self.slack = float(2 * norm * err + err * err + 1e-6 * half.max() + self.step2)
        h, one = (half / self.step2).astype(np.float32)[:, None], np.ones((len(code), 1), np.float32)
        self.code = code.astype(np.int8)
        self.w, self.half, self.tiny = w.astype(np.float32), half.astype(np.float32), float(192 * 2.0**-24 * norm * norm)
        # -|a - b|^2 / 2 = a.b - |a|^2 / 2 - |b|^2 / 2 as one product; codes multiply exactly in float32 (below 2**24)
        self.left = np.hstack([self.code.astype(np.float32), -h, one])
        self.right = np.hstack([self.code.astype(np.float32), one, -h])

    def _bounds(self, bound: float) -> tuple[np.float32, np.float32]:
        """Products from which a pair may, and surely does, reach the bound (cosine at least, squared distance at most)."""
        least = bound - 1 if self.metric == "cosine" else -bound / 2
        return np.float32((least - self.slack) / self.step2), np.float32((least + self.slack) / self.step2)

    def survivors(self, bound: float, rows: int = 256, columns: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (a, b) of points, each once, that may reach ``bound``, and which of them surely do.

        Products are formed in blocks that stay in the cache of a core until they have been looked at.
        """
        low, high = self._bounds(bound)
        same, n = self.i == self.j, len(self.x)
        room = np.empty(rows * columns, np.float32)
        for s in range(0, self.first, rows):
            left = self.left[s : min(s + rows, self.first)]
            for c in range(s if same else self.first, n, columns):
                right = self.right[c : c + columns]
                product = room[: len(left) * len(right)].reshape(len(left), len(right))
                np.matmul(left, right.T, out=product)
                if product.max() < low:
                    continue
                hit = np.flatnonzero(product >= low)
                a, b = hit // len(right) + s, hit % len(right) + c
                sure = product.ravel()[hit] >= high
                if same and c < s + rows:  # the diagonal is in this block
                    up = a < b
                    a, b, sure = a[up], b[up], sure[up]
                if len(a):
                    yield a, b, sure

    def best(self, bound: float, k: int, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Pairs (a, b) that may reach ``bound`` and be among the ``k`` best of a, and whether they stand for (b, a) too.

        In a crowded tile (as some of its rows show) each direction is looked at by itself, and of a row with many
        survivors only those stay whose float32 product is not below, by more than its rounding, those of k others (the
        int8 step follows the farthest vector of the tile, and may be coarse for a dense region in it).
        """
        some = np.arange(0, self.first, max(1, self.first // 128))
        if np.count_nonzero(self.left[some] @ self.right.T >= self._bounds(bound)[0]) <= 4 * k * len(some):
            for a, b, _ in self.survivors(bound):
                yield a, b, True
            return
        low, _ = self._bounds(bound)
        same, n = self.i == self.j, len(self.x)
        sides = [(0, n, 0, n)] if same else [(0, self.first, self.first, n), (self.first, n, 0, self.first)]
        for start, stop, c0, c1 in sides:
            for s in range(start, stop, rows):
                e = min(s + rows, stop)
                product = self.left[s:e] @ self.right[c0:c1].T
                if same:
                    product[np.arange(e - s), np.arange(s, e)] = -np.inf
                hits = product >= low
                crowded = np.flatnonzero(hits.sum(axis=1) > 4 * k)
                if len(crowded):
                    fine = self.w[crowded + s] @ self.w[c0:c1].T - self.half[crowded + s, None] - self.half[c0:c1]
                    if same:
                        fine[np.arange(len(crowded)), crowded + s] = -np.inf
                    kth = np.partition(fine, -k, axis=1)[:, -k]
                    hits[crowded] &= fine >= (kth - np.float32(2 * self.tiny))[:, None]
                a, b = np.nonzero(hits)
                if len(a):
                    yield a + s, b + c0, False

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosine, or minus the squared distance, in double precision."""
        out = np.empty(len(a))
        for s in range(0, len(a), 65_536):
            p, q = self.exact[a[s : s + 65_536]], self.exact[b[s : s + 65_536]]
            out[s : s + 65_536] = np.einsum("ij,ij->i", p, q) if self.metric == "cosine" else -np.einsum("ij,ij->i", p - q, p - q)
        return out

    def owned(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether this cell is the first of those that a pair shares; so every pair is reported once."""
        out = np.empty(len(a), bool)
        mine = np.where(self.near < self.cell, self.near, -1)
        other = np.where(self.near < self.cell, self.near, -2)
        for s in range(0, len(a), 65_536):
            out[s : s + 65_536] = ~(mine[a[s : s + 65_536]][:, :, None] == other[b[s : s + 65_536]][:, None, :]).any(axis=(1, 2))
        return out
