"""Binary vector formats as Python data sources, split by row ranges, and their writers.

Formats (little-endian): fbin and u8bin have the row count and dimension (u32 each) before row-major values; ibin the
same with int32 ids, distances may follow; spmat has rows, columns and non-zeros (i64 each), row pointers (i64),
column indices (i32) and values (f32); npy is numpy's own format.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_KIND = {"fbin": ("<f4", 4), "u8bin": ("u1", 1), "ibin": ("<i4", 4)}


class _Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def _ranges(n: int, parts: int) -> list[_Rows]:
    step = max(1, -(-n // max(parts, 1)))
    return [_Rows(s, min(s + step, n)) for s in range(0, n, step)] or [_Rows(0, 0)]


def header(path: str, kind: str) -> tuple[int, int]:
    """(rows, dimension), checked against the size of the file."""
    with open(path, "rb") as f:
        head = f.read(8)
    if len(head) < 8:
        raise ValueError(f"{path}: no header")
    n, d = (int(x) for x in np.frombuffer(head, "<u4"))
    size, want = os.path.getsize(path), 8 + n * d * _KIND[kind][1]
    if size != want and not (kind == "ibin" and size == want + n * d * 4):
        raise ValueError(f"{path}: {size} bytes, header says {want}")
    return n, d


class _MatrixReader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.path, self.kind = options["path"], kind
        self.n, self.d = header(self.path, kind)
        self.n = min(self.n, int(options.get("limit", self.n)))
        self.parts, self.start_id = int(options.get("partitions", 8)), int(options.get("startid", 0))

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.n, self.parts)

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        dtype, width = _KIND[self.kind]
        data = np.memmap(self.path, dtype, "r", 8, (header(self.path, self.kind)[0], self.d))
        for s in range(part.start, part.end, 4096):
            rows = np.asarray(data[s : min(s + 4096, part.end)])
            rows = rows.astype(np.int32 if self.kind == "ibin" else np.float32)
            offsets = pa.array(np.arange(0, rows.size + 1, max(self.d, 1), dtype=np.int32)) if self.d else pa.array([0] * (len(rows) + 1), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
            ids = pa.array(np.arange(s, s + len(rows), dtype=np.int64) + self.start_id)
            yield pa.RecordBatch.from_arrays([ids, lists], names=["id", "ids" if self.kind == "ibin" else "embedding"])


class _MatrixSource(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return "id bigint, ids array<int>" if self.kind == "ibin" else "id bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options, self.kind)


class FbinSource(_MatrixSource):
    kind = "fbin"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FbinWriter(self.options["path"], schema.fieldNames())


class U8binSource(_MatrixSource):
    kind = "u8bin"


class IbinSource(_MatrixSource):
    kind = "ibin"


class _Part(WriterCommitMessage):
    def __init__(self, path: str, rows: int, dim: int, first: int):
        self.path, self.rows, self.dim, self.first = path, rows, dim, first


class FbinWriter(DataSourceArrowWriter):
    """Tasks write their rows beside the target; the commit puts them together in the order of their ids."""

    def __init__(self, path: str, names: list[str]):
        if not {"id", "embedding"} <= set(names):
            raise ValueError("fbin needs the columns id and embedding")
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        ids, rows = [], []
        for b in batches:
            if b.num_rows:
                ids.append(b["id"].to_numpy())
                rows.append(b["embedding"].flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(b.num_rows, -1))
        context = TaskContext.get()
        path = f"{self.path}.part-{context.partitionId()}-{context.attemptNumber()}"
        if not rows:
            return _Part("", 0, 0, 0)
        i, x = np.concatenate(ids), np.concatenate(rows)
        x = x[np.argsort(i, kind="stable")]
        x.tofile(path)
        return _Part(path, len(x), x.shape[1], int(i.min()))

    def commit(self, messages: list[_Part]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        tmp = self.path + ".tmp"
        with open(tmp, "wb") as out:
            np.array([sum(m.rows for m in parts), parts[0].dim if parts else 0], "<u4").tofile(out)
            for m in parts:
                with open(m.path, "rb") as f:
                    while chunk := f.read(1 << 24):
                        out.write(chunk)
            out.flush()
            os.fsync(out.fileno())
        os.replace(tmp, self.path)
        self._clean(parts)

    def abort(self, messages: list[_Part]) -> None:
        self._clean([m for m in messages if m])

    @staticmethod
    def _clean(parts: list[_Part]) -> None:
        for m in parts:
            if m.path and os.path.exists(m.path):
                os.remove(m.path)


class _SparseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", 8))
        self.rows, self.cols, self.nnz = (int(x) for x in np.fromfile(self.path, "<i8", 3))
        want = 24 + 8 * (self.rows + 1) + 8 * self.nnz
        if os.path.getsize(self.path) != want:
            raise ValueError(f"{self.path}: size is not {want}")

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.rows, self.parts)

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        at = 24 + 8 * (self.rows + 1)
        if part.end <= part.start:
            return
        ptr = np.fromfile(self.path, "<i8", part.end - part.start + 1, offset=24 + 8 * part.start)
        a, b = int(ptr[0]), int(ptr[-1])
        cols = np.fromfile(self.path, "<i4", b - a, offset=at + 4 * a)
        values = np.fromfile(self.path, "<f4", b - a, offset=at + 4 * self.nnz + 4 * a)
        offsets = pa.array((ptr - a).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(part.start, part.end, dtype=np.int64)), pa.ListArray.from_arrays(offsets, pa.array(cols)), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["id", "tags", "weights"]
        )


class SpmatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spmat"

    def schema(self) -> str:
        return "id bigint, tags array<int>, weights array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _SparseReader(self.options)


class _NpyReader(DataSourceReader):
    """All shards of a comma-separated list, numbered through in their order."""

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.shapes = [np.load(p, mmap_mode="r").shape for p in self.paths]

    def partitions(self) -> list[InputPartition]:
        return [_Rows(i, i + 1) for i in range(len(self.paths))]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        x, first = np.load(self.paths[part.start], mmap_mode="r"), sum(s[0] for s in self.shapes[: part.start])
        for s in range(0, len(x), 4096):
            rows = np.asarray(x[s : s + 4096], np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + s, first + s + len(rows), dtype=np.int64)), lists], names=["id", "embedding"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npyshards"

    def schema(self) -> str:
        return "id bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats available to ``spark.read.format``."""
    for source in (FbinSource, U8binSource, IbinSource, SpmatSource, NpySource):
        spark.dataSource.register(source)


def read_matrix(spark: SparkSession, path: str, kind: str = "fbin", **options) -> DataFrame:
    """Rows of an fbin, u8bin or ibin file; options: limit, partitions, startId."""
    register(spark)
    return spark.read.format(kind).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_npy_shards(df: DataFrame, folder: str, *, shards: int) -> list[str]:
    """Writes (id, embedding) as npy shards in ranges of the id, each by the task that holds it; the paths in that order."""
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b["embedding"].flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(b.num_rows, -1) for b in batches if b.num_rows]
        if rows:
            os.makedirs(folder, exist_ok=True)
            path = f"{folder}/shard-{TaskContext.get().partitionId():05d}.npy"
            np.save(path, np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    made = df.select("id", "embedding").repartitionByRange(shards, "id").sortWithinPartitions("id").mapInArrow(write, "path string")
    return [r.path for r in made.orderBy(F.col("path")).collect()]  # one path per shard


def vectors_equal(a: DataFrame, b: DataFrame, *, rtol: float = 1e-6, atol: float = 1e-7) -> DataFrame:
    """Ids whose vectors differ beyond the tolerances, or that one side lacks."""
    from pyspark.sql import functions as F

    rows = a.select("id", F.col("embedding").alias("x")).join(b.select("id", F.col("embedding").alias("y")), "id", "full_outer")
    off = F.exists(F.zip_with("x", "y", lambda p, q: F.coalesce(F.abs(p - q) > F.lit(atol) + F.lit(rtol) * F.abs(q), F.lit(True))), lambda v: v)
    return rows.where(F.col("x").isNull() | F.col("y").isNull() | (F.size("x") != F.size("y")) | off).select("id")
