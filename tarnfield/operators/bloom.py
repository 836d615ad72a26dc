"""Bloom filters and packed bitmaps over ids; both are built in the tasks and combined by OR."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ROW, LEAST_BITS, PROBES = 10, 1024, 7


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Bloom:
    """No false negatives; false positives at about (1 - e^(-7n/m))^7."""

    bits: np.ndarray
    size: int
    rows: int

    def places(self, ids: np.ndarray) -> np.ndarray:
        return _places(ids, self.size)

    def test(self, ids: np.ndarray) -> np.ndarray:
        p = _places(ids, self.size)
        return ((self.bits[p >> 3] >> (p & 7)) & 1).all(axis=0)

    def __or__(self, other: Bloom) -> Bloom:
        return Bloom(self.bits | other.bits, self.size, self.rows + other.rows)

    @property
    def false_positive_rate(self) -> float:
        return float((1 - np.exp(-PROBES * self.rows / self.size)) ** PROBES)


def _places(ids: np.ndarray, size: int) -> np.ndarray:
    a, b = _mix(ids, 1), _mix(ids, 2) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64) for i in range(PROBES)])


def build_bloom(df: DataFrame, column: str = "id", *, most_mb: int = 64) -> Bloom:
    """Filter of the non-null ids; the size follows the row count and is bounded by ``most_mb`` (then lossier)."""
    ids = df.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("id"))
    rows = ids.count()
    size = min(max(LEAST_BITS, BITS_PER_ROW * rows), most_mb << 23)
    size += -size % 8

    piece = 1 << 18  # bytes of a range of the filter; ranges are merged apart from each other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bits = TaskContext.get().partitionId(), np.zeros(size // 8, np.uint8)
        for b in batches:
            p = _places(b["id"].to_numpy(), size).ravel()
            np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
        for s in range(0, len(bits), piece):
            if bits[s : s + piece].any():
                yield _ranges([(s // piece, part, bits[s : s + piece].tobytes())])

    def merge(t: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()])
        return pa.Table.from_batches([_ranges([(t["piece"][0].as_py(), t["part"][0].as_py(), out.tobytes())])])

    schema = "piece int, part int, bits binary"
    partial = ids.mapInArrow(run, schema)
    # a range is merged over 64 tasks at a time, so that no task gets all partial filters of a wide input
    partial = partial.withColumn("part", (F.col("part") / 64).cast("int")).groupBy("piece", "part").applyInArrow(merge, schema)
    partial = partial.withColumn("part", F.lit(0)).groupBy("piece", "part").applyInArrow(merge, schema)
    bits = np.zeros(size // 8, np.uint8)
    for r in partial.collect():  # each range once: a filter of at most most_mb
        bits[r.piece * piece : r.piece * piece + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return Bloom(bits, size, rows)


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["piece", "part", "bits"])


def may_contain(bloom: Bloom, column: str = "id") -> Column:
    """Column test against the filter, which goes to each executor once, as a broadcast of bounded size."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def test(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        return pd.Series(shared.value.test(ids.fillna(0).to_numpy(np.int64))) & known.reset_index(drop=True)

    return test(F.col(column).cast("bigint"))


def id_bitmap(df: DataFrame, column: str = "id") -> DataFrame:
    """(bucket, bits): packed bitmap of the ids, one row per bucket of 32,768 ids (so ids of different buckets never
    share a bit)."""
    c = F.col(column).cast("bigint")
    return df.where(c.isNotNull()).groupBy(F.bitmap_bucket_number(c).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("bits"))


def bitmap_count(bitmap: DataFrame) -> DataFrame:
    return bitmap.agg(F.sum(F.bitmap_count("bits")).alias("ids"))


def bitmap_filter(df: DataFrame, bitmap: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is in the bitmap: a join on the bucket and a bit test."""
    c = F.col(column).cast("bigint")
    pos = F.bitmap_bit_position(c)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.shiftrightunsigned(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(bitmap_bit_position(cast({column} as bigint)), 8) as int))")) != 0
    return df.join(bitmap, F.bitmap_bucket_number(c) == F.col("bucket")).where(hit).drop("bucket", "bits")
