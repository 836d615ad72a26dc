"""Percentiles of very large numeric columns by mergeable relative-rank compactors.

Each sketch is a stack of compactors; an item on level ``h`` stands for ``2**h`` values. When a compactor is full it
sorts its buffer, protects the upper end and replaces an even number of its lowest items by every second one of
them, promoted a level up. How far up the compacted region reaches follows a fixed schedule (the trailing ones of
the level's compaction counter), so the upper tail is touched ever more rarely and errors there are relative to the
distance from the maximum. Levels of two sketches merge by concatenation, which is how partitions and run days are
combined.

Besides the statistical guarantee every sketch carries a bound that always holds: one compaction on level ``h``
shifts the rank of a point by at most ``2**h``, and only of points below the largest item it compacted. Brackets
derived from it therefore contain the exact percentile with certainty, and an exact pass over a bracket settles
what the sketch leaves open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.session import stored

#: items protected at the start are SECTIONS * k; k is the parameter of the accuracy
SECTIONS = 3
_HEAD = np.dtype([("level", "<i4"), ("state", "<i8"), ("sections", "<i4"), ("size", "<f8"), ("events", "<i8"), ("top", "<f8"), ("items", "<i8")])


class _Compactor:
    __slots__ = ("events", "items", "sections", "size", "state", "top")

    def __init__(self, k: int):
        self.items, self.state, self.sections, self.size = np.empty(0), 0, SECTIONS, float(k)
        #: compactions done, and the largest item any of them touched
        self.events, self.top = 0, -math.inf

    @property
    def section(self) -> int:
        return max(4, 2 * round(self.size / 2))

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.section

    def compact(self, coin: int) -> np.ndarray:
        """Replaces the lower region by half of its items, which are returned for the level above."""
        self.items.sort()
        n = min(self.sections, ((~self.state & (self.state + 1)).bit_length() - 1) + 1)  # trailing ones, plus one
        keep = self.capacity // 2 + (self.sections - n) * self.section
        end = len(self.items) - keep
        end -= end % 2
        if end <= 0:
            return np.empty(0)
        region, self.items = self.items[:end], self.items[end:].copy()
        self.events, self.top, self.state = self.events + 1, max(self.top, float(region[-1])), self.state + 1
        if self.state >= 1 << (self.sections - 1) and self.section > 4:
            self.sections, self.size = 2 * self.sections, self.size / math.sqrt(2)
        return region[coin::2].copy()


class RankSketch:
    """Mergeable percentile sketch with multiplicative rank error towards the maximum (see the module)."""

    __slots__ = ("k", "levels", "max", "min", "n")

    def __init__(self, k: int = 64):
        self.k, self.n, self.min, self.max = k, 0, math.inf, -math.inf
        self.levels: list[_Compactor] = [_Compactor(k)]

    def update(self, values: np.ndarray) -> RankSketch:
        """Adds finite values."""
        if len(values):
            self.n += len(values)
            self.min, self.max = min(self.min, float(values.min())), max(self.max, float(values.max()))
            self.levels[0].items = np.concatenate([self.levels[0].items, values])
            self._settle()
        return self

    def merge(self, other: RankSketch) -> RankSketch:
        self.n, self.min, self.max = self.n + other.n, min(self.min, other.min), max(self.max, other.max)
        for h, b in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(_Compactor(self.k))
            a = self.levels[h]
            a.items = np.concatenate([a.items, b.items])
            a.events, a.top, a.state = a.events + b.events, max(a.top, b.top), a.state | b.state
            if b.sections > a.sections:
                a.sections, a.size = b.sections, b.size
        self._settle()
        return self

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            if len(level.items) >= level.capacity:
                # a fixed mixing of level, counter and n stands in for the coin: reruns of a task give the same sketch
                coin = (((h + 1) * 0x9E3779B97F4A7C15 ^ (level.state // 2) * 0xC2B2AE3D27D4EB4F ^ self.n * 0x165667B19E3779F9) >> 33) & 1
                up = level.compact(coin ^ (level.state & 1))
                if len(up):
                    if h + 1 == len(self.levels):
                        self.levels.append(_Compactor(self.k))
                    self.levels[h + 1].items = np.concatenate([self.levels[h + 1].items, up])
            h += 1

    def _ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items ascending, their estimated inclusive ranks, and a certain bound of the error of each rank."""
        items = np.concatenate([c.items for c in self.levels])
        weight = np.concatenate([np.full(len(c.items), 1 << h, np.int64) for h, c in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        items, rank = items[order], np.cumsum(weight[order])
        off = np.zeros(len(items), np.int64)
        for h, c in enumerate(self.levels):
            if c.events:
                off[items < c.top] += c.events << h
        last = np.flatnonzero(np.append(items[1:] != items[:-1], True)) if len(items) else []
        return items[last], rank[last], off[last]

    def bracket(self, num: int, den: int) -> tuple[float, float, float]:
        """Estimate of the ``num/den`` percentile and (low, high] that certainly hold the exact one.

        The percentile is the smallest value with at least that share of the values at or below it.
        """
        if not self.n:
            return math.nan, math.nan, math.nan
        target = max(1, -(-num * self.n // den))
        items, rank, off = self._ranked()
        est = items[min(np.searchsorted(rank, target), len(items) - 1)]
        below, above = np.flatnonzero(rank + off < target), np.flatnonzero(rank - off >= target)
        low = float(items[below[-1]]) if len(below) else -math.inf
        high = float(items[above[0]]) if len(above) else self.max
        return float(min(max(est, self.min), self.max)), low, min(high, self.max)

    def to_bytes(self) -> bytes:
        head = np.zeros(len(self.levels), _HEAD)
        for h, c in enumerate(self.levels):
            head[h] = (h, c.state, c.sections, c.size, c.events, c.top, len(c.items))
        fixed = np.array([self.k, self.n, len(head)], "<i8").tobytes() + np.array([self.min, self.max], "<f8").tobytes()
        return fixed + head.tobytes() + np.concatenate([c.items for c in self.levels]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> RankSketch:
        k, n, levels = (int(x) for x in np.frombuffer(data, "<i8", 3))
        self = cls(k)
        self.n, (self.min, self.max) = n, (float(x) for x in np.frombuffer(data, "<f8", 2, 24))
        head = np.frombuffer(data, _HEAD, levels, 40)
        items, self.levels = np.frombuffer(data, "<f8", -1, 40 + head.nbytes), []
        for x in head:
            c = _Compactor(k)
            c.state, c.sections, c.size, c.events, c.top = int(x["state"]), int(x["sections"]), float(x["size"]), int(x["events"]), float(x["top"])
            c.items, items = items[: x["items"]].copy(), items[x["items"] :]
            self.levels.append(c)
        return self


def sketch_groups(df: DataFrame, by: list[str], value: str, *, k: int = 64, fan_in: int = 64, rows_at_once: int = 1_000_000) -> DataFrame:
    """One sketch per group ``by``: columns ``by``, ``n`` and ``sketch`` (binary).

    Every input partition builds its own sketches (a hot group costs one sketch per partition, not its rows), then
    sketches of a group are merged in as many rounds as it takes for ``fan_in`` at once. Null, NaN and infinite values are
    not counted; a null in ``by`` is a group of its own; a group without values, and an empty table, give no row.
    """
    names = [f"g{i}" for i in range(len(by))]
    rows = df.select(*(F.col(f"`{b}`").alias(g) for b, g in zip(by, names)), F.col(f"`{value}`").cast("double").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != F.lit(math.inf)))
    keys = T.StructType(rows.schema.fields[: len(by)])
    out = T.StructType([*keys.fields, T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, count = TaskContext.get().partitionId(), [], 0
        sketches: dict[tuple, RankSketch] = {}

        def take() -> None:
            t = pa.Table.from_batches(held)
            codes, uniques = pd.MultiIndex.from_arrays([t[g].to_pandas() for g in names]).factorize() if len(names) > 1 else pd.factorize(t[names[0]].to_pandas(), use_na_sentinel=False) if names else (np.zeros(len(t), int), [()])
            v = t["v"].to_numpy()
            order = np.lexsort((v, codes))
            codes, v = codes[order], v[order]
            for start, end in zip(starts := np.flatnonzero(np.diff(codes, prepend=-1)), np.append(starts[1:], len(codes))):
                key = uniques[codes[start]]
                key = tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))
                (sketches.get(key) or sketches.setdefault(key, RankSketch(k))).update(v[start:end])

        def rows_out() -> pa.RecordBatch:
            cols = list(zip(*sketches)) if names else []
            arrays = [pa.array(list(c), f.type) for c, f in zip(cols, schema)]
            n = len(sketches)
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int32()), pa.array([s.n for s in sketches.values()], pa.int64()), pa.array([s.to_bytes() for s in sketches.values()], pa.binary())], names=[*names, "part", "n", "sketch"])

        schema: list = []
        for batch in batches:
            schema = schema or [batch.schema.field(g) for g in names]
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= rows_at_once:
                take()
                held, count = [], 0
                if len(sketches) > 20_000:  # many groups: hand over what there is, the merge completes it
                    yield rows_out()
                    sketches.clear()
        if held:
            take()
        if sketches:
            yield rows_out()

    # the sketches of the tasks are few and small; written, they tell how many there are to merge, and lost executors
    # cost no second pass over the rows
    partial = stored(rows.mapInArrow(build, out), "sketches")
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    for r in range(rounds := fan_in_rounds(parts, fan_in)):
        up = F.lit(0) if r == rounds - 1 else (F.col("part") / fan_in).cast("int")
        partial = _merged(partial.withColumn("part", up).groupBy(*names, "part"), out, names)
    return partial.select(*(F.col(g).alias(b) for g, b in zip(names, by)), "n", "sketch")


def fan_in_rounds(parts: int, fan_in: int) -> int:
    """Rounds until ``parts`` states of a group are one, if at most ``fan_in`` are merged at once."""
    rounds, reach = 1, fan_in
    while reach < parts:
        rounds, reach = rounds + 1, reach * fan_in
    return rounds


def merge_groups(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Combine sketches (columns ``by``, ``n``, ``sketch``), say of several days, into one per group ``by``."""
    names = [f"g{i}" for i in range(len(by))]
    rows = sketches.select(*(F.col(f"`{b}`").alias(g) for b, g in zip(by, names)), F.lit(0).alias("part"), "n", "sketch")
    out = T.StructType([*rows.schema.fields[: len(by)], *(T.StructField(f.name, f.dataType) for f in rows.schema.fields[len(by) :])])
    return _merged(rows.groupBy(*names, "part"), out, names).select(*(F.col(g).alias(b) for g, b in zip(names, by)), "n", "sketch")


def _merged(groups: GroupedData, schema: T.StructType, names: list[str]) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        blobs = table["sketch"].to_pylist()
        first = RankSketch.from_bytes(blobs[0])
        for blob in blobs[1:]:
            first.merge(RankSketch.from_bytes(blob))
        row = table.slice(0, 1)
        row = row.set_column(row.schema.get_field_index("n"), "n", pa.array([first.n], pa.int64()))
        return row.set_column(row.schema.get_field_index("sketch"), "sketch", pa.array([first.to_bytes()], pa.binary())).select([*names, "part", "n", "sketch"])

    return groups.applyInArrow(merge, schema)


def percentiles(sketches: DataFrame, by: list[str], shares: dict[str, tuple[int, int]]) -> DataFrame:
    """Per sketch row and percentile ``name: (num, den)``: ``name`` (estimate), ``name_low``, ``name_high``.

    The exact percentile lies in (low, high]. A null or foreign sketch is an error; no rows give no rows.
    """
    kept = sketches.select(*(F.col(f"`{b}`") for b in by), "n", "sketch")
    new = [T.StructField(f"{name}{x}", T.DoubleType()) for name in shares for x in ("", "_low", "_high")]
    schema = T.StructType([*kept.schema.fields[:-1], *new])

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x for num, den in shares.values() for x in s.bracket(num, den)] for s in map(RankSketch.from_bytes, batch["sketch"].to_pylist())]
            cols = np.array(found, float).reshape(batch.num_rows, len(new)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.float64()) for c in cols)], names=[f.name for f in schema.fields])

    return kept.mapInArrow(estimate, schema)


def same_group_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on the group columns, where null is a group of its own."""
    names = {b: f"__r{i}" for i, b in enumerate(by)}
    other = right.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns))
    same = F.lit(True)
    for b, r in names.items():
        same = same & F.col(f"`{b}`").eqNullSafe(F.col(r))
    return left.join(other, same, how).drop(*names.values())


def exact_percentile(values: DataFrame, brackets: DataFrame, by: list[str], value: str, name: str, num: int, den: int) -> DataFrame:
    """The exact percentile of the groups in ``brackets`` (``by``, ``n``, ``name_low``, ``name_high``).

    Counts what lies at or below the bracket and ranks only the distinct values inside it, a share of the group
    that the sketch's error bounds; nothing else of the group is sorted or moved.
    """
    lo, hi = F.col(f"{name}_low"), F.col(f"{name}_high")
    rows = same_group_join(values, brackets.select(*by, "n", lo, hi), by).where(F.col(value) <= hi)
    inside = F.when(F.col(value) > lo, F.col(value))
    counts = rows.groupBy(*by, inside.alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    from pyspark.sql import Window

    running = F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    target = F.expr(f"({num} * n + {den} - 1) div {den}")
    return counts.withColumn("upto", running).where(F.col("v").isNotNull() & (F.col("upto") >= target)).groupBy(*by).agg(F.min("v").alias(name))
