"""Per-key results under heavy skew: multi-level tree aggregation.

A handful of keys may hold most rows. A plain ``groupBy(key)`` already combines on the map side, but every map
task still sends its partial of a hot key to the same reducer. Here each input chunk of fixed size is combined locally
into one state per key, the states are written and numbered, and they are merged in rounds of a fixed fan-in, as many
as their number needs: no group of a round ever has more than ``fan_in`` partials of one key, however many partitions
the input has.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.session import stored

#: merge step of each decomposable aggregate
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "bool_or": F.bool_or, "bool_and": F.bool_and}


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    states: Mapping[str, tuple[str, Column]],
    *,
    fan_in: int = 16,
    chunk_rows: int = 1 << 20,
) -> DataFrame:
    """Aggregate ``df`` per ``keys`` by local combination and logarithmic fan-in rounds.

    ``states`` maps an output column to ``(kind, expression)``; kind is one of count, sum, min, max, bool_or,
    bool_and. Averages and variances follow from sums. A level-0 chunk is ``chunk_rows`` consecutive rows of an input
    partition.

    Null keys form a group of their own, as in SQL; nulls in a value are skipped by every kind (count counts the
    non-null values); an empty input gives no rows. Columns of ``df`` that are not named are ignored, so names that
    clash with the internal ones cannot arise: the result has the keys and the states only.
    """
    if unknown := {k for k, _ in states.values()} - set(_MERGE):
        raise ValueError(f"not decomposable: {sorted(unknown)}")
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    key_cols = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    ss = [f"s{i}" for i in range(len(states))]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    level = df.select(
        *key_cols,
        *(e.alias(s) for s, (_, e) in zip(ss, states.values())),
        F.spark_partition_id().alias("part"),
        (place / chunk_rows).cast("bigint").alias("piece"),
    )
    first = {"count": F.count, **{k: f for k, f in _MERGE.items() if k != "count"}}
    # Local combination: Spark's partial aggregate runs inside each map task before anything is shuffled; part and
    # piece in the grouping keep the states of different chunks apart for the fan-in rounds.
    level = level.groupBy(*ks, "part", "piece").agg(*(first[kind](s).alias(s) for s, (kind, _) in zip(ss, states.values())))
    level = stored(level, "states")
    size = level.agg(F.max("part").alias("part"), F.max("piece").alias("piece")).first()
    pieces = (size.piece or 0) + 1
    left = ((size.part or 0) + 1) * pieces
    level = level.withColumn("chunk", F.col("part") * pieces + F.col("piece")).drop("part", "piece")
    while True:
        last = left <= fan_in
        by = [*ks] if last else [*ks, (F.col("chunk") / fan_in).cast("bigint").alias("chunk")]
        level = level.groupBy(*by).agg(*(_MERGE[kind](s).alias(s) for s, (kind, _) in zip(ss, states.values())))
        if last:
            break
        left = -(-left // fan_in)
    return level.select(
        *(F.col(k).alias(name) for k, name in zip(ks, keys)), *(F.col(s).alias(name) for s, name in zip(ss, states))
    )


def heavy_keys(counts: DataFrame, key: str, count: str, *, share: float) -> DataFrame:
    """Keys that hold more than ``share`` of the total of ``count``; adds ``total`` and ``key_share``.

    ``counts`` has one row per key (as :func:`tree_aggregate` returns), so the total is one small aggregate.
    """
    total = counts.agg(F.sum(count).alias("total"))
    return (
        counts.crossJoin(total)  # a single row
        .withColumn("key_share", F.col(count) / F.col("total"))
        .where(F.col(count) > F.col("total") * F.lit(share))
    )


def clean_category(c: Column) -> Column:
    """Lower case, ``&amp;`` read as ``&``, runs of white space as one space, trimmed; blank becomes null."""
    c = F.regexp_replace(F.lower(c), "&amp;", "&")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    c = F.trim(c)
    return F.when(c != "", c)
