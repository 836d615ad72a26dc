"""Top N items within every group by descending score bands.

Rows are cut into bands of score, highest first. A band is read, its rows of groups that are not yet filled are kept
as candidates, and groups that now have N items are filled; the next band is anti-joined with the filled groups. A
group of millions of items is done after the first bands, and what remains for exact ranking with the tie rule is
the boundary bands only, thinned to N per group and task before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.session import stored


def latest_rows(df: DataFrame, key: list[str], version: str, value: str) -> DataFrame:
    """Per key the value of the row with the latest version (null versions come first; of equal ones the greatest
    value counts). Combines on the map side, so repeated rows of a hot key never meet in one task."""
    best = F.max(F.struct(F.col(version).alias("v"), F.col(value).alias("x"))).alias("best")
    return df.groupBy(*key).agg(best).select(*key, F.col("best.x").alias(value))


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], n: int, *, bands: tuple[float, ...] = (0.9, 0.7, 0.4)) -> DataFrame:
    """The first ``n`` rows of each ``group`` by ``score`` descending, then ``ties`` ascending.

    ``bands`` are the quantiles of the score at which bands are cut (estimates suffice: a cut only decides in which
    round a row is seen, never whether). Rows with a null score are no items. Fewer than ``n`` items give fewer
    rows; an empty table gives none. A null group is a group. Columns besides those named are dropped; the rank is
    ``rank_no``. Equal rows (same group, score and ties) are all kept as items, in either order.
    """
    rows = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*group, score, *ties]))).where(F.col(f"`{score}`").isNotNull())
    # written once in ranges of the score, so that each round reads the files of its band only; the ties are part of
    # the order, so that a score that very many rows share is spread over the ranges
    table = stored(rows.repartitionByRange(F.col(f"`{score}`").desc(), *(F.col(f"`{t}`") for t in ties)), "ranges")
    edges = sorted(set(table.approxQuantile(score, list(bands), 0.02)), reverse=True)
    candidates: list[DataFrame] = []
    filled: DataFrame | None = None
    for upper, lower in zip([None, *edges], [*edges, None]):
        part = table
        if upper is not None:
            part = part.where(F.col(f"`{score}`") < F.lit(upper))
        if lower is not None:
            part = part.where(F.col(f"`{score}`") >= F.lit(lower))
        if filled is not None:
            part = part.join(filled, _same(part, filled, group), "left_anti")
        # n per group and task before the shuffle (Spark's window group limit), n per group after it
        candidates.append(stored(_ranked(part, group, score, ties, n).drop("rank_no"), "band-top"))
        if lower is not None:
            so_far = reduce(DataFrame.unionByName, candidates).groupBy(*group).agg(F.count("*").alias("n_"))
            filled = so_far.where(F.col("n_") >= n).select(*group)
    return _ranked(reduce(DataFrame.unionByName, candidates), group, score, ties, n)


def _ranked(df: DataFrame, group: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), *(F.col(t).asc() for t in ties))
    return df.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= n)


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in cols))

