"""Array predicates with the semantics of a relational array type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def contains_all(a: Column | str, values: Sequence[int]) -> Column:
    """Whether every value occurs; true for no values, null for a null array."""
    out = F.when(_c(a).isNotNull(), F.lit(True))
    for v in values:
        out = out & F.coalesce(F.array_contains(_c(a), F.lit(v)), F.lit(False))
    return F.when(_c(a).isNotNull(), out)


def overlaps(a: Column | str, values: Sequence[int] | Column) -> Column:
    """Whether any value occurs; false for no values or no match whatever nulls there are, null for a null array."""
    other = values if isinstance(values, Column) else (F.array(*(F.lit(v) for v in values)) if values else None)
    if other is None:
        return F.when(_c(a).isNotNull(), F.lit(False))
    return F.when(_c(a).isNotNull(), F.coalesce(F.arrays_overlap(_c(a), other), F.lit(False)))


def between(x: Column | str, low, high) -> Column:
    """Half-open range low <= x < high."""
    return (_c(x) >= F.lit(low)) & (_c(x) < F.lit(high))


def range_atoms(x: str, low: float, high: float, edges: Sequence[float]) -> list[Column]:
    """A range as the union of half-open bucket atoms between sorted edges."""
    cuts = [low, *(e for e in sorted(set(edges)) if low < e < high), high]
    return [between(x, a, b) for a, b in zip(cuts, cuts[1:])]


def ordered_array(value: Column | str, by: Column | str) -> Column:
    """Aggregate: the values of a group as an array in the order of ``by`` (ties: by value)."""
    pairs = F.array_sort(F.collect_list(F.struct(_c(by).alias("o"), _c(value).alias("v"))))
    return F.transform(pairs, lambda s: s["v"])


def recall_at(found: Column | str, truth: Column | str, k: int, *, short: bool = False) -> Column:
    """Share of the first k true ids among the first k found; ``short`` divides by the ids there are, if fewer."""
    a, b = F.slice(_c(found), 1, k), F.slice(_c(truth), 1, k)
    n = F.least(F.lit(k), F.size(b)) if short else F.lit(k)
    return F.size(F.array_intersect(a, b)) / F.nullif(n, F.lit(0))
