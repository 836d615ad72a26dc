"""Percentile rules, bootstrap intervals, paired comparisons and digests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sorted(x: Column | str) -> Column:
    return F.array_sort(F.collect_list(x))


def percentile_floor(x: Column | str, p: float) -> Column:
    """Element at index floor(p (n - 1)); 0.0 for no rows."""
    a = _sorted(x)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.get(a, F.floor(F.lit(p) * (F.size(a) - 1)).cast("int")))


def percentile_nearest(x: Column | str, p: float) -> Column:
    """Nearest rank: the smallest value with at least a share p at or below it; 0.0 for no rows."""
    a = _sorted(x)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.get(a, F.greatest(F.lit(0), F.ceil(F.lit(p) * F.size(a)).cast("int") - 1)))


def percentile_linear(x: Column | str, p: float) -> Column:
    """Linear interpolation between neighbours (the engine's own aggregate, no list is built)."""
    return F.percentile(x, F.lit(p))


def percentile_truncated(x: Column | str, p: float) -> Column:
    """Element at index int(p n) - 1, at least 0; 0.0 for no rows."""
    a = _sorted(x)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.get(a, F.greatest(F.lit(0), F.floor(F.lit(p) * F.size(a)).cast("int") - 1)))


def percentile_round(x: Column | str, p: float) -> Column:
    """Element at index round(p (n - 1)), halves to even: thresholds of a score catalog."""
    a = _sorted(x)
    return F.get(a, F.bround(F.lit(p) * (F.size(a) - 1)).cast("int"))


#: 0-based places of a percentile p among n sorted values, by rule
PLACES = {
    "floor": lambda p, n: F.floor(F.lit(p) * (n - 1)),
    "nearest": lambda p, n: F.greatest(F.lit(1), F.ceil(F.lit(p) * n)) - 1,
    "truncated": lambda p, n: F.greatest(F.lit(1), F.floor(F.lit(p) * n)) - 1,
    "round": lambda p, n: F.bround(F.lit(p) * (n - 1)),
}


def group_percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Per group the percentiles ``name: (rule, p)``; rules are those of ``PLACES`` and 'linear'.

    No list of a group is built: its distinct values are counted, their running counts are formed in ranges of (group,
    value), so that a hot group spans many tasks, and the values at the places asked for are picked. Null values are no
    values, a group without any gives no row; null groups are a group.
    """
    from tarnfield.operators.relational import keyed_running

    rows = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    rows = keyed_running(rows, by, [value], sums={"__before": F.col("__c")}).withColumn("__before", F.coalesce("__before", F.lit(0)))
    keys = [f"__k{i}" for i in range(len(by))]
    total = rows.groupBy(*by).agg(F.sum("__c").alias("__n")).select(*(F.col(b).alias(k) for b, k in zip(by, keys)), "__n")
    same = F.lit(True)
    for b, k in zip(by, keys):
        same = same & F.col(b).eqNullSafe(F.col(k))
    rows, n = rows.join(total, same), F.col("__n")
    at = lambda place: F.max(F.when((F.col("__before") <= place) & (place < F.col("__before") + F.col("__c")), F.col(value)))
    out, final = [], []
    for name, (rule, p) in wanted.items():
        if rule == "linear":
            place = F.lit(p) * (n - 1)
            out += [at(F.floor(place)).alias(f"__l_{name}"), at(F.ceil(place)).alias(f"__h_{name}"), F.max(place - F.floor(place)).alias(f"__f_{name}")]
            final.append((F.col(f"__l_{name}") + F.col(f"__f_{name}") * (F.col(f"__h_{name}") - F.col(f"__l_{name}"))).alias(name))
        else:
            out.append(at(PLACES[rule](p, n)).alias(name))
            final.append(F.col(name))
    return rows.groupBy(*by).agg(*out).select(*by, *final)


def summary(x: Column | str) -> list[Column]:
    """Aggregates of a measurement: n, mean, median, p95, p99, stdev, minimum, maximum."""
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.95)).alias("p95"),
        F.percentile(x, F.lit(0.99)).alias("p99"), F.stddev_samp(x).alias("stdev"), F.min(x).alias("least"), F.max(x).alias("most"),
    ]


def _resampled(values: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """Means of ``samples`` seeded resamples (rows of ``values`` are drawn together), ascending."""
    rng, n, out = np.random.default_rng(seed), len(values), []
    at_once = max(1, 4_000_000 // max(n, 1))
    for s in range(0, samples, at_once):
        out.append(values[rng.integers(0, n, (min(at_once, samples - s), n))].mean(axis=1))
    return np.concatenate(out)


def bootstrap_mean(values: Sequence[float], *, samples: int = 10_000, seed: int = 0) -> tuple[float, float, float, float]:
    """(mean, lower bound at 95 %, low, high of the 95 % interval) of a seeded bootstrap; the same seed gives the same
    bounds. Zeros for no values; one value, or no samples, is its own bound."""
    v = np.asarray(values, float)
    if not len(v):
        return 0.0, 0.0, 0.0, 0.0
    if len(v) == 1 or samples <= 0:
        return (float(v.mean()), *[float(v[0])] * 3)
    return (float(v.mean()), *(float(x) for x in np.percentile(_resampled(v, samples, seed), [5, 2.5, 97.5])))


def paired_ratio(pairs: Sequence[tuple[float, float]], *, samples: int = 10_000, seed: int = 0) -> tuple[float, float, float, float]:
    """(ratio of means, its lower bound at 95 %, low, high of the 95 % interval) over resampled pairs (baseline, method)."""
    v = np.asarray(pairs, float).reshape(-1, 2)
    if not len(v):
        return 0.0, 0.0, 0.0, 0.0
    ratio = float(v[:, 0].mean() / v[:, 1].mean()) if v[:, 1].mean() > 0 else 0.0
    if len(v) == 1 or samples <= 0:
        return ratio, ratio, ratio, ratio
    m = _resampled(v, samples, seed)
    found = np.divide(m[:, 0], m[:, 1], out=np.zeros(len(m)), where=m[:, 1] > 0)
    return (ratio, *(float(x) for x in np.percentile(found, [5, 2.5, 97.5])))


def bootstrap_groups(df: DataFrame, by: list[str], value: str, order: list[str], *, samples: int = 10_000, seed: int = 0) -> DataFrame:
    """Bootstrap bounds per group of per-query means (few values per group: aggregate to one per query first)."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema.fields), "n bigint, mean double, lower double, low double, high double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].dropna().tolist()
        return pdf[by].head(1).assign(n=len(v), **dict(zip(("mean", "lower", "low", "high"), bootstrap_mean(v, samples=samples, seed=seed))))

    return df.groupBy(*by).applyInPandas(run, schema)


def paired_comparison(baseline: DataFrame, method: DataFrame, expected: DataFrame, by: list[str], key: str, value: str, *, samples: int = 10_000, seed: int = 0) -> DataFrame:
    """Per group ``by``: the speed of a method against a baseline over the keys that are expected.

    (by, expected, paired, status, speedup, speedup_lower, speedup_low, speedup_high, saving): ``status`` is 'complete'
    only if every expected key has a value on both sides and no other key has any; else it is 'incomplete' and the
    figures are null, so that lost pairs can't improve a result. Values of a key are averaged first.
    """
    mean = lambda df, name: df.groupBy(*by, key).agg(F.avg(value).alias(name))
    both = mean(baseline, "a").join(mean(method, "b"), [*by, key], "full_outer").join(expected.select(*by, key).distinct().withColumn("want", F.lit(1)), [*by, key], "full_outer")
    names = "speedup double, speedup_lower double, speedup_low double, speedup_high double, saving double"
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in both.select(*by).schema.fields), "expected bigint, paired bigint, status string", names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        want, pairs = pdf["want"].notna(), pdf[pdf["a"].notna() & pdf["b"].notna()]
        ok = bool(len(pdf)) and bool((want & pdf["a"].notna() & pdf["b"].notna()).all())
        found = paired_ratio(pairs[["a", "b"]].to_numpy().tolist(), samples=samples, seed=seed) if ok else [None] * 4
        saving = float((pairs["a"] - pairs["b"]).mean()) if ok else None
        row = dict(zip(("speedup", "speedup_lower", "speedup_low", "speedup_high"), found))
        return pdf[by].head(1).assign(expected=int(want.sum()), paired=len(pairs), status="complete" if ok else "incomplete", **row, saving=saving).astype({x: "float64" for x in (*row, "saving")})

    return both.groupBy(*by).applyInPandas(run, schema)


def ordered_digest(value: Column | str, by: Column | str | None = None) -> Column:
    """Aggregate: SHA-256 of the values joined by commas in the order of ``by`` (default: of the values themselves)."""
    v = F.col(value) if isinstance(value, str) else value
    if by is None:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(v)), lambda x: x.cast("string")), ","), 256)
    pairs = F.array_sort(F.collect_list(F.struct((F.col(by) if isinstance(by, str) else by).alias("o"), v.cast("string").alias("v"))))
    return F.sha2(F.array_join(F.transform(pairs, lambda s: s["v"]), ","), 256)


def content_hash(*columns: str) -> Column:
    """Aggregate: order-insensitive content hash of rows that scales (sum of row hashes, so no list is built)."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
