import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfield.llm.percentiles import RankSketch, exact_percentile, merge_groups, percentiles, sketch_groups
from tarnfield.llm.queries import p1_found


def exact(values, num, den):
    v = np.sort(values)
    return v[max(1, -(-num * len(v) // den)) - 1]


@pytest.mark.parametrize("kind", ["uniform", "lognormal", "few", "sorted", "equal"])
@pytest.mark.parametrize("parts", [1, 40])
def test_brackets_hold_the_exact_percentile(kind, parts):
    rng = np.random.default_rng(5)
    n = 200_000
    v = {"uniform": rng.random(n), "lognormal": rng.lognormal(0, 2, n), "few": rng.integers(0, 9, n).astype(float), "sorted": np.arange(n, dtype=float), "equal": np.full(n, 3.5)}[kind]
    whole = RankSketch()
    for part in np.array_split(v, parts):
        whole.merge(RankSketch.from_bytes(RankSketch().update(part).to_bytes()))
    assert whole.n == n and whole.max == v.max() and sum(len(c.items) << h for h, c in enumerate(whole.levels)) == n
    assert sum(len(c.items) for c in whole.levels) < 12_000
    for num, den in ((1, 2), (9, 10), (99, 100), (999, 1000), (1, 1), (0, 1)):
        est, low, high = whole.bracket(num, den)
        assert low < exact(v, num, den) <= high
        rank = np.searchsorted(np.sort(v), est, side="right") / n
        if kind in ("uniform", "lognormal", "sorted"):
            assert abs(rank - num / den) <= 0.02 * (1 - num / den) + 1.5 / n  # relative to the distance from the top


@given(st.lists(st.lists(st.floats(-1e6, 1e6), max_size=300), max_size=8), st.integers(1, 100))
@settings(max_examples=60, deadline=None)
def test_any_merge_keeps_the_bracket(parts, q):
    s = RankSketch(8)
    for p in parts:
        s.merge(RankSketch(8).update(np.array(p, float)))
    v = np.array([x for p in parts for x in p])
    if len(v):
        _, low, high = s.bracket(q, 100)
        assert low < exact(v, q, 100) <= high


def test_groups_nulls_and_days(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else None, i % 4, float(rng.lognormal())) for i in range(4000)] + [("a", 0, None), ("a", 0, math.nan), ("a", 0, math.inf), ("b", 1, None)]
    df = spark.createDataFrame(rows, "name string, day int, x double").withColumn("n", F.lit(1)).withColumn("sketch", F.lit("clash")).repartition(16)
    days = sketch_groups(df, ["name", "day"], "x", fan_in=3)
    whole = percentiles(merge_groups(days, ["name"]), ["name"], {"p50": (1, 2), "p99": (99, 100)})
    got = {r.name: r for r in whole.collect()}
    assert set(got) == {"a", None}
    for k, r in got.items():
        v = [x for n, _, x in rows if n == k and x is not None and math.isfinite(x)]
        assert r.n == len(v) and r.p99_low < exact(v, 99, 100) <= r.p99_high
    b = whole.select("name", "n", "p50_low", "p50_high").where("name IS NOT NULL")
    values = df.where("x IS NOT NULL AND NOT isnan(x)").where(F.col("x") < 1e300).select("name", "x")
    e = exact_percentile(values, b, ["name"], "x", "p50", 1, 2).first()
    assert e.p50 == exact([x for n, _, x in rows if n == "a" and x is not None and math.isfinite(x)], 1, 2)
    assert sketch_groups(df.limit(0), ["name"], "x").count() == 0


def test_found(spark, tmp_path):
    rows, n = [], 0
    for name, tail in (("Slow ", 60.0), ("even", 5.9), ("edge", 6.0), ("retired", 99.0), ("short", 99.0)):
        for i in range(99 if name == "short" else 200):
            rows.append((n, name if i % 2 else name.upper().strip(), "m", 1.0 if i < 150 else tail))
            n += 1
    rows += [rows[0]] * 500 + [(n + 1, None, "m", 1.0), (None, "slow", "m", 1.0), (n + 2, "slow", "m", None), (n + 3, "slow", "m", -1.0), (n + 4, "slow", "m", math.nan), (n + 5, "slow", "m", math.inf), (n + 6, "slow", "m", 0.0)]
    df = spark.createDataFrame(rows, "result_id bigint, filter_name string, run_method string, latency_ms double").withColumn("run_ts", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/query_result.parquet")
    spark.createDataFrame([("slow",), ("EVEN",), (" edge",), ("short",), (None,)], "filter_name string").write.parquet(f"{tmp_path}/exact_topk_entry.parquet")
    assert {tuple(r) for r in p1_found(spark, str(tmp_path)).collect()} == {("m", "slow"), ("m", "edge")}


def test_a_null_group_is_settled_exactly(spark):
    from tarnfield.llm.percentiles import exact_percentile

    values = spark.createDataFrame([(m, "a", float(i)) for m in (None, "x") for i in range(1, 102)], "run_method string, filter_name string, v double")
    brackets = spark.createDataFrame([(m, "a", 101, 0.0, 200.0) for m in (None, "x")], "run_method string, filter_name string, n bigint, p50_low double, p50_high double")
    got = exact_percentile(values, brackets, ["run_method", "filter_name"], "v", "p50", 1, 2).collect()
    assert {tuple(r) for r in got} == {(None, "a", 51.0), ("x", "a", 51.0)}


def test_more_partitions_than_shuffle_partitions(spark):
    from tarnfield.llm.percentiles import fan_in_rounds

    assert [fan_in_rounds(p, 4) for p in (1, 4, 5, 16, 17, 64, 65)] == [1, 1, 2, 2, 3, 3, 4]
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x")).repartition(70)
    got = {r.g: (r.n, r.p50_low, r.p50_high) for r in percentiles(sketch_groups(df, ["g"], "x", fan_in=4), ["g"], {"p50": (1, 2)}).collect()}
    assert set(got) == {0, 1} and all(n == 2000 and low < 1998 + g <= high for g, (n, low, high) in got.items())
