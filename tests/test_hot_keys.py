from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnfield.operators.treeagg import clean_category, heavy_keys, tree_aggregate
from tarnfield.plans.hot_keys import p7_found


def test_tree_aggregate_equals_group_by_under_skew(spark):
    rows = [(i % 7 if i % 3 else 0, float(i), i % 2 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v double, b boolean").repartition(37)
    got = tree_aggregate(df, ["k"], {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "any": ("bool_or", F.col("b"))}, fan_in=3, chunk_rows=16)
    want = df.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_or("b").alias("any"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_group_of_a_round_has_more_partials_than_the_fan_in(spark):
    """More input partitions than shuffle partitions: every merge after the first reads at most fan_in rows a key."""
    df = spark.range(6000, numPartitions=90).withColumn("k", F.lit("hot"))
    plan = tree_aggregate(df, ["k"], {"n": ("count", F.col("id"))}, fan_in=4)
    assert [tuple(r) for r in plan.collect()] == [("hot", 6000)]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [") == 4  # 90 states: 23, 6, 2, 1


def test_tree_aggregate_nulls_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 1.0, 5, 6), (None, None, 5, 6), ("x", None, 5, 6)], "k string, v double, chunk int, k0 int")
    got = {r.k: (r.n, r.s) for r in tree_aggregate(df, ["k"], {"n": ("count", F.col("v")), "s": ("sum", F.col("v"))}).collect()}
    assert got == {None: (1, 1.0), "x": (0, None)}
    assert tree_aggregate(df.limit(0), ["k"], {"n": ("count", F.col("v"))}).count() == 0
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {"n": ("median", F.col("v"))})


def test_heavy_keys_threshold_is_strict(spark):
    df = spark.createDataFrame([("a", 5), ("b", 95)], "k string, n bigint")
    assert {r.k for r in heavy_keys(df, "k", "n", share=0.05).collect()} == {"b"}


def test_clean_category(spark):
    df = spark.createDataFrame([(" Health &amp;  Care\t",), ("  ",), (None,), ("A B",)], "c string")
    assert [r[0] for r in df.select(clean_category(F.col("c"))).collect()] == ["health & care", None, None, "a b"]


def test_p7_found_small(spark, tmp_path):
    cats = ["Food"] * 30 + [" food "] * 10 + ["x%d" % i for i in range(60)] + [None, "", "  "]
    a = [(i, c, 4.0) for i, c in enumerate(cats)] + [(0, "FOOD", 5.0)] * 50  # one id delivered again and again
    tags = [(i, [1, 1, -1, None, 100 + i % 40]) for i in range(80)] + [(0, [1, 1])] * 30 + [(200, None), (201, [])]
    spark.createDataFrame(a, "id bigint, main_category string, rating double").write.parquet(f"{tmp_path}/amazon_grocery_reviews_10m_pgvector.parquet")
    spark.createDataFrame(tags, "id bigint, tags array<int>").write.parquet(f"{tmp_path}/yfcc_tags.parquet")
    got = {tuple(r) for r in p7_found(spark, str(tmp_path)).collect()}
    n = Counter(t for i in range(80) for t in {1, 100 + i % 40})
    total = sum(n.values())
    assert got == {("main_category", "food")} | {("tags", str(t)) for t, c in n.items() if c > 0.05 * total}
