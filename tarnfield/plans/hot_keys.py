"""Queries on hot keys (problem 7): categories and tags that hold much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.operators.treeagg import clean_category, heavy_keys, tree_aggregate
from tarnfield.session import load

AMAZON, YFCC = "amazon_grocery_reviews_10m_pgvector", "yfcc_tags"


def category_members(spark: SparkSession, d: str) -> DataFrame:
    """One row per id with a category (rows of one id agree on it; should they not, the smallest name counts)."""
    rows = load(spark, d, AMAZON).select("id", clean_category(F.col("main_category")).alias("key_value"), "rating")
    rows = rows.where(F.col("id").isNotNull() & F.col("key_value").isNotNull())
    return rows.groupBy("id").agg(F.min("key_value").alias("key_value"), F.max("rating").alias("rating"))


def tag_members(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (id, tag) pairs; null and -1 are no tags. Lists are made distinct in the row before the shuffle."""
    rows = load(spark, d, YFCC).where(F.col("id").isNotNull()).select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    return rows.where(F.col("tag") != -1).dropDuplicates(["id", "tag"])


def value_counts(spark: SparkSession, d: str, fan_in: int = 16) -> tuple[DataFrame, DataFrame]:
    cats = tree_aggregate(
        category_members(spark, d),
        ["key_value"],
        {"n": ("count", F.col("id")), "rating_sum": ("sum", F.col("rating")), "rating_n": ("count", F.col("rating"))},
        fan_in=fan_in,
    )
    tags = tree_aggregate(tag_members(spark, d), ["tag"], {"n": ("count", F.col("id"))}, fan_in=fan_in)
    return cats, tags


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    cats, tags = value_counts(spark, d)
    cat = heavy_keys(cats, "key_value", "n", share=0.05).select(F.lit("main_category").alias("field"), "key_value")
    tag = heavy_keys(tags, "tag", "n", share=0.05).select(
        F.lit("tags").alias("field"), F.col("tag").cast("string").alias("key_value")
    )
    return cat.unionByName(tag)


def p7_per_category(spark: SparkSession, d: str) -> DataFrame:
    """Per-category results without imbalance: reviews and mean rating of every category."""
    cats, _ = value_counts(spark, d)
    return cats.select("key_value", "n", F.round(F.col("rating_sum") / F.col("rating_n"), 9).alias("mean_rating"))


_CAT_SQL = """
SELECT id, min(c) AS key_value, max(rating) AS rating FROM (
  SELECT id, rating, trim(regexp_replace(replace(lower(main_category), '&amp;', '&'), '\\s+', ' ', 'g')) AS c
  FROM amazon_grocery_reviews_10m_pgvector) WHERE c <> '' AND id IS NOT NULL GROUP BY id"""

SQL = {
    "p7_found": f"""
WITH cat AS ({_CAT_SQL}), tag AS (SELECT DISTINCT id, unnest(tags) AS t FROM yfcc_tags),
     ok AS (SELECT id, t FROM tag WHERE t <> -1 AND id IS NOT NULL)
SELECT 'main_category' AS field, key_value FROM cat GROUP BY key_value
HAVING count(*) > 0.05 * (SELECT count(*) FROM cat)
UNION ALL
SELECT 'tags' AS field, CAST(t AS VARCHAR) AS key_value FROM ok GROUP BY t
HAVING count(*) > 0.05 * (SELECT count(*) FROM ok)""",
    "p7_per_category": f"""
SELECT key_value, count(*) AS n, round(sum(rating) / count(rating), 9) AS mean_rating
FROM ({_CAT_SQL}) GROUP BY key_value""",
}

QUERIES = {"p7_found": p7_found, "p7_per_category": p7_per_category}
