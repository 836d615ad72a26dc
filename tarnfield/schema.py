"""Declared schemas, header and dimension checks, and constraint checks (Spark has no keys of its own)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "timestamp": T.TimestampType(),
    "array<float>": VECTOR, "array<int>": T.ArrayType(T.IntegerType()), "decimal(5,2)": T.DecimalType(5, 2), "decimal(12,8)": T.DecimalType(12, 8),
}


def _schema(text: str) -> T.StructType:
    """Schema from "name type" pairs, without a session."""
    return T.StructType([T.StructField(*((n := x.split(" "))[0], _TYPES[n[1]])) for x in text.split(", ")])


#: Column names and types of the tables the engine reads.
VECTOR_TABLE = _schema(
    "id bigint, rating double, verified_purchase boolean, helpful_vote int, review_text_len int, main_category string, "
    "price double, has_price boolean, item_rating_number int, embedding array<float>"
)
REVIEW_CSV = _schema(
    "id bigint, user_id string, parent_asin string, rating double, timestamp bigint, verified_purchase boolean, "
    "helpful_vote int, review_text_len int, store string, main_category string, category_id int, price double, "
    "has_price boolean, item_avg_rating double, item_rating_number int"
)
TENANTS = _schema("tenant_id string, source_kind string, source_value string, policy_kind string")
PRODUCT_DIM = _schema("parent_asin string, tenant_id string, store string, main_category string, item_rating_number int")
REVIEW_FACTS = _schema("review_id bigint, user_id string, parent_asin string, valid_from bigint, valid_to bigint")
GRANTS = _schema("principal_name string, tenant_id string, can_read boolean, valid_from bigint, valid_to bigint, policy_kind string")
BUCKETS = _schema(
    "principal_name string, target_pct decimal(5,2), as_of bigint, acl_visible_count bigint, target_count bigint, "
    "achieved_count bigint, achieved_pct decimal(12,8)"
)
RELATION_VERSION = _schema("relation_name string, version bigint, updated_at timestamp")
TAG_TABLE = _schema("id bigint, embedding array<float>, tags array<int>, tag_count int")
LABEL_TABLE = _schema("id int, embedding array<float>, width int, labels array<int>, label_count int")


def check_header(found: list[str], schema: T.StructType) -> None:
    """Fail unless the header is exactly the declared one, in its order."""
    if found != schema.names:
        raise ValueError(f"header {found} is not the declared {schema.names}")


def with_dimension(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fails at run time on a vector of another length; null vectors pass."""
    wrong = F.raise_error(F.concat(F.lit(f"{column} must have {dim} elements, has "), F.size(column).cast("string")))
    return df.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == dim), F.col(column)).otherwise(wrong))


def violations(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """(rule, rows): how many rows break each rule (a null outcome breaks it too); one pass, plus one for uniqueness."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("rows")) for k in rules))
    out = counts.select(F.explode(pairs).alias("x")).select("x.*")
    if unique:
        again = df.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(again.agg(F.lit("unique").alias("rule"), F.count("*").alias("rows")))
    return out


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose non-null ``column`` has no ``key`` in ``parent``."""
    keys = parent.select(F.col(key).alias("__key")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")
