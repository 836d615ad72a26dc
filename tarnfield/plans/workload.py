"""Relational workload preparation: tenants, grants, temporal buckets, calibration and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.operators.relational import distinct_on, first_reaching, global_running_sum, running_cutoff
from tarnfield.plans.hybrid import valid_at

#: Target shares of the temporal buckets, in hundredths of a percent.
TARGETS_X100 = (20, 50, 100, 200, 500, 1000, 1500, 2000, 2500, 3000, 4000, 5000, 7500, 10000)


def tenant_identity(store: Column, asin: Column) -> Column:
    """Struct (tenant_id, source_kind, source_value): the store if there is one, else the product."""
    name = F.btrim(F.coalesce(store, F.lit("")))
    by_store = F.struct(F.concat(F.lit("store:"), F.md5(name)).alias("tenant_id"), F.lit("store").alias("source_kind"), name.alias("source_value"))
    by_asin = F.struct(F.concat(F.lit("asin:"), F.md5(asin)).alias("tenant_id"), F.lit("asin").alias("source_kind"), asin.alias("source_value"))
    return F.when(name != "", by_store).otherwise(by_asin)


def tenants(source: DataFrame) -> DataFrame:
    """Distinct tenants of a review source (store, parent_asin)."""
    return source.select(tenant_identity(F.col("store"), F.col("parent_asin")).alias("t")).select("t.*", F.lit("derived").alias("policy_kind")).distinct()


def products(source: DataFrame) -> DataFrame:
    """One row per product: the most rated version, named stores first, then by all columns."""
    order = [F.col("item_rating_number").desc(), (F.btrim(F.coalesce("store", F.lit(""))) != "").desc(), F.col("store"), F.col("main_category"), F.col("id")]
    rows = distinct_on(source, ["parent_asin"], order)
    return rows.select("parent_asin", tenant_identity(F.col("store"), F.col("parent_asin"))["tenant_id"].alias("tenant_id"), "store", "main_category", "item_rating_number")


def volumes(facts: DataFrame) -> DataFrame:
    """(tenant_id, review_count)."""
    return facts.groupBy("tenant_id").agg(F.count("*").alias("review_count"))


def grants(facts: DataFrame, principal: str, percent_x100: int, *, start: int = 1) -> DataFrame:
    """Grants that cover at least the share of facts: the largest tenants (then by id) while the facts of those
    before are fewer than the target."""
    chosen = running_cutoff(volumes(facts), "review_count", [F.col("review_count").desc(), F.col("tenant_id")], percent_x100)
    return chosen.select(
        F.lit(principal).alias("principal_name"), "tenant_id", F.lit(True).alias("can_read"), F.lit(start).cast("bigint").alias("valid_from"),
        F.lit(None).cast("bigint").alias("valid_to"), F.lit("coverage").alias("policy_kind"), "review_count", "cumulative",
    )


def visible(facts: DataFrame, grants: DataFrame, principal: str) -> DataFrame:
    """Facts whose tenant the principal may read."""
    mine = grants.where((F.col("principal_name") == principal) & F.col("can_read")).select("tenant_id")
    return facts.join(mine, "tenant_id", "left_semi")


def temporal_buckets(seen: DataFrame, targets_x100=TARGETS_X100) -> DataFrame:
    """Per target share the smallest timestamp by which that many visible facts exist.

    (target_x100, acl_visible_count, target_count, as_of, achieved_count, achieved_pct). Facts are counted per
    timestamp before the running sum, so ties belong together; the ceiling is integer arithmetic.
    """
    spark = seen.sparkSession
    per_ts = seen.groupBy("valid_from").agg(F.count("*").alias("n"))
    steps = global_running_sum(per_ts, [F.col("valid_from").asc()], "n", "achieved_count").select(F.col("valid_from").alias("as_of"), "n", F.col("achieved_count").cast("bigint").alias("achieved_count"))
    total = seen.agg(F.count("*").alias("acl_visible_count"))
    want = spark.createDataFrame([(t,) for t in targets_x100], "target_x100 int").crossJoin(total)
    want = want.withColumn("target_count", F.greatest(F.lit(1), F.expr("(acl_visible_count * target_x100 + 9999) div 10000")))
    rows = first_reaching(steps, want, "achieved_count", "n", "target_count")
    pct = (F.col("achieved_count").cast("decimal(20,0)") * 100 / F.col("acl_visible_count").cast("decimal(20,0)")).cast("decimal(12,8)")
    return rows.withColumn("achieved_pct", pct)


def grant_validity(granted: DataFrame, facts: DataFrame, as_of: int, later: int, percent_x100: int) -> DataFrame:
    """Grants recalibrated so that, at ``as_of``, only the smallest tenants up to the share are active; the others
    start at ``later``."""
    per = volumes(facts).join(granted.select("tenant_id"), "tenant_id", "left_semi")
    active = running_cutoff(per, "review_count", [F.col("review_count"), F.col("tenant_id")], percent_x100).select("tenant_id", F.lit(True).alias("active"))
    rows = granted.join(active, "tenant_id", "left")
    return rows.withColumn("valid_from", F.when(F.col("active"), F.least("valid_from", F.lit(as_of))).otherwise(F.lit(later)).cast("bigint")).drop("active")


def populations(facts: DataFrame, granted: DataFrame, principal: str, as_of: int) -> DataFrame:
    """(total, acl_only, grant_valid, fact_valid): the nested populations of the three workloads, in one pass."""
    mine = granted.where(F.col("principal_name") == principal).select("tenant_id", F.col("valid_from").alias("g_from"), F.col("valid_to").alias("g_to"), F.lit(True).alias("g"))
    rows = facts.join(mine, "tenant_id", "left")
    g = F.coalesce(F.col("g"), F.lit(False))
    gv = g & F.coalesce(valid_at(as_of, "g_from", "g_to"), F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.count_if(g).alias("acl_only"), F.count_if(gv).alias("grant_valid"), F.count_if(gv & valid_at(as_of)).alias("fact_valid"))


def check_populations(total: int, acl: int, valid: int) -> None:
    """The workloads must differ: total > visible > valid > 0."""
    if not total > acl > valid > 0:
        raise ValueError(f"populations do not differ: total {total}, visible {acl}, valid {valid}")


def within_target(achieved_pct: float, target_pct: float, tolerance: float = 0.1) -> bool:
    """Whether a share is within the tolerance (percentage points) of its target."""
    return abs(achieved_pct - target_pct) <= tolerance


def staging_problems(source: DataFrame) -> DataFrame:
    """(problem, rows): null keys, repeated ids, and products whose rows disagree on their category."""
    nulls = source.agg(F.count_if(F.col("id").isNull()).alias("null_id"), F.count_if(F.col("parent_asin").isNull()).alias("null_product"), F.count_if(F.col("timestamp").isNull() | (F.col("timestamp") <= 0)).alias("bad_timestamp"))
    one = nulls.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).alias("rows")) for c in nulls.columns))).alias("x")).select("x.*")
    dup = source.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("repeated_id").alias("problem"), F.count("*").alias("rows"))
    odd = source.groupBy("parent_asin").agg(F.countDistinct("main_category").alias("n")).where("n > 1").agg(F.lit("inconsistent_product").alias("problem"), F.count("*").alias("rows"))
    return one.unionByName(dup).unionByName(odd)


def visibility_probe(facts: DataFrame, granted: DataFrame, principal: str) -> DataFrame:
    """(visible_id, hidden_id): the smallest id the principal sees and the smallest it does not."""
    mine = granted.where((F.col("principal_name") == principal) & F.col("can_read")).select("tenant_id", F.lit(True).alias("seen"))
    rows = facts.join(mine, "tenant_id", "left")
    return rows.agg(F.min(F.when(F.col("seen"), F.col("review_id"))).alias("visible_id"), F.min(F.when(F.col("seen").isNull(), F.col("review_id"))).alias("hidden_id"))
