"""Relational operators composed from built-in ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.session import stored


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in range partitions of the order, sorted inside, with the number of the partition and the place in it;
    written once, so that both passes over it see the same partitions."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(rows.select("*", F.spark_partition_id().alias("__part"), place.alias("__place")), "ranged")


def global_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the 0-based place of each row in the complete order of the table, without a single-partition window: places
    inside range partitions plus the rows of the partitions before (one small row per partition)."""
    rows = _ranged(df, order)
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__part").agg((F.max("__place") + 1).alias("n")).select("__part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__place")).alias(name))


def global_running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to and including each row in the complete order, in the same way."""
    rows = _ranged(df, order)
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__part").agg(F.sum(value).alias("n")).select("__part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    return rows.withColumn(name, F.sum(value).over(inside)).join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col(name)).alias(name))


def keyed_running(df: DataFrame, key: list[str], order: list[str], *, sums: dict[str, Column] | None = None, lags: dict[str, str] | None = None) -> DataFrame:
    """Running values of each key in the order of ``order``, without one task per key.

    ``sums`` adds, per name, the sum of an expression over the earlier rows of the key (null for the first row), ``lags``
    the value of a column in the row before (null for the first). Rows lie in range partitions of (key, order), so a key
    that holds a third of them spans many; what the earlier partitions of a key add up to is carried in, at most one
    row per partition, as only the key that goes on over its edge needs one. Null keys are a key.
    """
    sums, lags = sums or {}, lags or {}
    rows = _ranged(df.select("*", *(e.alias(f"__s_{n}") for n, e in sums.items())), [*(F.col(k).asc() for k in key), *(F.col(o).asc() for o in order)])
    inside = Window.partitionBy("__part", *key).orderBy("__place")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.max_by(F.struct(F.col(c).alias("v")), "__place").alias(f"__l_{n}") for n, c in lags.items()}
    total = rows.groupBy("__part", *key).agg(*(F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums), *last.values())
    earlier = Window.partitionBy(*key).orderBy("__part")
    carried = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(
        F.col("__part").alias("__p"), *(F.col(k).alias(f"__k_{i}") for i, k in enumerate(key)), F.row_number().over(earlier).alias("__n"),
        *(F.sum(f"__t_{n}").over(carried).alias(f"__c_{n}") for n in sums), *(F.lag(f"__l_{n}").over(earlier).alias(f"__b_{n}") for n in lags),
    ).where("__n > 1")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    own = rows.select("*", *(F.sum(f"__s_{n}").over(before).alias(f"__o_{n}") for n in sums), *(F.lag(F.struct(F.col(c).alias("v"))).over(inside).alias(f"__w_{n}") for n, c in lags.items()))
    out = own.join(F.broadcast(carry), same, "left")  # at most one row per partition
    both = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + F.col(b))
    return out.select(*df.columns, *(both(f"__o_{n}", f"__c_{n}").alias(n) for n in sums), *(F.coalesce(f"__w_{n}", f"__b_{n}")["v"].alias(n) for n in lags))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in a complete order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def running_cutoff(df: DataFrame, amount: str, order: list[Column], percent_x100: int) -> DataFrame:
    """Rows, in order, while the amount before them is less than ceil(total * percent / 100); adds ``cumulative``.

    The percentage comes as an integer of hundredths, so the ceiling is exact.
    """
    total = df.agg(F.sum(amount).alias("__total"))
    rows = global_running_sum(df, order, amount, "cumulative").withColumn("cumulative", F.col("cumulative").cast("bigint"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    need = F.expr(f"(__total * {percent_x100} + 9999) div 10000")
    return rows.where(F.col("cumulative") - F.col(amount) < need).drop("__total")


def first_reaching(steps: DataFrame, targets: DataFrame, cumulative: str, step: str, target: str) -> DataFrame:
    """Per target the step at which the cumulative value reaches it: what was summed up before it is less than the
    target, so exactly one step fits. The targets are a parameter (few rows) and are broadcast; the steps stay where
    they are."""
    c, t = F.col(cumulative), F.col(target)
    return steps.join(F.broadcast(targets), (c >= t) & (c - F.col(step) < t)).select(*targets.columns, *(x for x in steps.columns if x != step))


def two_key_lookup(rows: DataFrame, table: DataFrame, first: list[str], fallback: list[str], value: str) -> DataFrame:
    """Smallest ``value`` of the table for the full key, else for the fallback key; adds ``match_type``."""
    full = table.groupBy(*first).agg(F.min(value).alias(value))
    part = table.groupBy(*fallback).agg(F.min(value).alias(value))
    hit = rows.join(full, first).withColumn("match_type", F.lit("full"))
    rest = rows.join(full.select(*first), first, "left_anti").join(part, fallback).withColumn("match_type", F.lit("fallback"))
    return hit.unionByName(rest)


def last_write_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Shards one after the other; of equal keys the row of the last shard stays."""
    rows = reduce(DataFrame.unionByName, (p.withColumn("__shard", F.lit(i)) for i, p in enumerate(parts)))
    columns = [c for c in rows.columns if c != "__shard"]
    return distinct_on(rows, keys, [F.col("__shard").desc(), *(F.col(c) for c in columns)]).drop("__shard")


def whole_row_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ in any column, or exist on one side only."""
    x = a.select(*keys, F.struct(*a.columns).alias("__a"))
    y = b.select(*keys, F.struct(*a.columns).alias("__b"))
    return x.join(y, keys, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*keys)


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both measurements of each key, complete pairs only: (keys, baseline, method)."""
    return a.select(*keys, F.col(value).alias("baseline")).join(b.select(*keys, F.col(value).alias("method")), keys)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
    """UPDATE ... FROM as a new version: ``changes`` may use the columns of both; rows without a match stay."""
    src = source.withColumn("__hit", F.lit(True))
    rows = target.join(src, keys, "left")
    kept = [F.when(F.col("__hit"), changes[c]).otherwise(target[c]).alias(c) if c in changes else F.col(c) if c in keys else target[c] for c in target.columns]
    return rows.select(*kept)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE as a new version."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def run_lengths(df: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """Runs of equal neighbours and distinct values per group: how often a scan in this order changes its page."""
    rows = keyed_running(df, group, order, sums={"__seen": F.lit(1)}, lags={"__before": value})
    new = F.when(F.col("__before").eqNullSafe(F.col(value)) & F.col("__seen").isNotNull(), 0).otherwise(1)
    return rows.withColumn("__new", new).groupBy(*group).agg(F.count("*").alias("rows"), F.sum("__new").alias("runs"), F.countDistinct(value).alias("pages"))


def reuse_distance(df: DataFrame, key: str, order: str) -> DataFrame:
    """Requests since the last one with the same key; null for the first."""
    rows = keyed_running(df, [key], [order], lags={"__before": order})
    return rows.withColumn("reuse_distance", F.col(order) - F.col("__before")).drop("__before")


def running_choice(df: DataFrame, key: str, order: str, a: str, b: str, least: int) -> DataFrame:
    """Route of each request from the means of the earlier ones of its key: 'b' if at least ``least`` were seen and
    the mean of b is smaller, else 'a'."""
    has = lambda c: F.col(c).isNotNull().cast("int")
    rows = keyed_running(df, [key], [order], sums={"__n": F.lit(1), "__a": F.col(a), "__b": F.col(b), "__na": has(a), "__nb": has(b)})
    better = (F.col("__n") >= least) & (F.col("__b") / F.nullif("__nb", F.lit(0)) < F.col("__a") / F.nullif("__na", F.lit(0)))
    return rows.withColumn("route", F.when(better, "b").otherwise("a")).drop("__n", "__a", "__b", "__na", "__nb")


def break_even(df: DataFrame, group: list[str], order: str, saving: str) -> DataFrame:
    """First request from which the cumulative saving stays at or above zero; null if there is none: the first one
    after the last request that leaves it below zero."""
    rows = keyed_running(df, group, [order], sums={"__before": F.col(saving)})
    rows = stored(rows.select(*group, order, (F.coalesce("__before", F.lit(0)) + F.coalesce(saving, F.lit(0)) < 0).alias("__below")), "savings")
    last = rows.groupBy(*group).agg(F.max(F.when(F.col("__below"), F.col(order))).alias("__last"))
    names = {g: f"__g{i}" for i, g in enumerate(group)}
    same = F.lit(True)
    for g, r in names.items():
        same = same & F.col(g).eqNullSafe(F.col(r))
    after = rows.join(last.select(*(F.col(g).alias(r) for g, r in names.items()), "__last"), same)
    return after.groupBy(*group).agg(F.min(F.when(F.col("__last").isNull() | (F.col(order) > F.col("__last")), F.col(order))).alias("break_even"))


def even_sample(df: DataFrame, column: str, n: int) -> DataFrame:
    """n evenly spaced rows of the order of ``column``: positions floor(i (rows - 1) / (n - 1))."""
    rows = global_position(df.select(column), [F.col(column).asc()], "__pos")
    total = df.count()
    n = min(n, total)
    want = sorted({i * (total - 1) // max(n - 1, 1) for i in range(n)})
    return rows.where(F.col("__pos").isin(want)).select(column)


def label_pair_unions(df: DataFrame, record: str, labels: str, top: int) -> DataFrame:
    """|A or B| of each pair of the ``top`` most frequent labels, by inclusion and exclusion."""
    tokens = df.select(record, F.explode(F.array_distinct(labels)).alias("label"))
    counts = tokens.groupBy("label").agg(F.count("*").alias("n"))
    heads = counts.orderBy(F.col("n").desc(), "label").limit(top)  # a top-k by definition, so small
    kept = tokens.join(F.broadcast(heads), "label").groupBy(record).agg(F.array_sort(F.collect_list("label")).alias("l"))
    both = kept.select(F.explode("l").alias("label_a"), "l").select("label_a", F.explode("l").alias("label_b")).where("label_a < label_b").groupBy("label_a", "label_b").agg(F.count("*").alias("n_both"))
    a, b = heads.select(F.col("label").alias("label_a"), F.col("n").alias("n_a")), heads.select(F.col("label").alias("label_b"), F.col("n").alias("n_b"))
    pairs = a.crossJoin(b).where("label_a < label_b").join(both, ["label_a", "label_b"], "left")  # top x top
    return pairs.select("label_a", "label_b", (F.col("n_a") + F.col("n_b") - F.coalesce("n_both", F.lit(0))).alias("union_size"))


def combine_shards(parts: list[DataFrame], keys: list[str], expected: DataFrame) -> DataFrame:
    """All shards as one table, or an error: every expected key must occur exactly once, and no other key at all."""
    rows = reduce(DataFrame.unionByName, parts)
    seen = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    both = expected.select(*keys).withColumn("__want", F.lit(1)).join(seen, keys, "full_outer")
    found = both.agg(F.count_if(F.col("__n").isNull()).alias("missing"), F.count_if(F.col("__want").isNull()).alias("foreign"), F.count_if(F.col("__n") > 1).alias("repeated")).first()
    if found.missing or found.foreign or found.repeated:
        raise ValueError(f"shards do not fit: {found.missing} missing, {found.foreign} foreign, {found.repeated} repeated keys")
    return rows
