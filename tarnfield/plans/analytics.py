"""Registered queries: aggregation, windows, workload preparation, statistics, text, layout and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions import stats as S
from tarnfield.functions import text as X
from tarnfield.functions import vector as V
from tarnfield.operators import predicate as P
from tarnfield.operators import relational as R
from tarnfield.operators import topk as K
from tarnfield.operators.bloom import bitmap_count, build_bloom, id_bitmap, may_contain
from tarnfield.plans import hybrid as H
from tarnfield.plans import layout as L
from tarnfield.plans import router
from tarnfield.plans import workload as W
from tarnfield.plans.queries import _B, _F, _G, _V, COVER_X100, PRINCIPAL, TREES, grants, l2sql, query_set, sqsql, vector_of
from tarnfield.session import load, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# ---------------------------------------------------------------- aggregation


@query("""SELECT c_mktsegment, count(*) AS customers, count(*) FILTER (c_acctbal < 0) AS debtors, count(DISTINCT c_nationkey) AS nations,
count(DISTINCT (c_nationkey, c_acctbal > 0)) AS pairs, min(c_acctbal) AS least, max(c_acctbal) AS most, min(c_custkey) FILTER (c_acctbal > 9000) AS first_rich, bool_and(c_acctbal > -1000) AS all_above FROM customer GROUP BY 1""")
def filtered_aggregates(spark, d):
    c = load(spark, d, "customer")
    return c.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("debtors"), F.countDistinct("c_nationkey").alias("nations"),
        F.countDistinct("c_nationkey", F.col("c_acctbal") > 0).alias("pairs"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"),
        F.min(F.when(F.col("c_acctbal") > 9000, F.col("c_custkey"))).alias("first_rich"), F.bool_and(F.col("c_acctbal") > -1000).alias("all_above"),
    )


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15 AND count(DISTINCT o_orderstatus) > 1")
def having_duplicates(spark, d):
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("kinds"))
    return o.where("n > 15 AND kinds > 1").select("o_custkey", "n")


@query("""SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY l_quantity, l_linenumber), ',') AS lines,
md5(string_agg(CAST(l_linenumber AS VARCHAR), '|' ORDER BY l_linenumber)) AS digest, sha256(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS parts FROM lineitem GROUP BY 1""")
def ordered_aggregates(spark, d):
    """Ordered arrays and digests; a group is one order, so its lists are short."""
    from tarnfield.functions.arrays import ordered_array

    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        ordered_array("l_linenumber", "l_quantity").alias("lines"), F.array_sort(F.collect_list("l_linenumber")).alias("l"), S.ordered_digest("l_partkey").alias("parts")
    )
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    return rows.select("l_orderkey", F.array_join(text("lines"), ",").alias("lines"), F.md5(F.array_join(text("l"), "|").cast("binary")).alias("digest"), "parts")


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1")
def percentile_disc(spark, d):
    rows = load(spark, d, "lineitem")
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY l_quantity)")
    return rows.groupBy("l_returnflag").agg(disc(0.5).alias("p50"), disc(0.99).alias("p99"))


@query("""WITH s AS (SELECT l_suppkey AS k, list_sort(list(l_extendedprice)) AS a, quantile_cont(l_extendedprice, 0.95) AS linear FROM lineitem GROUP BY 1)
SELECT k, a[CAST(floor(0.95 * (len(a) - 1)) AS BIGINT) + 1] AS floor_rule, a[greatest(CAST(ceil(0.95 * len(a)) AS BIGINT), 1)] AS nearest_rule, round(linear, 6) AS linear_rule,
a[greatest(CAST(floor(0.95 * len(a)) AS BIGINT), 1)] AS truncated_rule FROM s""")
def percentile_rules(spark, d):
    """Four percentile rules side by side."""
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_extendedprice")
    out = S.group_percentiles(rows, ["k"], "l_extendedprice", {f"{r}_rule": (r, 0.95) for r in ("floor", "nearest", "linear", "truncated")})
    return out.withColumn("linear_rule", F.round("linear_rule", 6))


@query("""WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
p(name, pct) AS (VALUES ('top_1', 0.99), ('top_10', 0.9), ('half', 0.5))
SELECT name, x AS threshold FROM p JOIN r ON i = CAST(round_even(pct * (n - 1), 0) AS BIGINT)""")
def score_thresholds(spark, d):
    """Threshold catalog: nearest-rank quantiles of a score, by its place in the complete order."""
    o = load(spark, d, "orders").select("o_totalprice", "o_orderkey")
    shares = spark.createDataFrame([("top_1", 0.99), ("top_10", 0.9), ("half", 0.5)], "name string, share double")
    want = shares.crossJoin(o.agg(F.count("*").alias("n"))).select("name", F.bround(F.col("share") * (F.col("n") - 1)).cast("bigint").alias("position"))  # three rows
    rows = R.global_position(o, [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()])
    return rows.join(F.broadcast(want), "position").select("name", F.col("o_totalprice").alias("threshold"))


@query("SELECT count(DISTINCT o_orderkey) AS ids, count(DISTINCT o_orderkey // 32768) AS buckets FROM orders WHERE o_totalprice < 100000")
def bitmap_build(spark, d):
    """Packed bitmap of an allow-list, counted."""
    b = id_bitmap(load(spark, d, "orders").where("o_totalprice < 100000"), "o_orderkey")
    return bitmap_count(b).crossJoin(b.agg(F.count("*").alias("buckets"))).select(F.col("ids").cast("bigint").alias("ids"), "buckets")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 60000 AND o_orderpriority = '1-URGENT'")
def bloom_prefilter(spark, d):
    """Bloom test, then the exact predicate."""
    o = load(spark, d, "orders")
    bloom = build_bloom(o.where("o_totalprice < 60000"), "o_orderkey")
    return o.where(may_contain(bloom, "o_orderkey")).where("o_totalprice < 60000 AND o_orderpriority = '1-URGENT'").select("o_orderkey")


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS stdev,
count(*) FILTER (value IS NULL) AS errors FROM events GROUP BY 1""")
def group_summary(spark, d):
    e = load(spark, d, "events").groupBy("event_type").agg(*S.summary("value"), F.count_if(F.col("value").isNull()).alias("errors"))
    return e.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "stdev")), "errors")


@query("SELECT event_type, count(*) AS users, round(avg(m), 6) AS mean_of_means FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def two_level_mean(spark, d):
    per = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return per.groupBy("event_type").agg(F.count("*").alias("users"), F.round(F.avg("m"), 6).alias("mean_of_means"))


@query()
def bootstrap_intervals(spark, d):
    """Seeded bootstrap of per-user means, per event type."""
    per = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return S.bootstrap_groups(per, ["event_type"], "m", ["user_id"], seed=11)


@query("""WITH b AS (SELECT CASE WHEN l_discount < 0.02 THEN 'low' WHEN l_discount < 0.06 THEN 'mid' ELSE 'high' END AS band, l_returnflag, l_quantity FROM lineitem)
SELECT band, round(avg(l_quantity) FILTER (l_returnflag = 'A') / avg(l_quantity) FILTER (l_returnflag = 'N'), 9) AS ratio FROM b GROUP BY 1""")
def band_ratios(spark, d):
    band = F.when(F.col("l_discount") < 0.02, "low").when(F.col("l_discount") < 0.06, "mid").otherwise("high")
    of = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return load(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.round(of("A") / of("N"), 9).alias("ratio"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS requests, count(*) AS unique_keys, round(1 - count(*) / sum(n), 9) AS duplicate_ratio, max(n) AS largest FROM g""")
def cacheability(spark, d):
    g = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("requests"), F.count("*").alias("unique_keys"), F.round(1 - F.count("*") / F.sum("n"), 9).alias("duplicate_ratio"), F.max("n").alias("largest"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def most_common(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(10)


@query("SELECT o_custkey, count(*) AS rows, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS ids FROM orders GROUP BY 1")
def id_fingerprint(spark, d):
    """Digest of the sorted ids of each group."""
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("rows"), S.ordered_digest("o_orderkey").alias("ids"))


# ---------------------------------------------------------------- windows over request traces

_REQ = "req AS (SELECT event_type AS k, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS request_no, value FROM events)"


def requests(spark, d) -> DataFrame:
    """The request trace, numbered through in its order."""
    rows = R.global_position(load(spark, d, "events").select("ts", "event_id", "event_type", "value"), [F.col("ts").asc(), F.col("event_id").asc()])
    return rows.select(F.col("event_type").alias("k"), (F.col("position") + 1).alias("request_no"), "value")


@query(f"WITH {_REQ} SELECT request_no, k, request_no - lag(request_no) OVER (PARTITION BY k ORDER BY request_no) AS reuse_distance, CAST((request_no - 1) // 100 AS BIGINT) AS window_no FROM req")
def reuse_distances(spark, d):
    rows = R.reuse_distance(requests(spark, d), "k", "request_no")
    return rows.select("request_no", "k", "reuse_distance", F.floor((F.col("request_no") - 1) / 100).cast("bigint").alias("window_no"))


@query(f"""WITH {_REQ}, m AS (SELECT *, count(*) OVER w AS seen, avg(value) OVER w AS a, avg(50.0 - value / 2) OVER w AS b FROM req WINDOW w AS (PARTITION BY k ORDER BY request_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT request_no, CASE WHEN seen >= 3 AND b < a THEN 'b' ELSE 'a' END AS route FROM m""")
def running_route(spark, d):
    rows = requests(spark, d).withColumn("alt", F.lit(50.0) - F.col("value") / 2)
    return R.running_choice(rows, "k", "request_no", "value", "alt", 3).select("request_no", "route")


@query(f"""WITH {_REQ}, s AS (SELECT k, request_no, sum(round(value * 100)::BIGINT - 4000) OVER (PARTITION BY k ORDER BY request_no ROWS UNBOUNDED PRECEDING) AS c FROM req),
m AS (SELECT *, min(c) OVER (PARTITION BY k ORDER BY request_no DESC ROWS UNBOUNDED PRECEDING) AS l FROM s) SELECT k, min(request_no) FILTER (l >= 0) AS break_even FROM m GROUP BY k""")
def break_even(spark, d):
    rows = requests(spark, d).withColumn("saving", F.round(F.col("value") * 100).cast("bigint") - 4000)
    return R.break_even(rows, ["k"], "request_no", "saving")


@query(f"WITH {_REQ}, n AS (SELECT k, request_no, CASE WHEN lag(request_no // 64) OVER (PARTITION BY k ORDER BY request_no) = request_no // 64 THEN 0 ELSE 1 END AS c FROM req) SELECT k, count(*) AS rows, CAST(sum(c) AS BIGINT) AS runs, count(DISTINCT request_no // 64) AS pages FROM n GROUP BY k")
def page_runs(spark, d):
    """Locality: page changes and distinct pages of each key's accesses in their order."""
    return R.run_lengths(requests(spark, d).withColumn("page", F.floor(F.col("request_no") / 64)), ["k"], "page", ["request_no"])


@query("""SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_acctbal > 5000) DESC, c_mktsegment, c_acctbal DESC, c_custkey) = 1""")
def distinct_on(spark, d):
    rows = R.distinct_on(load(spark, d, "customer"), ["c_nationkey"], [(F.col("c_acctbal") > 5000).desc(), F.col("c_mktsegment"), F.col("c_acctbal").desc(), F.col("c_custkey")])
    return rows.select("c_nationkey", "c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 25 OFFSET 50")
def md5_shuffle(spark, d):
    """A page of a deterministic shuffle."""
    return load(spark, d, "orders").select("o_orderkey").orderBy(X.shuffle_key("o_orderkey")).offset(50).limit(25)


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE p IN (SELECT i * (n - 1) // 9 FROM generate_series(0, 9) t(i))")
def even_sample(spark, d):
    return R.even_sample(load(spark, d, "orders"), "o_orderkey", 10)


@query("""SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7, vec_id) AS rn FROM embeddings WHERE vec_id % 7 >= 2) WHERE rn = 1""")
def config_choice(spark, d):
    """Lowest latency among the configurations that reach the recall, per filter."""
    rows = load(spark, d, "embeddings").select("label", "vec_id", (F.col("vec_id") % 7).cast("double").alias("recall"), (F.col("vec_id") % 7).alias("latency"), F.col("vec_id").alias("config"))
    return router.select_config(rows, 2.0, ["label"]).select("label", "vec_id")


@query("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def set_algebra(spark, d):
    o = load(spark, d, "orders")
    a, b, c = (o.where(w).select(F.col("o_orderkey").alias("k")) for w in ("o_totalprice > 100000", "o_orderstatus = 'F'", "o_orderpriority = '5-LOW'"))
    return a.intersect(b).subtract(c)


# ---------------------------------------------------------------- workload preparation


@query("SELECT DISTINCT CASE WHEN length(p_brand) % 2 = 0 THEN 'store:' || md5(p_brand) ELSE 'asin:' || md5(CAST(p_partkey AS VARCHAR)) END AS tenant_id, CASE WHEN length(p_brand) % 2 = 0 THEN 'store' ELSE 'asin' END AS source_kind FROM part")
def tenants(spark, d):
    rows = load(spark, d, "part").select(F.when(F.length("p_brand") % 2 == 0, F.col("p_brand")).alias("store"), F.col("p_partkey").cast("string").alias("parent_asin"))
    return W.tenants(rows).select("tenant_id", "source_kind").distinct()


@query(f"WITH {_F}, {_V}, {_G} SELECT tenant_id, review_count, cumulative FROM g")
def grant_selection(spark, d):
    """Largest tenants until half of the facts is covered."""
    return grants(spark, d).select("tenant_id", "review_count", "cumulative")


_TARGETS = ", ".join(f"({t})" for t in W.TARGETS_X100)


@query(f"""WITH {_F}, {_V}, {_G}, s AS (SELECT valid_from, count(*) AS n FROM f WHERE tenant_id IN (SELECT tenant_id FROM g) GROUP BY 1),
c AS (SELECT valid_from AS as_of, CAST(sum(n) OVER (ORDER BY valid_from ROWS UNBOUNDED PRECEDING) AS BIGINT) AS achieved_count, CAST(sum(n) OVER () AS BIGINT) AS total FROM s),
t(target_x100) AS (VALUES {_TARGETS}), w AS (SELECT target_x100, greatest(1, (total * target_x100 + 9999) // 10000) AS target_count FROM t CROSS JOIN (SELECT any_value(total) AS total FROM c))
SELECT target_x100, target_count, min(as_of) AS as_of, min(achieved_count) AS achieved_count FROM w JOIN c ON achieved_count >= target_count GROUP BY 1, 2""")
def temporal_buckets(spark, d):
    """Fourteen target shares and the time by which each is reached."""
    seen = W.visible(H.facts(spark, d), grants(spark, d), PRINCIPAL)
    return W.temporal_buckets(seen).select("target_x100", "target_count", "as_of", "achieved_count")


@query(f"""WITH {_F}, {_V}, {_G}, o AS (SELECT tenant_id, review_count, sum(review_count) OVER (ORDER BY review_count, tenant_id ROWS UNBOUNDED PRECEDING) AS c, sum(review_count) OVER () AS t FROM g)
SELECT tenant_id, CASE WHEN c - review_count < (CAST(t AS BIGINT) * 3000 + 9999) // 10000 THEN 1 ELSE 900000000000 END AS valid_from FROM o""")
def grant_calibration(spark, d):
    rows = W.grant_validity(grants(spark, d), H.facts(spark, d), 800_000_000_000, 900_000_000_000, 3000)
    return rows.select("tenant_id", "valid_from")


@query(f"WITH {_F}, {_V}, {_G} SELECT count(*) AS total, count(g.tenant_id) AS acl_only, count(g.tenant_id) AS grant_valid, count(g.tenant_id) FILTER (valid_from <= 820454400000) AS fact_valid FROM f LEFT JOIN g USING (tenant_id)")
def populations(spark, d):
    return W.populations(H.facts(spark, d), grants(spark, d), PRINCIPAL, 820_454_400_000)


@query(f"WITH {_F}, {_V}, {_G} SELECT min(review_id) FILTER (g.tenant_id IS NOT NULL) AS visible_id, min(review_id) FILTER (g.tenant_id IS NULL) AS hidden_id FROM f LEFT JOIN g USING (tenant_id)")
def visibility_probe(spark, d):
    return W.visibility_probe(H.facts(spark, d), grants(spark, d), PRINCIPAL)


@query("""SELECT 'null_id' AS problem, count(*) FILTER (o_orderkey IS NULL) AS rows FROM orders UNION ALL SELECT 'null_product', count(*) FILTER (o_custkey IS NULL) FROM orders
UNION ALL SELECT 'bad_timestamp', 0 FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'inconsistent_product', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)""")
def staging_validation(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("parent_asin"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.col("o_orderstatus").alias("main_category"))
    return W.staging_problems(o)


_RESULT = """r AS (SELECT result_id, min(run_method) AS method, min(lower(trim(filter_name))) AS filter_name, min(query_id) AS query_id, min(ef_search) AS ef_search,
  min(CASE WHEN isfinite(latency_ms) AND latency_ms > 0 THEN latency_ms END) AS latency_ms, min(candidates) AS candidates, min(returned) AS returned FROM query_result WHERE result_id IS NOT NULL GROUP BY result_id)"""


def results(spark, d) -> DataFrame:
    """Measured requests, one row per result_id; a latency that is no measurement is null and counts as an error."""
    ok = (F.col("latency_ms") > 0) & ~F.isnan("latency_ms") & (F.col("latency_ms") != F.lit(float("inf")))
    rows = load(spark, d, "query_result").where("result_id IS NOT NULL").select(
        "result_id", F.col("run_method").alias("method"), F.lower(F.trim("filter_name")).alias("filter_name"), "query_id", "ef_search", F.when(ok, F.col("latency_ms")).alias("latency_ms"), "candidates", "returned"
    )
    return rows.groupBy("result_id").agg(*(F.min(c).alias(c) for c in rows.columns[1:]))


@query(f"""WITH {_RESULT}, g AS (SELECT filter_name, method, count(*) AS samples, count(latency_ms) AS ok, avg(latency_ms) AS latency, avg(returned) FILTER (latency_ms IS NOT NULL) AS returned, avg(candidates) FILTER (latency_ms IS NOT NULL) AS candidates FROM r WHERE filter_name IS NOT NULL AND method IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN returned > 0 THEN candidates / returned ELSE 0 END AS per_result, CASE WHEN candidates > 0 THEN (candidates - returned) / candidates ELSE 0 END AS rejected FROM g),
b AS (SELECT filter_name, min_by(struct_pack(l := latency, p := per_result), method) AS base FROM w GROUP BY 1)
SELECT filter_name, method, samples, ok, samples - ok AS errors, round(latency, 6) AS latency_mean, round(per_result, 6) AS candidate_per_result, round(rejected, 6) AS reject_rate,
round(CASE WHEN latency > 0 THEN base.l / latency ELSE 0 END, 6) AS speedup, round(CASE WHEN per_result > 0 THEN base.p / per_result ELSE 0 END, 6) AS candidate_reduction FROM w JOIN b USING (filter_name)""")
def candidate_waste(spark, d):
    """Candidates fetched per returned row, by filter and method, and both against the first method of the filter."""
    ok = F.col("latency_ms").isNotNull()
    g = results(spark, d).where("filter_name IS NOT NULL AND method IS NOT NULL").groupBy("filter_name", "method").agg(
        F.count("*").alias("samples"), F.count("latency_ms").alias("ok"), F.avg("latency_ms").alias("latency"), F.avg(F.when(ok, F.col("returned"))).alias("r"), F.avg(F.when(ok, F.col("candidates"))).alias("c")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    w = g.withColumn("per_result", ratio("c", "r")).withColumn("rejected", F.when(F.col("c") > 0, (F.col("c") - F.col("r")) / F.col("c")).otherwise(0.0))
    base = w.groupBy("filter_name").agg(F.min_by(F.struct("latency", "per_result"), "method").alias("b")).select("filter_name", F.col("b.latency").alias("l0"), F.col("b.per_result").alias("p0"))
    w = w.join(base, "filter_name")
    return w.select("filter_name", "method", "samples", "ok", (F.col("samples") - F.col("ok")).alias("errors"), F.round("latency", 6).alias("latency_mean"), F.round("per_result", 6).alias("candidate_per_result"), F.round("rejected", 6).alias("reject_rate"), F.round(ratio("l0", "latency"), 6).alias("speedup"), F.round(ratio("p0", "per_result"), 6).alias("candidate_reduction"))


@query(f"""WITH {_RESULT}, u AS (SELECT 'search' AS dataset, method, coalesce(CAST(ef_search AS BIGINT), 0) AS setting, latency_ms AS latency, CAST(returned AS DOUBLE) AS returned FROM r WHERE latency_ms IS NOT NULL AND method IS NOT NULL
UNION ALL SELECT 'events', event_type, user_id % 4, value, 1.0 FROM events WHERE value > 0)
SELECT dataset, method, setting, count(*) AS samples, round(avg(latency), 6) AS latency_mean, round(quantile_cont(latency, 0.5), 6) AS latency_p50, round(1000 * count(*) / sum(latency), 6) AS throughput, round(avg(returned), 6) AS returned_mean FROM u GROUP BY 1, 2, 3""")
def frontier(spark, d):
    """Raw measurements of differently shaped sources brought into one schema, and the points of the frontier."""
    parts = [
        results(spark, d).where("latency_ms IS NOT NULL AND method IS NOT NULL").select(F.lit("search").alias("dataset"), "method", F.coalesce(F.col("ef_search").cast("bigint"), F.lit(0)).alias("setting"), F.col("latency_ms").alias("latency"), F.col("returned").cast("double").alias("returned")),
        load(spark, d, "events").where("value > 0").select(F.lit("events").alias("dataset"), F.col("event_type").alias("method"), (F.col("user_id") % 4).cast("bigint").alias("setting"), F.col("value").alias("latency"), F.lit(1.0).alias("returned")),
    ]
    rows = reduce(DataFrame.unionByName, parts).groupBy("dataset", "method", "setting")
    r = lambda c: F.round(c, 6)
    return rows.agg(F.count("*").alias("samples"), r(F.avg("latency")).alias("latency_mean"), r(F.percentile("latency", F.lit(0.5))).alias("latency_p50"), r(1000 * F.count("*") / F.sum("latency")).alias("throughput"), r(F.avg("returned")).alias("returned_mean"))


@query("""WITH e AS (SELECT query_id, lower(trim(filter_name)) AS filter_name, max(query_no) AS query_no FROM exact_topk_entry GROUP BY 1, 2)
SELECT query_id % 4 AS shard, count(*) AS cells, count(DISTINCT filter_name) AS filters FROM e WHERE query_id IS NOT NULL AND filter_name IS NOT NULL GROUP BY 1""")
def shard_coverage(spark, d):
    """Four shards of a result put together under the contract that every expected cell occurs exactly once."""
    entries = load(spark, d, "exact_topk_entry").select("query_id", F.lower(F.trim("filter_name")).alias("filter_name"), "query_no").where("query_id IS NOT NULL AND filter_name IS NOT NULL")
    cells = stored(entries.groupBy("query_id", "filter_name").agg(F.max("query_no").alias("query_no")), "cells")
    parts = [cells.where(F.col("query_id") % 4 == i) for i in range(4)]
    rows = R.combine_shards(parts, ["query_id", "filter_name"], cells.select("query_id", "filter_name"))
    return rows.groupBy((F.col("query_id") % 4).alias("shard")).agg(F.count("*").alias("cells"), F.countDistinct("filter_name").alias("filters"))


_PAIRS = f"""WITH {_RESULT}, m AS (SELECT * FROM (SELECT DISTINCT method FROM r WHERE method IS NOT NULL) ORDER BY method LIMIT 2),
v AS (SELECT filter_name, query_id, avg(latency_ms) FILTER (method = (SELECT min(method) FROM m)) AS a, avg(latency_ms) FILTER (method = (SELECT max(method) FROM m)) AS b FROM r WHERE filter_name IS NOT NULL AND query_id IS NOT NULL GROUP BY 1, 2),
e AS (SELECT filter_name, count(*) AS expected, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired FROM v WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1)"""


@query(_PAIRS + """ SELECT filter_name, expected, paired, CASE WHEN paired = expected THEN 'complete' ELSE 'incomplete' END AS status,
CASE WHEN paired = expected THEN (SELECT round(avg(a) / avg(b), 6) FROM v WHERE v.filter_name = e.filter_name AND a IS NOT NULL) END AS speedup FROM e""")
def paired_methods(spark, d):
    """The second method against the first per filter; a filter where any query lacks a pair gives no figure."""
    rows = stored(results(spark, d).where("filter_name IS NOT NULL AND query_id IS NOT NULL AND method IS NOT NULL AND latency_ms IS NOT NULL"), "results")
    first, second = [r.method for r in results(spark, d).where("method IS NOT NULL").select("method").distinct().orderBy("method").limit(2).collect()]  # two names
    two = rows.where(F.col("method").isin(first, second))
    out = S.paired_comparison(two.where(F.col("method") == first), two.where(F.col("method") == second), two, ["filter_name"], "query_id", "latency_ms", samples=200)
    return out.select("filter_name", "expected", "paired", "status", F.round("speedup", 6).alias("speedup"))


_LIFE = [*((n, s, "label < 3", 3) for n, s in enumerate(("probing", "probing", "page", "bloom", "bloom"), 1)), *((n, s, "label < 3 AND price >= 100000", 3) for n, s in enumerate(("probing", "probing", "page"), 6))]


@query(f"WITH {_B} " + " UNION ALL ".join(f"SELECT {n} AS request_no, '{s}' AS state, CAST(count(*) FILTER (label < 3 AND price < 60000) + {2 if n > 5 else 0} AS BIGINT) AS rows, CAST(sum(id) FILTER (label < 3 AND price < 60000) + {2_000_001 if n > 5 else 0} AS BIGINT) AS ids, true AS same FROM b" for n, s, _, _ in _LIFE))
def adaptive_cycle(spark, d):
    """The life of an adaptive guide over files: two probes, page fragments that skip too little, Bloom fragments; then
    two rows are added, the version of the files changes, and it starts over. Every answer is that of the plain filter."""
    from tarnfield.operators.fragments import Registry, Settings
    from tarnfield.session import new_path

    path = new_path(spark, "adaptive")
    columns = ["id", "label", "price"]
    H.reviews(spark, d).select(*columns).write.parquet(path)
    registry, tree = Registry(Settings(page_rows=1 << 20)), P.parse("label < 3 AND price < 60000", {"label": "int", "price": "double"})  # one page: it skips nothing
    guide = P.guide(["label < 3"], {"label": "int"})
    found = []
    for n in range(1, len(_LIFE) + 1):
        if n == 6:
            spark.createDataFrame([(1_000_000, 0, 1.0), (1_000_001, 1, 2.0)], "id bigint, label int, price double").write.mode("append").parquet(path)
        rows = spark.read.parquet(path)
        state, pruned = registry.serve("reviews", rows, guide, tree)
        out = [x.where(tree.to_column()).agg(F.count("*").alias("rows"), F.sum("id").alias("ids")) for x in (pruned, rows)]
        both = out[0].crossJoin(out[1].toDF("r", "i"))  # single rows
        found.append(both.select(F.lit(n).alias("request_no"), F.lit(state).alias("state"), "rows", "ids", ((F.col("rows") == F.col("r")) & (F.col("ids") == F.col("i"))).alias("same")).first())
    return spark.createDataFrame([tuple(r) for r in found], "request_no int, state string, rows bigint, ids bigint, same boolean")


@query(f"""WITH {_B}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), n AS (SELECT id, label, price, {l2sql()} AS s FROM b CROSS JOIN q WHERE id <> 0),
x AS (SELECT id, s FROM n WHERE label < 5 ORDER BY s, id LIMIT 10), y AS (SELECT id, s FROM n WHERE label < 5 OR price < 60000 ORDER BY s, id LIMIT 10)
SELECT 'before' AS version, array_to_string(list(id ORDER BY s, id), ',') AS baseline, array_to_string(list(id ORDER BY s, id), ',') AS guided, 'none' AS bypass FROM x
UNION ALL SELECT 'after', array_to_string(list(id ORDER BY s, id), ','), array_to_string(list(id ORDER BY s, id), ','), 'none' FROM y""")
def invalidation(spark, d):
    """A mutation between two requests: the fragment of the old version is stale and built again, so the guided ids are
    those of the baseline in both versions."""
    from tarnfield.operators.fragments import Registry

    q, registry, guide, tree = V.literal(vector_of(spark, d, 0)), Registry(), P.guide(["label < 6"], {"label": "int"}), P.parse("label < 5", {"label": "int"})
    rows = H.reviews(spark, d).select("id", "label", "price", "embedding")
    changed = rows.withColumn("label", F.when(F.col("price") < 60000, F.lit(0)).otherwise(F.col("label")))
    out = []
    for name, version in (("before", rows), ("after", changed)):
        version = stored(version, "version")
        guided = registry.apply("reviews", version, guide, tree)
        ids = []
        for x, as_name in ((version, "baseline"), (guided, "guided")):
            top = x.where(tree.to_column() & (F.col("id") != 0)).withColumn("s", V.l2("embedding", q)).orderBy("s", "id").limit(10)
            ids.append(top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "id"))), lambda x: x["id"].cast("string")), ",").alias(as_name)))
        out.append(ids[0].crossJoin(ids[1]).select(F.lit(name).alias("version"), "baseline", "guided", F.lit(registry.last).alias("bypass")))  # single rows
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- text


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\f\\r\\x0b]+', ' ', 'g')) AS clean, length(text) AS n FROM documents WHERE text IS NOT NULL")
def clean_text(spark, d):
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.one_line("text").alias("clean"), F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, CAST(regexp_extract(replace(text, ',', ''), '([0-9]+([.][0-9]+)?)', 1) AS DOUBLE) AS price FROM documents WHERE regexp_extract(replace(text, ',', ''), '([0-9]+([.][0-9]+)?)', 1) <> ''")
def price_extraction(spark, d):
    return load(spark, d, "documents").select("doc_id", X.price("text").alias("price")).where("price IS NOT NULL")


@query()
def stable_hashes(spark, d):
    """FNV-1a categories and similarity hash buckets of texts."""
    rows = load(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", X.fnv1a_mod(1000)("source").alias("source_bucket"), X.simhash64("text").alias("h")).select("doc_id", "source_bucket", "h", X.simhash_bands(F.col("h")).alias("bands"))


@query("SELECT doc_id, nullif(regexp_extract(text, 'ef [0-9]+'), '') AS ef, nullif(regexp_extract(text, '[0-9]+ g'), '') AS weight FROM documents WHERE text IS NOT NULL")
def field_extraction(spark, d):
    f = X.fields("text", {"ef": r"ef [0-9]+", "weight": r"[0-9]+ g"})
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", f.alias("f")).select("doc_id", "f.*")


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE json_exists(props, '$.k')")
def json_fields(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k IS NOT NULL")


_REQUEST = r"""q AS (SELECT query_no, trim(regexp_replace(regexp_replace(replace(lower(query_text), '’', chr(39)), '<br\s*/?>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM c4_queries WHERE query_text IS NOT NULL)"""
_QUOTED = {n: p.replace("'", "''") for n, p in X.FAMILIES.items()}


@query(f"WITH {_REQUEST} SELECT query_no, " + ", ".join(rf"array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b(?:{p})\b'))), ',') AS {n}" for n, p in _QUOTED.items()) + " FROM q")
def request_families(spark, d):
    """Eleven families of requirements in request texts, the terms that name each."""
    rows = load(spark, d, "c4_queries").where("query_text IS NOT NULL").select("query_no", X.request_text("query_text").alias("t"))
    return rows.select("query_no", *(F.array_join(F.array_sort(X.family_terms("t", n)), ",").alias(n) for n in X.FAMILIES))


@query(rf"WITH {_REQUEST} SELECT query_no, trim(regexp_replace(regexp_replace(t, '\b(?:{'|'.join(_QUOTED.values())})\b', ' ', 'g'), '\s+', ' ', 'g')) AS rest FROM q")
def request_rest(spark, d):
    """What is left of request texts for the vector once the families are blanked out."""
    rows = load(spark, d, "c4_queries").where("query_text IS NOT NULL").select("query_no", X.request_text("query_text").alias("t"))
    return rows.select("query_no", X.without_families("t").alias("rest"))


_JSON = "'{\"tags\": [' || (event_id % 5) || ', 7, ' || (event_id % 3) || '], \"name\": \"e' || event_id || '\"}'"


@query(f"""WITH j AS (SELECT event_id, CAST({_JSON} AS JSON) AS doc FROM events)
SELECT event_id, CAST(json_array_length(doc->'tags') AS BIGINT) AS n, CAST(doc->'tags'->>1 AS BIGINT) AS second, CAST(list_sum(CAST(doc->'tags' AS BIGINT[])) AS BIGINT) AS total, json_exists(doc, '$.name') AS has_name, json_exists(doc, '$.other') AS has_other FROM j""")
def json_arrays(spark, d):
    """Elements, length and keys of JSON documents."""
    doc = F.concat(F.lit('{"tags": ['), F.col("event_id") % 5, F.lit(", 7, "), F.col("event_id") % 3, F.lit('], "name": "e'), F.col("event_id"), F.lit('"}'))
    rows = load(spark, d, "events").select("event_id", doc.alias("doc"))
    tags = F.from_json(F.get_json_object("doc", "$.tags"), "array<bigint>")
    keys = F.json_object_keys("doc")
    return rows.select("event_id", F.json_array_length(F.get_json_object("doc", "$.tags")).cast("bigint").alias("n"), F.get_json_object("doc", "$.tags[1]").cast("bigint").alias("second"), F.aggregate(tags, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.array_contains(keys, "name").alias("has_name"), F.array_contains(keys, "other").alias("has_other"))


@query("SELECT o_orderkey, 'analyst' AS principal, epoch_ms(o_orderdate) <= 820454400000 AS visible FROM orders")
def session_values(spark, d):
    """Principal and time as values of the session, which SQL text refers to by name."""
    spark.sql("DECLARE OR REPLACE VARIABLE tf_principal STRING DEFAULT current_user()")
    spark.sql("DECLARE OR REPLACE VARIABLE tf_as_of BIGINT DEFAULT 0")
    spark.sql(f"SET VAR (tf_principal, tf_as_of) = (SELECT '{PRINCIPAL}', 820454400000L)")
    load(spark, d, "orders").createOrReplaceTempView("tf_orders")
    return spark.sql("SELECT o_orderkey, session.tf_principal AS principal, unix_millis(CAST(o_orderdate AS TIMESTAMP)) <= session.tf_as_of AS visible FROM tf_orders")


@query("""WITH w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS position FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '<br\\s*/?>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND NOT list_contains({stop}, x)) AS l FROM documents WHERE text IS NOT NULL)),
f AS (SELECT word, min((doc_id, position)) AS first, count(*) AS uses FROM w GROUP BY word) SELECT word, CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS label_id, uses FROM f""".format(stop=list(X.STOP_WORDS)))
def label_vocabulary(spark, d):
    """Content words as labels, numbered by their first occurrence over all texts."""
    words = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.content_words("text")).alias("position", "word"))
    first = words.groupBy("word").agg(F.min(F.struct("doc_id", "position")).alias("first"), F.count("*").alias("uses"))
    rows = R.global_position(first.select("word", "uses", "first.doc_id", "first.position"), [F.col("doc_id").asc(), F.col("position").asc()], "label_id")
    return rows.select("word", "label_id", "uses")


# ---------------------------------------------------------------- sources and sinks


def _local(path: str) -> str:
    return path.removeprefix("file://")


@query("SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_totalprice >= 100000 AND (o_orderpriority = '1-URGENT' OR NOT o_totalprice < 300000)")
def csv_scan(spark, d):
    """CSV with a declared header and casts, filtered by a parsed predicate."""
    from tarnfield.session import new_path
    from tarnfield.sources.files import read_csv

    path = new_path(spark, "csv")
    kept = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    kept.write.option("header", True).csv(path)
    rows = read_csv(spark, path, kept.schema)
    return rows.where(P.parse_for(rows, "price >= 100000 AND (priority = '1-URGENT' OR NOT price < 300000)"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def json_lines_scan(spark, d):
    """JSON lines with a declared schema; a line that does not parse is skipped."""
    from tarnfield.session import new_path
    from tarnfield.sources.files import read_json_lines

    path = new_path(spark, "json")
    kept = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    kept.write.json(path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    return read_json_lines(spark, path, kept.schema)


_SUMS = "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total"


@query(f"SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS dim, {_SUMS} FROM embeddings")
def fbin_scan(spark, d):
    """Vectors written as one fbin file by all tasks and read in splits of its rows."""
    from tarnfield.session import new_path
    from tarnfield.sources.binary import read_matrix, register

    register(spark)
    path = _local(new_path(spark, "vectors")) + ".fbin"
    load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").write.format("fbin").mode("overwrite").option("path", path).save()
    rows = read_matrix(spark, path, partitions=5)
    return rows.select("id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query(f"SELECT vec_id AS id, label, {_SUMS} FROM embeddings WHERE label >= 3")
def npy_shards(spark, d):
    """Vector shards without ids joined to a metadata table by their numbered rows."""
    from tarnfield.session import new_path
    from tarnfield.sources.binary import register, write_npy_shards

    register(spark)
    e = load(spark, d, "embeddings")
    paths = write_npy_shards(e.select(F.col("vec_id").alias("id"), "embedding"), _local(new_path(spark, "npy")), shards=4)
    rows = spark.read.format("npyshards").load(",".join(paths))
    meta = e.select(F.col("vec_id").alias("id"), "label").where("label >= 3")
    return rows.join(meta, "id").select("id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS balance FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT -1, 5.0 UNION ALL SELECT -2, NULL""")
def versioned_mutations(spark, d):
    """INSERT, UPDATE and DELETE, each as a new version of a table; older versions stay readable."""
    from tarnfield.session import new_path
    from tarnfield.sources.files import VersionedTable

    table = VersionedTable(spark, _local(new_path(spark, "versions")))
    table.write(load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")), order=["id"])
    table.mutate(delete="balance < 0")
    table.mutate(update={"balance": "balance * 2"}, where="segment = 'BUILDING'")
    table.mutate(insert=spark.createDataFrame([(-1, None, 5.0), (-2, None, None)], "id bigint, segment string, balance double"))
    return table.read().select("id", "balance")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT -c_custkey, 1.0 FROM customer WHERE c_custkey % 100 = 0")
def upsert(spark, d):
    """INSERT ... ON CONFLICT DO UPDATE as a new version."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    new = c.where("id % 3 = 0").withColumn("balance", F.lit(0.0)).unionByName(c.where("id % 100 = 0").select((-F.col("id")).alias("id"), F.lit(1.0).alias("balance")))
    return R.upsert(c, new, ["id"])


@query(f"""WITH {_B}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT 'narrower' AS request, true AS used, id, round({l2sql()}, 6) AS distance FROM (SELECT * FROM b WHERE label < 5 AND price >= 100000) b CROSS JOIN q WHERE id <> 0 QUALIFY row_number() OVER (ORDER BY {l2sql()}, id) <= 10
UNION ALL SELECT 'wider', false, id, round({l2sql()}, 6) FROM (SELECT * FROM b WHERE label < 8) b CROSS JOIN q WHERE id <> 0 QUALIFY row_number() OVER (ORDER BY {l2sql()}, id) <= 10""")
def partial_layout(spark, d):
    """A clustered copy of the rows of one predicate serves the requests whose predicate implies it, and no others."""
    rows, kinds = H.reviews(spark, d).select("id", "label", "price", "embedding"), {"label": "int", "price": "double"}
    part = L.PartialLayout.build(rows, P.parse("label < 6", kinds), ["label", "id"], files=4)
    found = []
    for name, text in (("narrower", "label < 5 AND price >= 100000"), ("wider", "label < 8")):
        q = H.HybridQuery(vector_of(spark, d, 0), P.parse(text, kinds), k=10, exclude=0)
        used, source = part.serve(q.predicate, rows)
        found.append(_rounded_ids(H.prefilter(q, source)).select(F.lit(name).alias("request"), F.lit(used).alias("used"), "id", "distance"))
    return found[0].unionByName(found[1])


def _rounded_ids(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("distance", 6).alias("distance"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, CAST(4 AS BIGINT) AS files, CAST(2 AS BIGINT) AS skipped FROM customer")
def resumed_ingest(spark, d):
    """CSV files taken in once each: a second run takes up only the files that the first one did not finish."""
    from tarnfield.session import new_path
    from tarnfield.sources.files import ingest_csv

    path, target = new_path(spark, "incoming"), new_path(spark, "ingested")
    kept = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    sources = [f"{path}/{i}" for i in range(4)]
    for i, source in enumerate(sources):
        kept.where(F.col("id") % 4 == i).write.option("header", True).csv(source)
    ingest_csv(spark, sources[:2], target, kept.schema)
    rows, skipped = ingest_csv(spark, sources, target, kept.schema)
    return rows.select("id", "balance", F.lit(len(sources)).cast("bigint").alias("files"), F.lit(skipped).cast("bigint").alias("skipped"))


# ---------------------------------------------------------------- layout


def _centroids(spark, d) -> list[list[float]]:
    return [[float(x) for x in r.embedding] for r in load(spark, d, "embeddings").where("vec_id < 8").orderBy("vec_id").collect()]  # 8 given centroids


@query(f"""WITH c AS (SELECT vec_id AS c, embedding AS e FROM embeddings WHERE vec_id < 8), p AS (SELECT b.vec_id AS id, c, {sqsql('b.embedding', 'e')} AS d FROM embeddings b CROSS JOIN c)
SELECT id, CAST(c AS INTEGER) AS cluster_id, round(d, 6) AS centroid_distance_sq FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1""")
def cluster_assignment(spark, d):
    rows = L.assign(load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), _centroids(spark, d))
    return rows.select("id", "cluster_id", F.round("centroid_distance_sq", 6).alias("centroid_distance_sq"))


@query()
def cluster_training(spark, d):
    """Sizes of trained clusters."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return L.assign(e, L.train_centroids(e, 8)).groupBy("cluster_id").agg(F.count("*").alias("rows"))


@query("SELECT count(*) AS rows, CAST(sum(vec_id) AS BIGINT) AS ids, CAST(sum(label) AS BIGINT) AS labels, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 6) AS elements, true AS same_content, true AS other_order FROM embeddings")
def layout_equivalence(spark, d):
    """A clustered copy: what it holds, that its logical hash is that of its source, and that its order on disk is another."""
    from tarnfield.session import new_path

    e = L.assign(load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), _centroids(spark, d))
    path = new_path(spark, "clustered")
    L.write_clustered(e, path, ["cluster_id", "centroid_distance_sq", "id"], files=4)
    copy = spark.read.parquet(path)
    source = stored(e, "plain")
    a, b = (L.fingerprints(L.page_of(x, 64), ["id", "label", "embedding"], "page") for x in (source, copy))
    held = copy.agg(F.count("*").alias("rows"), F.sum("id").alias("ids"), F.sum("label").alias("labels"), F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)), 6).alias("elements"))
    same = a.crossJoin(b.toDF("logical_b", "physical_b")).select((F.col("logical") == F.col("logical_b")).alias("same_content"), (F.col("physical") != F.col("physical_b")).alias("other_order"))
    return held.crossJoin(same)  # single rows


@query(f"""WITH {_B}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 9) SELECT id, CAST(row_number() OVER (ORDER BY {l2sql()}, id) AS BIGINT) AS position FROM b CROSS JOIN q""")
def anchor_layout(spark, d):
    """Rows in the order of their distance to one anchor."""
    rows = H.reviews(spark, d).select("id", V.l2("embedding", V.literal(vector_of(spark, d, 9))).alias("anchor_distance"))
    return R.global_position(rows, [F.col("anchor_distance").asc(), F.col("id").asc()]).select("id", (F.col("position") + 1).alias("position"))


def _clustered(spark, d, k: int) -> tuple[DataFrame, list[list[float]]]:
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    centroids = L.train_centroids(e, k)
    return stored(L.assign(e, centroids), "clustered"), centroids


@query()
def ivf_search(spark, d):
    """Approximate search in trained clusters for the whole query set: mean recall against the exact result by number
    of probes. Sixteen clusters; twelve probes are the setting that :func:`ivf_found` uses."""
    rows, centroids = _clustered(spark, d, 16)
    exact = stored(K.batch_nearest_by(rows, {"": F.lit(True)}, query_set(spark, d), 10).select("query_id", "id"), "exact")
    want = exact.groupBy("query_id").agg(F.count("*").alias("n"))
    found = []
    for probes in (1, 2, 4, 8, 12, 16):
        got = L.cluster_search(rows, centroids, query_set(spark, d), 10, probes).select("query_id", "id").join(exact, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
        per = want.join(got, "query_id", "left").select((F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))
        found.append(per.agg(F.lit(probes).alias("probes"), F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall")))
    return reduce(DataFrame.unionByName, found)


@query("""WITH q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, CAST(10 AS BIGINT) AS rows, true AS ordered FROM q""")
def ivf_found(spark, d):
    """The search with twelve probes of sixteen clusters: every query has ten rows, in the order of their distances."""
    rows, centroids = _clustered(spark, d, 16)
    got = L.cluster_search(rows, centroids, query_set(spark, d), 10, 12)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "distance_sq"))), lambda s: s["distance_sq"])
    return got.groupBy("query_id").agg(F.count("*").alias("rows"), (F.array_sort(F.collect_list("distance_sq")) == in_order).alias("ordered"))


@query(f"""WITH {_B}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 6), r AS (SELECT id, row_number() OVER (ORDER BY {l2sql()}, id) AS rank_no FROM b CROSS JOIN q)
SELECT CAST(rank_no AS BIGINT) AS rank_no, id, id // 64 AS page FROM r WHERE rank_no <= 50""")
def page_materialize(spark, d):
    """Candidates fetched in the order of their pages; the rank they carry restores the order of the results."""
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    rows = K.nearest(H.reviews(spark, d).select("id", "embedding", F.lit(6).alias("query_id")), V.literal(vector_of(spark, d, 6)), 50)
    ranked = rows.withColumn("rank_no", F.row_number().over(w).cast("bigint")).withColumn("page", F.floor(F.col("id") / 64))
    return L.page_order(ranked).orderBy("rank_no").select("rank_no", "id", "page")


@query(f"""WITH {_B}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query_id, id, {sqsql()} AS d FROM b CROSS JOIN q WHERE id <> query_id),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 10)
SELECT query_id, array_to_string(list(id ORDER BY d, id), ',') AS direct, array_to_string(list(id ORDER BY d, id), ',') AS matrix, CAST(0 AS BIGINT) AS differing FROM r GROUP BY 1""")
def spot_check(spark, d):
    """Two exact backends side by side: their ids in rank order, and the ranks that differ by more than a substitution
    of ties."""
    from tarnfield.plans.queries import batch_topk_matrix

    direct, matrix = stored(K.batch_nearest(H.reviews(spark, d), query_set(spark, d), 10), "direct"), stored(batch_topk_matrix(spark, d), "matrix")
    ids = lambda df, name: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "id"))), lambda s: s["id"].cast("string")), ",").alias(name))
    off = K.spot_check(direct, matrix, ["query_id"]).groupBy("query_id").agg(F.count("*").alias("differing"))
    return ids(direct, "direct").join(ids(matrix, "matrix"), "query_id").join(off, "query_id", "left").fillna(0, ["differing"])


@query(f"WITH {_B} " + " UNION ALL ".join(f"SELECT '{x}' AS leaf, count(*) FILTER ({x}) AS true_rows, count(*) FILTER (NOT ({x})) AS false_rows, count(*) FILTER (({x}) IS NULL) AS null_rows FROM b" for x in ("price >= 100000", "price < 150000")))
def qual_profile(spark, d):
    """How often each leaf of a predicate was true, false and null."""
    return P.leaf_profile(H.reviews(spark, d).drop("embedding"), TREES["price_band"])


@query(f"""WITH {_B}, {_F}, {_V}, {_G}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
SELECT id, round(distance, 6) AS distance FROM (SELECT b.id, {l2sql()} AS distance FROM b JOIN g USING (tenant_id) CROSS JOIN q WHERE label < 5 AND id <> 0 ORDER BY distance, id LIMIT 10)""")
def hybrid_by_sql(spark, d):
    """The flagship search as generated SQL text over views."""
    q = H.HybridQuery(vector_of(spark, d, 0), TREES["wide"], k=10, principal=PRINCIPAL, exclude=0)
    H.reviews(spark, d).createOrReplaceTempView("tf_reviews")
    grants(spark, d).createOrReplaceTempView("tf_grants")
    return spark.sql(H.hybrid_sql(q, "tf_reviews", "tf_grants")).select("id", F.round("distance", 6).alias("distance"))


@query()
def band_selection(spark, d):
    """Greedy choice of a filter per target selectivity from the counted catalog."""
    counts = [(r.filter_name, r.rows / r.total) for r in P.selectivities(H.reviews(spark, d).drop("embedding"), {n: t.to_column() for n, t in TREES.items()}).collect()]  # one row per filter
    return spark.createDataFrame(router.nearest_to_targets(counts, [0.5, 0.2, 0.1, 0.05]), "target double, filter_name string, selectivity double")


@query()
def text_embeddings(spark, d):
    """TF-IDF, decomposition and normalisation of texts (not bit-compatible with other libraries)."""
    from tarnfield.functions.embed import text_embeddings as embed

    return embed(load(spark, d, "documents"), "doc_id", "text")
