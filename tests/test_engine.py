import json
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfield import schema
from tarnfield.functions import arrays as A
from tarnfield.functions import stats as S
from tarnfield.functions import text as X
from tarnfield.functions import vector as V
from tarnfield.operators import predicate as P
from tarnfield.operators import relational as R
from tarnfield.operators import topk as K
from tarnfield.operators.bloom import bitmap_count, build_bloom, id_bitmap, may_contain
from tarnfield.operators.fragments import BLOOM, PAGE, PROBING, Registry, Settings, bloom_skip_rate, guide_skip_rate, table_version
from tarnfield.plans import hybrid as H
from tarnfield.plans import layout as L
from tarnfield.plans import router
from tarnfield.plans import workload as W

COLS = {"id": "bigint", "label": "int", "price": "double", "has_price": "boolean", "tags": "array<int>", "cat": "string"}


def vectors(spark, n=200, d=8, seed=7):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype("f4")
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, embedding array<float>")


# ---------------------------------------------------------------- exact top-k


def test_batch_equals_brute_force_self_excluded(spark):
    x, df = vectors(spark)
    q = [2, 17, 91]
    queries = df.where(F.col("id").isin(q)).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = K.batch_nearest(df.where("id % 3 <> 0"), queries, 10).collect()
    part = V.batch_topk(df.where("id % 3 <> 0"), q, x[q], 10)
    got2 = K.ranked(part, ["query_id"], [F.col("distance_sq"), F.col("id")], 10).collect()
    for i in q:
        d = ((x[i].astype(float) - x.astype(float)) ** 2).sum(1)
        want = [j for j in np.lexsort((np.arange(200), d)) if j % 3 and j != i][:10]
        for rows in (got, got2):
            assert [r.id for r in sorted(rows, key=lambda r: r.rank_no) if r.query_id == i] == want


def test_blocks_of_queries_cover_all(spark):
    _, df = vectors(spark, 60, 4)
    q = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    a = K.batch_nearest(df, q, 3).select("query_id", "id", "rank_no")
    b = K.batch_nearest(df, q, 3, block_rows=7).select("query_id", "id", "rank_no")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 180


def test_ties_are_broken_by_id_and_reported(spark):
    lattice = spark.createDataFrame([(i, [float(i // 8), float(i % 8)]) for i in range(64)], "id bigint, embedding array<float>")
    q = spark.createDataFrame([(100, [0.0, 0.0])], "query_id bigint, query_vector array<float>")
    got = K.batch_nearest(lattice.repartition(13), q, 3)
    assert [r.id for r in got.orderBy("rank_no").collect()] == [0, 1, 8]
    t = K.truth(K.batch_nearest(lattice, q, 3), ["query_id"], 2).first()
    assert t.boundary_tied and t.strict_closer_count == 1 and list(t.exact_ids) == [0, 1]


def test_tie_aware_recall_accepts_substitutes(spark):
    truth = spark.createDataFrame([(1, 4.0, 1e-6, [5, 6])], "query_id bigint, kth_distance_sq double, tie_tolerance double, exact_ids array<bigint>")
    found = spark.createDataFrame([(1, 5, 1.0), (1, 7, 4.0), (1, 8, 9.0), (1, 1, 0.0)], "query_id bigint, id bigint, distance_sq double")
    assert K.tie_aware_recall(found, truth, ["query_id"], 2).first().recall == 1.0


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    r = df.select(V.l2("a", "b").alias("l2"), V.norm("a").alias("n"), V.is_valid("b").alias("vb"), V.is_valid("a").alias("va"), V.cosine("a", "b").alias("c"), V.normalized("a").alias("u")).collect()
    assert (r[0].l2, r[0].n, r[0].vb, r[0].c, list(r[0].u)) == (5.0, 5.0, False, None, [0.6, 0.8]) and not r[1].va and r[1].l2 is None
    t = spark.createDataFrame([("[1.5, -2]",)], "t string").select(V.parse_vector("t").alias("v"))
    assert t.first().v == [1.5, -2.0] and t.select(V.vector_text("v")).first()[0] == "[1.5,-2.0]"


def test_single_query_plan_has_no_shuffle(spark):
    _, df = vectors(spark)
    shape = router.plan_shape(K.nearest(df, V.literal([0.0] * 8), 5))
    assert shape.get("TakeOrderedAndProject") and "ShuffleExchange" not in shape


# ---------------------------------------------------------------- predicates


@pytest.mark.parametrize("bad", ["id = 1; drop table x", "pg_sleep(1) = 1", "id = (select 1)", "a.id = 1", "current_user = 'x'", "id =", "", "label = 1 label", "tags @> ARRAY[1]::json[]", "price", "nope = 1", "id = 1 --x"])
def test_inadmissible_predicates_fail(bad):
    with pytest.raises(P.PredicateError):
        P.parse(bad, COLS)


def test_parser_and_columns(spark):
    df = spark.createDataFrame([(1, 1, 5.0, True, [1, 2], "a"), (2, 3, None, False, [2, None], "o'b"), (3, None, -1.0, None, None, None)], "id bigint, label int, price double, has_price boolean, tags array<int>, cat string")
    ids = lambda p: [r.id for r in df.where(P.parse_for(df, p)).orderBy("id").collect()]
    assert ids("has_price AND price <= 10") == [1]
    assert ids("NOT has_price OR label = 1") == [1, 2]
    assert ids("tags @> ARRAY[]") == [1, 2] and ids("tags @> ARRAY[1,2]") == [1] and ids("tags @> '{2}'::int[]") == [1, 2]
    assert ids("tags && ARRAY[9]") == [] and ids("NOT tags && ARRAY[9]") == [1, 2] and ids("tags && ARRAY[]") == []
    assert ids("cat = 'o''b'") == [2] and ids("price IS NULL") == [2] and ids("price IS NOT NULL AND price < -0.5") == [3]
    assert ids("price BETWEEN -1 AND 5") == [1, 3]


def test_golden_tree_and_sql():
    tree = P.parse("has_price AND (price < 10 OR NOT label >= 2)", COLS)
    assert tree == P.And((P.Flag("has_price"), P.Or((P.Compare("price", "<", 10), P.Not(P.Compare("label", ">=", 2))))))
    assert P.sql_of(tree, "b") == "(b.has_price AND (b.price < 10 OR NOT (b.label >= 2)))"
    assert P.columns_of(tree) == {"has_price", "price", "label"}
    assert all(P.named(n) == P.parse(v, P.REVIEW_COLUMNS) for n, v in P.NAMED.items()) and P.named("sql:rating = 5") == P.Compare("rating", "=", 5)


def test_guides():
    g = P.guide(["label < 3", "has_price", "|", "!exact:price > 5"], COLS)
    assert [[a.negated for a in x] for x in g.groups] == [[False, False], [True]]
    for bad in (["!page:label < 3"], ["label < 3", "|"], ["label < 1"] * 129, ["label < " + "1" * 300]):
        with pytest.raises(P.PredicateError):
            P.guide(bad, COLS)
    assert len(P.guide(["label < 1"] * 128, COLS).atoms) == 128


def test_implication():
    p = lambda t: P.parse(t, COLS)
    assert P.implies(p("label = 2 AND has_price"), p("label < 3")) and not P.implies(p("label < 3"), p("label = 2"))
    assert P.implies(p("label = 1 OR label = 2"), p("label <= 2")) and P.implies(p("tags @> ARRAY[1,2]"), p("tags && ARRAY[2]"))
    assert not P.implies(p("NOT label = 2"), p("label < 3")) and not P.implies(p("price > 2"), p("label > 2"))


@given(st.lists(st.integers(-5, 5), max_size=6), st.sampled_from(["<", "<=", ">", ">=", "=", "<>"]), st.sampled_from(["<", "<=", ">", ">=", "=", "<>"]), st.integers(-3, 3), st.integers(-3, 3))
@settings(max_examples=200, deadline=None)
def test_implication_is_sound(values, op1, op2, a, b):
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "=": lambda x, y: x == y, "<>": lambda x, y: x != y}
    if P.implies(P.Compare("v", op1, a), P.Compare("v", op2, b)):
        assert all(ops[op2](v, b) for v in values if ops[op1](v, a))


def test_derived_predicate_and_selectivities(spark):
    given = {"rating": 5.0, "has_price": True, "price": 20.0, "popularity": 999}
    text = "rating = 5 AND has_price AND price > 10 AND price <= 20 AND item_rating_number >= 100 AND item_rating_number < 1000"
    assert P.derived_predicate("mixed", **given) == (text, "c4_mixed_5_p_10_20_pop_mid") and P.NAMED["c4_mixed_5_p_10_20_pop_mid"] == text
    assert P.derived_predicate("mixed", **(given | {"rating": 4.7}))[1] == "sql:" + text.replace("= 5", "= 4")
    assert P.derived_predicate("price", has_price=None, price=3.0)[0] == "NOT has_price" and P.derived_predicate("price", has_price=True)[0] == "has_price AND price <= 10"
    assert P.derived_predicate("popularity", popularity=None)[0] == "item_rating_number < 100"
    assert P.derived_predicate("mixed_category", **given, category="Tea's")[0] == f"main_category = 'Tea''s' AND {text}"
    with pytest.raises(P.PredicateError):
        P.derived_predicate("colour")
    with pytest.raises(P.PredicateError):
        P.named("popular")
    assert len(P.NAMED) == 19 and len(P.CATALOG) == 14
    df = spark.range(10)
    assert {r.filter_name: r.rows for r in P.selectivities(df, {"a": F.col("id") < 3, "b": F.col("id") >= 9}).collect()} == {"a": 3, "b": 1}


# ---------------------------------------------------------------- Bloom, bitmaps, fragments


def test_bloom_has_no_false_negatives(spark):
    ids = spark.createDataFrame([(int(i) * 7919 - 10**6,) for i in range(3000)], "id bigint")
    b = build_bloom(ids)
    assert ids.where(may_contain(b)).count() == 3000 and b.size == 30_000
    other = spark.range(10**7, 10**7 + 4000)
    assert other.where(may_contain(b)).count() < 4000 * max(0.05, 4 * b.false_positive_rate)
    assert build_bloom(ids.limit(0)).size == 1024 and not build_bloom(ids.limit(0)).test(np.array([1]))[0]


def test_bitmap_buckets_do_not_collide(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 32768, 32769, 70000, 70000, None)], "id bigint")
    assert bitmap_count(id_bitmap(df)).first().ids == 5


def _reviews(spark):
    return spark.createDataFrame([(i, i % 10, float(i), i % 4 == 0, [i % 3], "c") for i in range(3000)], "id bigint, label int, price double, has_price boolean, tags array<int>, cat string")


@pytest.mark.parametrize("kind", ["exact", "page", "bloom"])
def test_fragments_never_change_results(spark, kind):
    df, tree = _reviews(spark), P.parse("label < 2 AND price > 2000", COLS)
    r = Registry()
    pruned = r.apply("t", df, P.guide(["price > 1500"], COLS), tree, kind=kind)
    assert r.last == "none" and pruned.count() < 3000
    assert pruned.where(tree.to_column()).select("id").exceptAll(df.where(tree.to_column()).select("id")).count() == 0
    assert pruned.where(tree.to_column()).count() == df.where(tree.to_column()).count()


def test_unproven_and_lossy_guides_are_left_out(spark):
    df, r = _reviews(spark), Registry()
    r.apply("t", df, P.guide(["label = 1"], COLS), P.parse("label < 3", COLS))
    assert r.last == "not_implied"
    r.apply("t", df, None, None)
    assert r.last == "no_guide"
    small = Registry(Settings(most_fragment_bytes=10))
    small.apply("t", df, P.guide(["label < 3"], COLS), P.parse("label < 3", COLS))
    assert small.last == "over_budget" and json.loads(small.profile())["counters"]["rejected"] == 1


def test_adaptive_life_and_versions(spark):
    df, r = _reviews(spark), Registry()
    wide, narrow = P.guide(["label < 9"], COLS), P.guide(["price > 2500"], COLS)
    assert [r.activate("t", df, wide) for _ in range(4)] == [PROBING, PROBING, PAGE, BLOOM]
    assert [r.activate("t", df, narrow) for _ in range(4)] == [PROBING, PROBING, PAGE, PAGE]
    r.bump("t")
    assert r.state("t", narrow) == "stale" and r.activate("t", df, narrow) == PROBING
    assert r.state("u", narrow) == "missing"  # no leakage to another relation
    with pytest.raises(P.PredicateError):
        r.activate("t", df, P.guide(["!exact:label < 3"], COLS))


def test_stale_version_sees_new_rows(spark):
    r, guide, tree = Registry(), P.guide(["label = 7"], COLS), P.parse("label = 7", COLS)
    df = _reviews(spark)
    n = r.apply("t", df, guide, tree).count()
    new = df.unionByName(df.limit(1).withColumn("id", F.lit(10**6).cast("bigint")).withColumn("label", F.lit(7)))
    r.bump("t")
    assert r.apply("t", new, guide, tree).where(tree.to_column()).count() == n + 1


def test_eviction_by_benefit(spark):
    df = _reviews(spark)
    r = Registry(Settings(most_total_bytes=5000))
    a, b = (P.guide([t], COLS).atoms[0] for t in ("label = 1", "label = 2"))
    assert r.build("t", df, a, "exact", cost=1.0) and r.build("t", df, b, "exact", cost=5.0)
    assert r.counters["evicted"] == 0
    assert r.build("t", df, P.guide(["label = 3"], COLS).atoms[0], "exact", cost=9.0)
    assert r.counters["evicted"] == 1 and ("t", "label = 1", "exact") not in r.fragments


def test_fragments_in_use_stay_and_stored_ones_are_taken_up_for_their_version(spark, tmp_path):
    path, tree = f"{tmp_path}/t", P.parse("label < 2 AND price > 2000", COLS)
    _reviews(spark).write.parquet(path)
    r, both = Registry(Settings(most_total_bytes=9000)), P.guide(["label < 2", "|", "label = 9"], COLS)
    r.apply("t", spark.read.parquet(path), both, P.parse("label < 2 OR label = 9", COLS))
    assert r.last == "none" and r.counters["evicted"] == 0 and len(r.active) == 2
    small = Registry(Settings(most_total_bytes=6000))  # the second atom does not fit beside the first, which is in use
    small.apply("t", spark.read.parquet(path), both, P.parse("label < 2 OR label = 9", COLS))
    assert small.last == "over_budget" and small.counters["evicted"] == 0
    guide, life = P.guide(["label < 2"], COLS), Registry(Settings(page_rows=1 << 20))
    states = []
    for _ in range(4):
        state, rows = life.serve("t", spark.read.parquet(path), guide, tree)
        states.append(state)
        assert rows.where(tree.to_column()).count() == spark.read.parquet(path).where(tree.to_column()).count()
    assert states == [PROBING, PROBING, PAGE, BLOOM] and life.last == "none" and rows.count() < 3000
    assert life.save(spark, f"{tmp_path}/kept") == 2
    later = Registry()
    assert later.load(spark, f"{tmp_path}/kept", {"t": spark.read.parquet(path)}) == 2
    pruned = later.apply("t", spark.read.parquet(path), guide, tree, kind="bloom")
    assert later.counters["reused"] == 1 and later.counters["built"] == 0 and pruned.where(tree.to_column()).count() == 199
    _reviews(spark).limit(1).write.mode("append").parquet(path)
    assert Registry().load(spark, f"{tmp_path}/kept", {"t": spark.read.parquet(path)}) == 0
    later.apply("t", spark.read.parquet(path), guide, tree, kind="bloom")
    assert later.counters["stale"] == 1 and later.counters["built"] == 1
    assert Registry(Settings(selectivity_ceiling=0.1)).activate("t", _reviews(spark), guide, selectivity=0.2) == PROBING


def test_running_values_of_a_hot_key(spark):
    rng = np.random.default_rng(4)
    rows = [(None if k == 3 else int(k), i, None if i % 17 == 0 else float(v)) for i, (k, v) in enumerate(zip(rng.choice(5, 4000, p=[0.8, 0.1, 0.05, 0.03, 0.02]), rng.integers(-5, 6, 4000)))]
    df = spark.createDataFrame(rows, "k int, n int, v double").withColumn("__x", F.lit(1))
    got = {r.n: (r.s, r.c, r.b) for r in R.keyed_running(df, ["k"], ["n"], sums={"s": F.col("v"), "c": F.lit(1)}, lags={"b": "v"}).collect()}
    held = {}
    for k, n, v in rows:
        seen = held.setdefault(k, [])
        known = [x for x in seen if x is not None]
        assert got[n] == (sum(known) if known else None, len(seen) or None, seen[-1] if seen else None)
        seen.append(v)
    assert R.keyed_running(df.limit(0), ["k"], ["n"], sums={"s": F.col("v")}).count() == 0


def test_cluster_search_reaches_the_exact_result_with_all_probes(spark):
    x, df = vectors(spark, 400, 8)
    centroids = L.train_centroids(df, 6)
    rows, q = L.assign(df, centroids), df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = sorted(map(tuple, K.batch_nearest(df, q, 5).select("query_id", "id", "rank_no").collect()))
    for block in (3, 4096):
        assert sorted(map(tuple, L.cluster_search(rows, centroids, q, 5, 6, block_rows=block).select("query_id", "id", "rank_no").collect())) == want
    assert L.cluster_search(rows, centroids, q.limit(0), 5, 2).count() == 0


def test_text_embeddings_are_the_leading_singular_directions(spark):
    from tarnfield.functions.embed import text_embeddings

    words = "rye oat spelt millet barley wheat corn rice".split()
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(words[:4] if i % 2 else words[4:], 12))) for i in range(80)] + [(900, "zzz"), (901, None), (902, "")]
    got = {r.id: np.array(r.embedding) for r in text_embeddings(spark.createDataFrame(docs, "id int, text string"), "id", "text", dim=6, min_df=2, max_df=0.99).collect()}
    assert set(got) == {*range(80), 900, 902} and all(len(v) == 6 for v in got.values()) and not got[900].any()
    a, b = (np.array([got[i] for i in range(80) if i % 2 == c]) for c in (0, 1))
    assert np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-5) and (a @ a.T).mean() > (a @ b.T).mean() + 0.4


def test_skip_rates():
    assert guide_skip_rate([[0.5, 0.9]]) == pytest.approx(0.9) and guide_skip_rate([[0.5], [0.5]]) == 0.0
    assert 0.98 < bloom_skip_rate(100, 10_000, 1024 * 8) <= 0.99


def test_table_version_changes_with_files(spark, tmp_path):
    p = f"{tmp_path}/t"
    spark.range(5).write.parquet(p)
    a = table_version(spark.read.parquet(p))
    spark.range(6).write.mode("overwrite").parquet(p)
    assert table_version(spark.read.parquet(p)) != a and table_version(spark.range(3)) == table_version(spark.range(3))


# ---------------------------------------------------------------- strategies and workload


def test_exact_strategies_agree(spark):
    x, df = vectors(spark, 300, 4)
    rows = df.withColumn("label", (F.col("id") % 10).cast("int")).withColumn("tenant_id", (F.col("id") % 5).cast("int")).withColumn("valid_from", F.col("id") + 1).withColumn("valid_to", F.lit(None).cast("bigint"))
    grants = spark.createDataFrame([("p", t, True, 1, None if t else 50) for t in (0, 1, 2)], schema="principal_name string, tenant_id int, can_read boolean, valid_from bigint, valid_to bigint")
    q = H.HybridQuery(x[0].tolist(), P.parse("label < 7", {"label": "int"}), k=8, workload="both_validity", principal="p", as_of=200, exclude=0)
    want = [tuple(r) for r in H.prefilter(q, rows, grants).collect()]
    assert len(want) == 8
    for name, f in H.STRATEGIES.items():
        assert [tuple(r) for r in f(q, rows, grants).collect()] == want, name
    short = [tuple(r) for r in H.post_filter(q, rows, grants, fetch=20).collect()]
    assert short == want[: len(short)]
    assert [tuple(r) for r in H.post_filter_until(q, rows, grants, fetch=5).collect()] == want
    assert all(r.id % 5 in (1, 2) for r in H.prefilter(q, rows, grants).collect())
    facts = H.HybridQuery(**{**q.__dict__, "workload": "fact_validity", "k": 300})  # of the fact alone: ended grants still count
    assert {r.id for r in H.prefilter(facts, rows, grants).collect()} == {i for i in range(1, 200) if i % 5 in (0, 1, 2) and i % 10 < 7}


def test_temporal_bucket_golden(spark):
    rows = [(1000,)] * 4 + [(2000,)] * 6 + [(5000,)] * 10
    got = {r.target_x100: (r.target_count, r.as_of, r.achieved_count) for r in W.temporal_buckets(spark.createDataFrame(rows, "valid_from bigint"), (2000, 2500, 5000)).collect()}
    assert got == {2000: (4, 1000, 4), 2500: (5, 2000, 10), 5000: (10, 2000, 10)}


@pytest.mark.parametrize(("n", "x100", "want"), [(500, 20, 1), (501, 20, 2), (10_000_000, 50, 50_000)])
def test_exact_ceiling(spark, n, x100, want):
    assert spark.sql(f"SELECT (CAST({n} AS BIGINT) * {x100} + 9999) div 10000").first()[0] == want


def test_populations_must_differ():
    W.check_populations(1000, 650, 200)
    for bad in ((1000, 1000, 200), (1000, 200, 200), (1000, 0, 200)):
        with pytest.raises(ValueError):
            W.check_populations(*bad)
    assert W.within_target(20.09, 20) and not W.within_target(20.2, 20)


def test_tenants_prefer_a_real_store(spark):
    df = spark.createDataFrame([("s", "a1"), (" ", "a2"), (None, "a3")], "store string, parent_asin string")
    assert sorted((r.source_kind, r.source_value) for r in W.tenants(df).collect()) == [("asin", "a2"), ("asin", "a3"), ("store", "s")]
    p = spark.createDataFrame([(1, "a", None, "x", 5), (2, "a", "s", "y", 5), (3, "a", "s", "z", 4)], "id bigint, parent_asin string, store string, main_category string, item_rating_number int")
    assert W.products(p).first().main_category == "y"


# ---------------------------------------------------------------- relational, statistics, text, router


def test_lookup_update_upsert(spark):
    t = spark.createDataFrame([(1, "u", 10), (1, "v", 11), (2, "u", 12)], "a int, b string, id int")
    got = R.two_key_lookup(spark.createDataFrame([(1, "v"), (2, "x"), (9, "x")], "a int, b string"), t, ["a", "b"], ["a"], "id")
    assert sorted(map(tuple, got.select("a", "id", "match_type").collect())) == [(1, 11, "full"), (2, 12, "fallback")]
    u = R.upsert(t.select("a", "id").where("b = 'u'"), spark.createDataFrame([(2, 99), (3, 1)], "a int, id int"), ["a"])
    assert sorted(map(tuple, u.collect())) == [(1, 10), (2, 99), (3, 1)]


def test_percentile_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    r = df.agg(S.percentile_floor("x", 0.5), S.percentile_nearest("x", 0.5), S.percentile_linear("x", 0.5), S.percentile_truncated("x", 0.95), S.percentile_round("x", 0.5)).first()
    assert tuple(r) == (2.0, 2.0, 2.5, 3.0, 3.0)
    assert df.limit(0).agg(S.percentile_floor("x", 0.5)).first()[0] == 0.0


def test_group_percentiles_equal_the_lists(spark):
    rng = np.random.default_rng(8)
    rows = [(None if k == 2 else int(k), None if i % 50 == 0 else float(v)) for i, (k, v) in enumerate(zip(rng.choice(4, 3000, p=[0.9, 0.06, 0.03, 0.01]), rng.integers(0, 60, 3000)))] + [(77, None), (78, 5.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: tuple(r)[1:] for r in S.group_percentiles(df, ["k"], "x", {r: (r, p) for r in ("floor", "nearest", "truncated", "round", "linear")}).collect()}
        f = [g("x", p) for g in (S.percentile_floor, S.percentile_nearest, S.percentile_truncated, S.percentile_round, S.percentile_linear)]
        want = {r[0]: tuple(r)[1:] for r in df.where("x IS NOT NULL").groupBy("k").agg(*f).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert S.group_percentiles(df.limit(0), ["k"], "x", {"a": ("floor", 0.5)}).count() == 0


def test_bootstrap_is_reproducible():
    v = [1.0, 2.0, 5.0, 9.0]
    a = S.bootstrap_mean(v, samples=500, seed=3)
    assert a == S.bootstrap_mean(v, samples=500, seed=3) and a[2] <= a[1] <= a[0] <= a[3] and S.bootstrap_mean([]) == (0.0, 0.0, 0.0, 0.0)
    assert S.paired_ratio([(2.0, 1.0)] * 5, samples=50) == (2.0, 2.0, 2.0, 2.0) and S.bootstrap_mean([7.0]) == (7.0, 7.0, 7.0, 7.0)
    many = np.random.default_rng(0).normal(10, 2, 400)
    mean, lower, low, high = S.bootstrap_mean(many, samples=4000)
    assert abs(high - low - 2 * 1.96 * 2 / 20) < 0.03 and abs(mean - lower - 1.645 * 2 / 20) < 0.02


def test_a_lost_pair_gives_no_figure(spark):
    rows = lambda x: spark.createDataFrame(x, "g string, q int, v double")
    base, fast = rows([("a", 1, 4.0), ("a", 1, 6.0), ("a", 2, 3.0), ("b", 1, 4.0), ("b", 2, 4.0)]), rows([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 1.0)])
    got = {r.g: r for r in S.paired_comparison(base, fast, base, ["g"], "q", "v", samples=100).collect()}
    assert (got["a"].status, got["a"].expected, got["a"].paired, got["a"].speedup, got["a"].saving) == ("complete", 2, 2, 2.0, 2.0)
    assert (got["b"].status, got["b"].expected, got["b"].paired, got["b"].speedup) == ("incomplete", 2, 1, None)
    extra = S.paired_comparison(base, fast, base.where("q = 1"), ["g"], "q", "v", samples=10).where("g = 'a'").first()
    assert extra.status == "incomplete"  # a key that nobody expects


def test_first_reaching_and_grid_equal_plain_forms(spark):
    steps = spark.createDataFrame([(1, 4, 4), (2, 6, 10), (5, 10, 20)], "as_of int, n int, c int")
    targets = spark.createDataFrame([(1,), (4,), (5,), (10,), (20,)], "want int")
    assert sorted(map(tuple, R.first_reaching(steps, targets, "c", "n", "want").select("want", "as_of").collect())) == [(1, 1), (4, 1), (5, 2), (10, 2), (20, 5)]
    x, df = vectors(spark, 200, 4)
    q = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    arms = {f"f{i}": (F.col("id") % 70 == i) if i else F.lit(True) for i in range(70)} | {"none": F.lit(None).cast("boolean")}
    got = K.batch_nearest_by(df, arms, q, 3, block_rows=2)
    assert got.where("filter_name = 'none'").count() == 0
    for i in (0, 1, 61, 62, 69):
        want = K.batch_nearest(df.where(arms[f"f{i}"]), q, 3).select("query_id", "id", "rank_no")
        assert sorted(map(tuple, got.where(F.col("filter_name") == f"f{i}").select("query_id", "id", "rank_no").collect())) == sorted(map(tuple, want.collect()))


def test_text_functions(spark):
    df = spark.createDataFrame([("A<br/>b,  C\n1,234.50 dollars",), (None,), ("",)], "t string")
    r = df.select(X.one_line("t").alias("o"), X.price("t").alias("p"), X.plain("t").alias("q"), X.fnv1a_mod(97)("t").alias("f"), X.simhash64("t").alias("h")).collect()
    assert r[0].p == 1234.5 and r[0].q == "a b c 1 234 50 dollars" and r[1].o is None and r[2].p is None and r[1].h is None
    assert r[2].f == 0xCBF29CE484222325 % 97 and len(r[0].h) == 16


def test_reuse_break_even_runs(spark):
    t = spark.createDataFrame([(i, "ab"[i % 2], float(s)) for i, s in enumerate((-3, -1, 1, 1, 2, 1))], "n bigint, k string, s double")
    assert [r.reuse_distance for r in R.reuse_distance(t, "k", "n").orderBy("n").collect()] == [None, None, 2, 2, 2, 2]
    assert {r.k: r.break_even for r in R.break_even(t, ["k"], "n", "s").collect()} == {"a": 4, "b": 3}
    p = spark.createDataFrame([(1, i, g) for i, g in enumerate("xxyyx")], "q int, r int, page string")
    assert tuple(R.run_lengths(p, ["q"], "page", ["r"]).first()) == (1, 5, 3, 2)


def test_router():
    assert router.calibrate([1, 1, 1], [2, 2, 2]).chosen == "prefilter" and router.calibrate([1, 1], [2, 2]).reason == "few_samples"
    assert router.calibrate([1, 9, 1], [20, 20, 20]).reason == "unsteady" and router.calibrate([1.95] * 3, [2] * 3).reason == "not_faster"
    assert router.calibration_outcome({"a": 0.5}, ["a", "b"], 0.9)[0] == "indeterminate" and router.calibration_outcome({"a": 0.5, "b": 0.8}, ["a", "b"], 0.9)[0] == "unattainable"
    t = router.build_trace([f"f{i}" for i in range(14)], [1, 2], requests=100, window=10, seed=4)
    assert t == router.build_trace([f"f{i}" for i in range(14)], [1, 2], requests=100, window=10, seed=4) and {r.phase for r in t} == {0, 1}
    t = router.build_trace([f"f{i}" for i in range(14)], [1, 2], requests=4000, window=10, seed=4)
    hot = [{f for f, _ in Counter(r.filter_name for r in t if r.phase == p).most_common(4)} for p in (0, 1)]
    stays = np.mean([a.filter_name == b.filter_name for a, b in zip(t, t[1:])])
    assert not hot[0] & hot[1] and 0.7 < stays < 0.9 and all(t[r.request_no - r.reuse_distance].filter_name == r.filter_name for r in t if r.reuse_distance)
    with pytest.raises(ValueError):
        router.build_trace(["a"], [1], requests=15, window=10, seed=1)
    a, b = router.disjoint_samples(range(50), [10, 20], 1)
    assert len(a) == 10 and not set(a) & set(b)
    assert router.nearest_to_targets([("x", 0.5), ("y", 0.49), ("z", 0.1)], [0.5, 0.5]) == [(0.5, "x", 0.5), (0.5, "y", 0.49)]
    assert router.self_exclusion(False, True, 10) == (False, 10) and router.self_exclusion(True, False, 10) == (False, 11)
    assert sorted(router.order_jobs([("a", 1, 2), ("b", 5, 1), ("c", 2, 2)], "extremes")) == ["a", "b", "c"] and router.flat_cutoff(5, 10) == "flat"
    assert router.lifecycle(["probing", "probing", "page"]) == "probing->page" and router.interleaved("ab", 2) == [["a", "b"], ["b", "a"]]
    assert router.ladder(["x", "y", "z"], {"x": 0.1, "y": 0.95, "z": 1.0}.get, 0.9) == {"x": 0.1, "y": 0.95}


def test_select_config_never_falls_back(spark):
    df = spark.createDataFrame([("a", 0.95, 5.0), ("b", 0.95, 3.0), ("c", 0.5, 1.0)], "config string, recall double, latency double")
    assert router.select_config(df, 0.9).first().config == "b" and router.select_config(df, 0.99).count() == 0 and router.closest_config(df, 0.6).first().config == "c"


def test_schema_checks(spark):
    with pytest.raises(ValueError):
        schema.check_header(["id"], schema.VECTOR_TABLE)
    df = spark.createDataFrame([(1, 5), (1, None)], "id int, v int")
    assert {r.rule: r.rows for r in schema.violations(df, {"pos": F.col("v") > 0}, ["id"]).collect()} == {"pos": 1, "unique": 1}
    with pytest.raises(Exception, match="must have 3"):
        schema.with_dimension(spark.createDataFrame([([1.0],)], "embedding array<float>"), 3).collect()
    assert schema.foreign_key(df, "v", spark.range(3), "id").count() == 1


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 9, 3])], "a array<int>, b array<int>")
    assert df.select(A.recall_at("a", "b", 3), A.recall_at("a", "b", 5, short=True)).first() == (pytest.approx(2 / 3), pytest.approx(2 / 3))


def test_entry_contract():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and "p7_found" in names and os.path.exists(e.__file__)


def test_shards_fail_closed(spark):
    part = lambda *k: spark.createDataFrame([(x, 1) for x in k], "k int, v int")
    assert R.combine_shards([part(0, 1), part(2)], ["k"], spark.range(3).select(F.col("id").cast("int").alias("k"))).count() == 3
    for bad in ([part(0, 1)], [part(0, 1, 2, 3)], [part(0, 1, 2), part(2)]):
        with pytest.raises(ValueError):
            R.combine_shards(bad, ["k"], spark.range(3).select(F.col("id").cast("int").alias("k")))


def test_candidate_sql_has_no_vector_and_no_limit(spark):
    q = H.HybridQuery([0.0, 1.0], P.parse("cat = 'o''b' AND price < -1.5", COLS), workload="both_validity", principal="it's", as_of=7, exclude=3)
    text = H.candidate_sql(q, "t")
    assert "LIMIT" not in text and "embedding" not in text and "'it''s'" in text and "g.valid_to IS NULL" in text and "(-1.5)" in text
    with pytest.raises(P.PredicateError):
        H.candidate_sql(H.HybridQuery([], P.parse("tags && ARRAY[1]", COLS)), "t")


def test_label_filters_and_profile(spark):
    tree, name = P.label_range_filter("hybrid", [3], 10, 20)
    df = spark.createDataFrame([([3], 0), ([1], 15), ([1], 20), (None, None)], "labels array<int>, width int")
    assert df.where(tree.to_column()).count() == 2 and name == "label_3_or_range_10_20"
    rows = {r.leaf: (r.true_rows, r.false_rows, r.null_rows) for r in P.leaf_profile(df, tree).collect()}
    assert rows["width >= 10"] == (2, 1, 1)


def test_concurrent_jobs(spark):
    assert router.run_concurrently({str(n): (lambda n=n: spark.range(n).count()) for n in range(4)}) == {str(n): n for n in range(4)}


def test_global_positions_and_sums(spark):
    df = spark.createDataFrame([((i * 7919) % 1009, i % 5) for i in range(1009)], "k int, v int").repartition(7)
    got = R.global_position(df, [F.col("k").desc()]).collect()
    assert all(r.position == 1008 - r.k for r in got) and len(got) == 1009
    run = R.global_running_sum(df, [F.col("k").asc()], "v", "c").orderBy("k").collect()
    total = 0
    for r in run:
        total += r.v
        assert r.c == total
    assert R.global_position(df.limit(0), [F.col("k").asc()]).count() == 0
