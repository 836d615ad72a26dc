"""Registered queries of the engine over the shared test tables, each beside the SQL it must equal.

Query vectors are rows of ``embeddings``; facts are orders, products are customers, tenants are nations. Distances
are rounded to 6 digits where they are part of a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.functions import arrays as A
from tarnfield.functions import stats as S
from tarnfield.functions import text as X
from tarnfield.functions import vector as V
from tarnfield.operators import predicate as P
from tarnfield.operators import relational as R
from tarnfield.operators import topk as K
from tarnfield.operators.bloom import id_bitmap
from tarnfield.plans import hybrid as H
from tarnfield.plans import workload as W
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


#: Filter catalog over the candidate relation, from wide to narrow.
FILTERS = {
    "wide": "label < 5",
    "balance": "balance >= 4500",
    "urgent": "priority = '1-URGENT' OR priority = '2-HIGH'",
    "building": "category = 'BUILDING' AND label >= 2",
    "price_band": "price >= 100000 AND price < 150000",
    "narrow": "NOT (label < 8) AND price < 60000",
    "rare": "category = 'MACHINERY' AND label = 3 AND balance > 2000",
}
COLUMNS = {"id": "bigint", "label": "int", "price": "double", "priority": "string", "category": "string", "balance": "double", "tenant_id": "int"}
TREES = {k: P.parse(v, COLUMNS) for k, v in FILTERS.items()}
PRINCIPAL, COVER_X100 = "analyst", 5000

# ---------------------------------------------------------------- SQL building blocks

_B = """b AS (SELECT vec_id AS id, embedding, label, epoch_ms(o_orderdate) AS valid_from, CAST(NULL AS BIGINT) AS valid_to, o_totalprice AS price,
  o_orderpriority AS priority, c_custkey AS product_id, c_mktsegment AS category, c_acctbal AS balance, c_nationkey AS tenant_id
  FROM embeddings JOIN orders ON o_orderkey = vec_id JOIN customer ON c_custkey = o_custkey)"""
_F = """f AS (SELECT o_orderkey AS review_id, o_custkey AS product_id, c_nationkey AS tenant_id, epoch_ms(o_orderdate) AS valid_from
  FROM orders JOIN customer ON c_custkey = o_custkey)"""
_V = "v AS (SELECT tenant_id, count(*) AS review_count FROM f GROUP BY tenant_id)"
_G = f"""g AS (SELECT tenant_id, review_count, CAST(cumulative AS BIGINT) AS cumulative FROM (
  SELECT *, sum(review_count) OVER (ORDER BY review_count DESC, tenant_id ROWS UNBOUNDED PRECEDING) AS cumulative, sum(review_count) OVER () AS total FROM v)
  WHERE cumulative - review_count < (CAST(total AS BIGINT) * {COVER_X100} + 9999) // 10000)"""
_L2 = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))"
_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"


def l2sql(a: str = "b.embedding", b: str = "q.embedding") -> str:
    return _L2.format(a=a, b=b)


def sqsql(a: str = "b.embedding", b: str = "q.embedding") -> str:
    return _SQ.format(a=a, b=b)


_T = "tg AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey % 50)) AS tags FROM lineitem GROUP BY l_orderkey)"


def grants(spark: SparkSession, d: str) -> DataFrame:
    """The grants as a table of their own: its measured size lets Spark broadcast it at planning time, so that vectors
    are joined where they are read instead of being shuffled by tenant."""
    return stored(W.grants(H.facts(spark, d), PRINCIPAL, COVER_X100), "grants")


def vector_of(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    """One query vector: a bounded parameter of the query."""
    return [float(x) for x in load(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


def query_set(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: every vector whose id is divisible by 50."""
    return load(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 50).alias("t"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("tags"))


# ---------------------------------------------------------------- filtered search

_FLAG = f"""WITH {_B}, {_F}, {_V}, {_G}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
SELECT id, round(distance, 6) AS distance FROM (SELECT b.id, {l2sql()} AS distance FROM b JOIN g USING (tenant_id) CROSS JOIN q
  WHERE label < 5 AND id <> 0 ORDER BY distance, id LIMIT 10)"""


def _flag_query(spark: SparkSession, d: str) -> tuple[H.HybridQuery, DataFrame, DataFrame]:
    q = H.HybridQuery(vector_of(spark, d, 0), TREES["wide"], k=10, principal=PRINCIPAL, exclude=0)
    return q, H.reviews(spark, d), grants(spark, d)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("distance", 6).alias("distance"))


@query(_FLAG)
def hybrid_acl(spark, d):
    """Flagship: top 10 under row-level security, predicate and self exclusion."""
    return _rounded(H.prefilter(*_flag_query(spark, d)))


@query(_FLAG)
def strategy_allow_list(spark, d):
    return _rounded(H.allow_list(*_flag_query(spark, d)))


@query(_FLAG)
def strategy_parallel_join(spark, d):
    return _rounded(H.parallel_join(*_flag_query(spark, d)))


@query(_FLAG)
def strategy_sidecar(spark, d):
    return _rounded(H.sidecar(*_flag_query(spark, d)))


@query(_FLAG)
def strategy_bitmap(spark, d):
    return _rounded(H.bitmap_selector(*_flag_query(spark, d)))


@query(_FLAG)
def strategy_bloom(spark, d):
    return _rounded(H.bloom_candidates(*_flag_query(spark, d)))


@query(_FLAG)
def strategy_page(spark, d):
    return _rounded(H.page_candidates(*_flag_query(spark, d)))


@query(_FLAG)
def strategy_membership(spark, d):
    q, rows, g = _flag_query(spark, d)
    return _rounded(H.by_membership(q, rows, H.memberships(rows, TREES), "wide", g))


@query(_FLAG)
def strategy_guided(spark, d):
    q, rows, g = _flag_query(spark, d)
    return _rounded(H.guided(q, rows, P.guide(["sql:label < 7"], COLUMNS), g))


@query(_FLAG)
def strategy_fragments(spark, d):
    """Pruned by registered fragments of a disjunction, then filtered again."""
    from tarnfield.operators.fragments import Registry

    q, rows, g = _flag_query(spark, d)
    registry = Registry()
    return _rounded(H.prefilter(q, registry.apply("reviews", rows, P.guide(["label < 3", "|", "label < 6"], COLUMNS), q.predicate), g))


@query(f"""WITH {_B}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
n AS (SELECT b.*, {l2sql()} AS distance FROM b CROSS JOIN q ORDER BY distance, id LIMIT 100)
SELECT id, round(distance, 6) AS distance FROM n WHERE label < 5 AND id <> 0 ORDER BY n.distance, id LIMIT 10""")
def strategy_post_filter(spark, d):
    q, rows, _ = _flag_query(spark, d)
    return _rounded(H.post_filter(H.HybridQuery(**{**q.__dict__, "principal": None}), rows, fetch=100))


def _grid_sql() -> str:
    keep = ", ".join(f"({P.sql_of(t, 'b')}) AS f_{n}" for n, t in TREES.items())
    arms = " UNION ALL ".join(f"SELECT '{n}' AS filter_name, * FROM c WHERE f_{n}" for n in TREES)
    return f"""WITH {_B}, {_F}, {_V}, {_G}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT b.*, {keep} FROM b JOIN g USING (tenant_id)), a AS ({arms}),
p AS (SELECT filter_name, query_id, id, {sqsql("a.embedding")} AS d FROM a CROSS JOIN q WHERE id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY filter_name, query_id ORDER BY d, id) AS rank_no FROM p)"""


def _grid(spark, d, k: int) -> DataFrame:
    rows = H.secured(H.reviews(spark, d), grants(spark, d), PRINCIPAL)
    return K.batch_nearest_by(rows, {n: t.to_column() for n, t in TREES.items()}, query_set(spark, d), k)


@query(_grid_sql() + " SELECT filter_name, query_id, id, rank_no, round(d, 6) AS distance_sq FROM r WHERE rank_no <= 10")
def batch_topk(spark, d):
    """All filters and queries at once: distances once per row and query, k rows per filter, query and batch leave the scan."""
    return _grid(spark, d, 10).select("filter_name", "query_id", "id", "rank_no", F.round("distance_sq", 6).alias("distance_sq"))


@query(f"""WITH {_B}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, id, {sqsql()} AS d FROM b CROSS JOIN q WHERE id <> query_id)
SELECT query_id, id, round(d, 6) AS distance_sq, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank_no FROM p) WHERE rank_no <= 10""")
def batch_topk_matrix(spark, d):
    """The matrix form of the same: Arrow batches against the query block, partial top k per batch."""
    import numpy as np

    found = None
    for block in K.query_blocks(query_set(spark, d), "query_id", 4096):
        rows = block.orderBy("query_id").collect()  # one block of the stated query set
        part = V.batch_topk(H.reviews(spark, d), [r.query_id for r in rows], np.array([r.query_vector for r in rows], float), 10)
        found = part if found is None else found.unionByName(part)
    best = K.ranked(found, ["query_id"], [F.col("distance_sq"), F.col("id")], 10)
    return best.select("query_id", "id", F.round("distance_sq", 6).alias("distance_sq"), "rank_no")


_TRUTH = _grid_sql() + """, t AS (SELECT filter_name, query_id, list(id ORDER BY rank_no) FILTER (rank_no <= 10) AS exact_ids, max(d) FILTER (rank_no = 10) AS kth, max(d) FILTER (rank_no = 11) AS nxt,
  list(d) FILTER (rank_no <= 10) AS ds FROM r WHERE rank_no <= 11 GROUP BY ALL), u AS (SELECT *, greatest(1e-9, abs(kth) * 1e-6) AS tol FROM t)"""


@query(_TRUTH + """ SELECT filter_name, query_id, array_to_string(exact_ids, ',') AS exact_ids, round(kth, 6) AS kth_distance_sq,
CAST(len(list_filter(ds, lambda x: x < kth - tol)) AS BIGINT) AS strict_closer_count, coalesce(nxt <= kth + tol, false) AS boundary_tied FROM u WHERE kth IS NOT NULL""")
def ground_truth(spark, d):
    t = K.truth(_grid(spark, d, 11), ["filter_name", "query_id"], 10).where("kth_distance_sq IS NOT NULL")
    return t.select("filter_name", "query_id", F.array_join(F.transform("exact_ids", lambda x: x.cast("string")), ",").alias("exact_ids"), F.round("kth_distance_sq", 6).alias("kth_distance_sq"), "strict_closer_count", "boundary_tied")


@query(_grid_sql() + """, s AS (SELECT filter_name, query_id, row_number() OVER (PARTITION BY filter_name, query_id ORDER BY d, id) AS rn, p.id AS id, d FROM p JOIN embeddings e ON e.vec_id = id WHERE e.label <> 3),
t AS (SELECT filter_name, query_id, max(d) FILTER (rank_no = 10) AS kth, list(id) FILTER (rank_no <= 10) AS ids FROM r GROUP BY ALL HAVING kth IS NOT NULL),
h AS (SELECT filter_name, query_id, list(id) AS got, count(DISTINCT id) FILTER (d <= kth + greatest(1e-9, abs(kth) * 1e-6)) AS hit FROM s JOIN t USING (filter_name, query_id) WHERE rn <= 10 GROUP BY ALL)
SELECT filter_name, query_id, least(10, hit) AS hits, round(least(10, hit) / 10, 6) AS recall, round(len(list_intersect(got, ids)) / 10, 6) AS id_recall FROM h JOIN t USING (filter_name, query_id)""")
def recall_of_subset(spark, d):
    """Tie-aware and id recall of an approximate result (here: a search that misses one region, label 3)."""
    full = _grid(spark, d, 11)
    group = ["filter_name", "query_id"]
    t = K.truth(full, group, 10).where("kth_distance_sq IS NOT NULL")
    rows = H.secured(H.reviews(spark, d), grants(spark, d), PRINCIPAL).where("label <> 3")
    got = K.batch_nearest_by(rows, {n: x.to_column() for n, x in TREES.items()}, query_set(spark, d), 10)
    ids = got.groupBy(*group).agg(A.ordered_array("id", "rank_no").alias("got"))
    out = K.tie_aware_recall(got, t, group, 10).join(ids, group).join(t.select(*group, "exact_ids"), group)
    return out.select(*group, "hits", F.round("recall", 6).alias("recall"), F.round(A.recall_at("got", "exact_ids", 10), 6).alias("id_recall"))


@query(f"""WITH {_B}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 3), p AS (SELECT id, {l2sql()} AS x FROM b CROSS JOIN q)
SELECT id, round(x, 6) AS distance FROM p QUALIFY rank() OVER (ORDER BY x) <= 25""")
def boundary_rows(spark, d):
    """Everything up to the 25th distance, ties included."""
    rows = H.reviews(spark, d).select(F.lit(0).alias("g"), "id", V.l2("embedding", V.literal(vector_of(spark, d, 3))).alias("distance"))
    return _rounded(K.boundary_set(rows, ["g"], "distance", 25))


#: Fourteen filters of the grid, from wide to narrow.
GRID_FILTERS = {
    "label_lt8": "label < 8", "balance_ge0": "balance >= 0", "wide": "label < 5", "balance": "balance >= 4500", "price_ge150k": "price >= 150000", "urgent": "priority = '1-URGENT' OR priority = '2-HIGH'", "not_low": "NOT (priority = '5-LOW') AND label < 4",
    "building": "category = 'BUILDING' AND label >= 2", "price_band": "price >= 100000 AND price < 150000", "rich_urgent": "balance >= 7000 AND priority = '1-URGENT'", "narrow": "NOT (label < 8) AND price < 60000", "machinery": "category = 'MACHINERY' AND label < 3", "one_label": "label = 7 AND balance < 0", "rare": "category = 'MACHINERY' AND label = 3 AND balance > 2000",
}
GRID = {k: P.parse(v, COLUMNS) for k, v in GRID_FILTERS.items()}
GRANT_AS_OF, GRANT_LATER, FACT_AS_OF = 800_000_000_000, 900_000_000_000, 820_454_400_000
_GRID_KEEP = ", ".join(f"({P.sql_of(t, 'b')}) AS f_{n}" for n, t in GRID.items())
_GRID_ARMS = " UNION ALL ".join(f"SELECT '{w}' AS workload, '{n}' AS filter_name, * FROM c WHERE {cond} AND f_{n}" for w, cond in (("acl_only", "true"), ("grant_validity", "granted"), ("fact_validity", f"valid_from <= {FACT_AS_OF}")) for n in GRID)


@query(f"""WITH {_B}, {_F}, {_V}, {_G}, q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
o AS (SELECT tenant_id, sum(review_count) OVER (ORDER BY review_count, tenant_id ROWS UNBOUNDED PRECEDING) - review_count < (CAST(sum(review_count) OVER () AS BIGINT) * 3000 + 9999) // 10000 AS granted FROM g),
c AS (SELECT b.*, granted, {_GRID_KEEP} FROM b JOIN o USING (tenant_id)), a AS ({_GRID_ARMS}),
p AS (SELECT workload, filter_name, query_id, id, {sqsql("a.embedding", "qv")} AS d FROM a CROSS JOIN q WHERE id <> query_id)
SELECT workload, filter_name, query_id, id, round(d, 6) AS distance_sq, row_number() OVER (PARTITION BY workload, filter_name, query_id ORDER BY d, id) AS rank_no FROM p QUALIFY rank_no <= 10""")
def hybrid_grid(spark, d):
    """Three workloads with fourteen filters, top 10 of every query of the set; grants are prepared once."""
    granted = stored(W.grant_validity(grants(spark, d), H.facts(spark, d), GRANT_AS_OF, GRANT_LATER, 3000), "calibrated")
    rows = H.grid(H.reviews(spark, d), granted, PRINCIPAL, GRID, query_set(spark, d), 10, as_of={"grant_validity": GRANT_AS_OF, "fact_validity": FACT_AS_OF})
    return rows.withColumn("distance_sq", F.round("distance_sq", 6))


@query(f"""WITH {_B}, {_F}, {_V}, {_G}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
SELECT id, round({l2sql()}, 6) AS distance FROM b JOIN g USING (tenant_id) CROSS JOIN q WHERE price >= 100000 AND price < 150000 AND valid_from <= 820454400000
ORDER BY {l2sql()}, id LIMIT 10""")
def hybrid_fact_validity(spark, d):
    """Row-level security, predicate, and validity of grant and fact at a time."""
    q = H.HybridQuery(vector_of(spark, d, 0), TREES["price_band"], workload="fact_validity", principal=PRINCIPAL, as_of=820454400000)
    return _rounded(H.prefilter(q, H.reviews(spark, d), grants(spark, d)))


@query(f"WITH {_B}, {_F}, {_V}, {_G} SELECT id FROM b JOIN g USING (tenant_id) WHERE {P.sql_of(TREES['building'])}")
def candidate_export(spark, d):
    """The candidate relation without vectors, unbounded."""
    q = H.HybridQuery([], TREES["building"], principal=PRINCIPAL, candidate_valid=False)
    return H.candidates(q, H.reviews(spark, d).drop("embedding"), grants(spark, d)).select("id")


@query(f"WITH {_B}, {_F}, {_V}, {_G} SELECT id FROM b JOIN g USING (tenant_id) WHERE {P.sql_of(TREES['building'])} ORDER BY id LIMIT 20")
def candidate_export_bounded(spark, d):
    """The first candidates by id."""
    q = H.HybridQuery([], TREES["building"], principal=PRINCIPAL, candidate_valid=False)
    return H.candidates(q, H.reviews(spark, d).drop("embedding"), grants(spark, d)).select("id").orderBy("id").limit(20)


@query(f"""WITH {_B}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), n AS (SELECT b.id, label, {l2sql()} AS s FROM b CROSS JOIN q ORDER BY s, b.id LIMIT 60)
SELECT id, round(s, 6) AS distance FROM n WHERE label < 5 AND id <> 0 ORDER BY s, id LIMIT 7""")
def strategy_limited(spark, d):
    """Lossy candidates under a limit of rows looked at and a limit of matches."""
    q, rows, _ = _flag_query(spark, d)
    q = H.HybridQuery(**{**q.__dict__, "principal": None})
    return _rounded(H.limited_candidates(q, rows, candidates_at_most=60, matches_at_most=7))


@query(f"""WITH {_B}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
SELECT b.id, round({l2sql()}, 6) AS distance FROM b CROSS JOIN q WHERE category = 'MACHINERY' AND label = 3 AND balance > 2000 AND b.id <> 0 ORDER BY {l2sql()}, b.id LIMIT 10""")
def strategy_growing_fetch(spark, d):
    """Post-filtering of a rare filter with the fetched number grown until ten rows are found or none is left."""
    q, rows, _ = _flag_query(spark, d)
    return _rounded(H.post_filter_until(H.HybridQuery(**{**q.__dict__, "principal": None, "predicate": TREES["rare"]}), rows, fetch=20))


@query(f"WITH {_B} " + " UNION ALL ".join(f"SELECT '{n}' AS filter_name, count(*) FILTER ({P.sql_of(t)}) AS rows, count(*) AS total FROM b" for n, t in TREES.items()))
def selectivity(spark, d):
    """Rows of every filter, from one pass."""
    return P.selectivities(H.reviews(spark, d).drop("embedding"), {n: t.to_column() for n, t in TREES.items()})


@query(f"""WITH {_B}, q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, id, {sqsql()} AS d FROM b CROSS JOIN q WHERE id <> query_id AND label = query_id // 50 % 10)
SELECT query_id, id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 5""")
def knn_join(spark, d):
    """kNN join: the filter of each query depends on its own row."""
    q = query_set(spark, d).withColumn("label", F.expr("query_id div 50 % 10").cast("int"))
    pairs = H.reviews(spark, d).join(q, "label").where(F.col("id") != F.col("query_id"))
    pairs = pairs.select("query_id", "id", V.l2_squared("embedding", "query_vector").alias("distance_sq"))
    return K.ranked(pairs, ["query_id"], [F.col("distance_sq"), F.col("id")], 5).select("query_id", "id")


@query(f"""WITH {_B}, a AS (SELECT b.id FROM b CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE label < 5 ORDER BY {l2sql()}, b.id LIMIT 3),
c AS (SELECT b.id FROM b CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 2) q WHERE label >= 5 ORDER BY {l2sql()}, b.id LIMIT 4)
SELECT a.id AS id_a, c.id AS id_b FROM a CROSS JOIN c""")
def cross_of_topk(spark, d):
    """Cross product of two independent filtered top-k results (3 x 4 rows)."""
    rows = H.reviews(spark, d)
    a = K.nearest(rows.where("label < 5"), V.literal(vector_of(spark, d, 1)), 3).select(F.col("id").alias("id_a"))
    b = K.nearest(rows.where("label >= 5"), V.literal(vector_of(spark, d, 2)), 4).select(F.col("id").alias("id_b"))
    return a.crossJoin(b)


@query(f"""WITH {_B} SELECT a.id AS id, round({l2sql('a.embedding', 'x.embedding')}, 6) AS l2, round({sqsql('a.embedding', 'x.embedding')}, 6) AS l2_squared,
round(list_sum(list_transform(list_zip(a.embedding, x.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS dot,
round(sqrt(list_sum(list_transform(a.embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))), 6) AS norm, true AS valid
FROM b a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) x""")
def vector_functions(spark, d):
    q = V.literal(vector_of(spark, d, 7))
    e = "embedding"
    return H.reviews(spark, d).select("id", F.round(V.l2(e, q), 6).alias("l2"), F.round(V.l2_squared(e, q), 6).alias("l2_squared"), F.round(V.dot(e, q), 6).alias("dot"), F.round(V.norm(e), 6).alias("norm"), V.is_valid(e).alias("valid"))


@query(f"""WITH c(id, rank_no) AS (VALUES (17, 1), (4, 2), (250, 3), (99, 4)), q AS (SELECT embedding FROM embeddings WHERE vec_id = 5)
SELECT vec_id AS id, CAST(rank_no AS BIGINT) AS rank_no, CAST(row_number() OVER (ORDER BY {l2sql('e.embedding')}, vec_id) AS BIGINT) AS exact_rank FROM embeddings e JOIN c ON id = vec_id CROSS JOIN q""")
def exact_rerank(spark, d):
    """Candidates in their given order, fetched by id and ranked by exact distance."""
    given = spark.createDataFrame([(17, 1), (4, 2), (250, 3), (99, 4)], "id bigint, rank_no bigint")
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(given, "id")
    w = Window.orderBy(V.l2("embedding", V.literal(vector_of(spark, d, 5))), "id")  # four rows
    return rows.select("id", "rank_no", F.row_number().over(w).cast("bigint").alias("exact_rank"))


# ---------------------------------------------------------------- predicates and arrays


@query(f"WITH {_T} SELECT id FROM tg WHERE list_has_all(tags, [3, 7])")
def tags_contain_all(spark, d):
    return tagged(spark, d).where(A.contains_all("tags", [3, 7])).select("id")


@query(f"WITH {_T} SELECT id FROM tg WHERE list_has_any(tags, [1, 2])")
def tags_overlap(spark, d):
    return tagged(spark, d).where(A.overlaps("tags", [1, 2])).select("id")


@query(f"WITH {_T} SELECT id FROM tg WHERE list_has_any(tags, [11]) OR (len(tags) >= 5 AND len(tags) < 7)")
def label_or_range(spark, d):
    return tagged(spark, d).where(A.overlaps("tags", [11]) | A.between(F.size("tags"), 5, 7)).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 150000 THEN 1 WHEN o_totalprice < 200000 THEN 2 END AS atom FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 200000")
def range_atoms(spark, d):
    """A range decomposed into bucket atoms; each row falls into one of them."""
    atoms = A.range_atoms("o_totalprice", 50_000, 200_000, [100_000, 150_000, 500_000])
    atom = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(atoms)))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), atom.alias("atom")).where("atom IS NOT NULL")


@query(f"WITH {_T}, x AS (SELECT id, unnest(tags) AS label FROM tg), c AS (SELECT label, count(*) AS n FROM x GROUP BY label) SELECT label, n FROM c")
def label_frequency(spark, d):
    return tagged(spark, d).select(F.explode("tags").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {_T}, x AS (SELECT id, unnest(tags) AS label FROM tg), h AS (SELECT label, count(*) AS n FROM x GROUP BY label ORDER BY n DESC, label LIMIT 6)
SELECT a.label AS label_a, b.label AS label_b, (SELECT count(DISTINCT id) FROM x WHERE label IN (a.label, b.label)) AS union_size FROM h a JOIN h b ON a.label < b.label""")
def label_pair_unions(spark, d):
    return R.label_pair_unions(tagged(spark, d), "id", "tags", 6)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (5, 6, 7, 1000, 1400) AND (o_orderstatus IS DISTINCT FROM 'F') AND o_totalprice IS NOT NULL")
def ids_any(spark, d):
    return load(spark, d, "orders").where(F.col("o_orderkey").isin(5, 6, 7, 1000, 1400) & ~F.col("o_orderstatus").eqNullSafe("F") & F.col("o_totalprice").isNotNull()).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice < 60000 AND o_orderkey * 2 - o_orderkey = o_orderkey")
def tautology_levels(spark, d):
    tree = P.parse("o_totalprice < 60000", {"o_totalprice": "double"})
    return load(spark, d, "orders").where(P.tautology(tree, 2, "o_orderkey")).select(F.col("o_orderkey").alias("id"))


@query("""SELECT 'id_range' AS name, count(*) FILTER (o_orderkey >= 100 AND o_orderkey < 700) AS rows FROM orders UNION ALL SELECT 'modulus', count(*) FILTER (o_orderkey % 7 = 0) FROM orders""")
def difficulty_filters(spark, d):
    o = load(spark, d, "orders")
    counts = P.selectivities(o, {"id_range": A.between("o_orderkey", 100, 700), "modulus": F.col("o_orderkey") % 7 == 0})
    return counts.select(F.col("filter_name").alias("name"), "rows")


REVIEWS = "amazon_grocery_reviews_10m_pgvector"
_COUNTED = {"named": P.NAMED, "catalog": {n: t for n, (_, t) in P.CATALOG.items()}}


@query(" UNION ALL ".join(f"SELECT '{g}' AS family, '{n}' AS filter_name, count(*) FILTER ({t}) AS rows, count(*) AS total FROM {REVIEWS}" for g, x in _COUNTED.items() for n, t in x.items()))
def named_selectivity(spark, d):
    """Rows of every named predicate and of the filter catalog, from one pass over the review table."""
    trees = {f"{g}/{n}": P.parse(t, P.REVIEW_COLUMNS).to_column() for g, x in _COUNTED.items() for n, t in x.items()}
    at = F.split("filter_name", "/", 2)
    rows = P.selectivities(load(spark, d, REVIEWS).drop("embedding"), trees)
    return rows.select(at[0].alias("family"), at[1].alias("filter_name"), "rows", "total")


_BUCKETS = """greatest(1, least(5, CAST(trunc(coalesce({r}, 5)) AS INTEGER))) AS stars,
CASE WHEN NOT coalesce(has_price, false) THEN 'p_missing' WHEN coalesce(price, 0) <= 10 THEN 'p_le10' WHEN price <= 20 THEN 'p_10_20' WHEN price <= 50 THEN 'p_20_50' ELSE 'p_gt50' END AS price_label,
CASE WHEN coalesce(item_rating_number, 0) >= 1000 THEN 'pop_high' WHEN coalesce(item_rating_number, 0) >= 100 THEN 'pop_mid' ELSE 'pop_low' END AS popularity_label"""


@query(f"""WITH a AS (SELECT id, any_value(has_price) AS has_price, any_value(price) AS price, any_value(item_rating_number) AS item_rating_number FROM {REVIEWS} GROUP BY id HAVING count(DISTINCT (has_price, price, item_rating_number)) = 1),
q AS (SELECT query_no, {_BUCKETS.format(r="ori_rating")} FROM c4_queries JOIN a ON id = query_id), k AS (SELECT DISTINCT stars, price_label, popularity_label FROM q)
SELECT query_no, CASE WHEN stars = 5 THEN 'c4_mixed_5_' || price_label || '_' || popularity_label ELSE 'sql' END AS filter_key,
(SELECT count(*) FROM {REVIEWS} r WHERE r.rating = q.stars AND CASE price_label WHEN 'p_missing' THEN NOT has_price WHEN 'p_le10' THEN has_price AND price <= 10 WHEN 'p_10_20' THEN has_price AND price > 10 AND price <= 20 WHEN 'p_20_50' THEN has_price AND price > 20 AND price <= 50 ELSE has_price AND price > 50 END
AND CASE popularity_label WHEN 'pop_high' THEN item_rating_number >= 1000 WHEN 'pop_mid' THEN item_rating_number >= 100 AND item_rating_number < 1000 ELSE item_rating_number < 100 END) AS rows FROM q""")
def derived_filters(spark, d):
    """The predicate derived from each query row (mode 'mixed'), and how many reviews satisfy it."""
    reviews = load(spark, d, REVIEWS).drop("embedding")
    same = reviews.groupBy("id").agg(F.countDistinct(F.struct("has_price", "price", "item_rating_number")).alias("n"), *(F.max(c).alias(c) for c in ("has_price", "price", "item_rating_number"))).where("n = 1")
    asked = load(spark, d, "c4_queries").join(same, F.col("id") == F.col("query_id"))
    asked = asked.select("query_no", *(c.alias(n) for n, c in P.bucket_columns(F.col("ori_rating"), F.col("has_price"), F.col("price"), F.col("item_rating_number")).items()))
    keys = ["stars", "price_label", "popularity_label"]
    kinds = {r: P.parse(f"rating = {r[0]} AND {P.PRICES[r[1]]} AND {P.POPULARITY[r[2]]}", P.REVIEW_COLUMNS).to_column() for r in ((s, p, q) for s in range(1, 6) for p in P.PRICES for q in P.POPULARITY)}  # 75 predicates
    counts = P.selectivities(reviews, {f"{s}/{p}/{q}": c for (s, p, q), c in kinds.items()})
    at = F.split("filter_name", "/")
    counts = counts.select(at[0].cast("int").alias("stars"), at[1].alias("price_label"), at[2].alias("popularity_label"), "rows")
    key = F.when(F.col("stars") == 5, F.concat_ws("_", F.lit("c4_mixed_5"), "price_label", "popularity_label")).otherwise("sql")
    return asked.join(F.broadcast(counts), keys).select("query_no", key.alias("filter_key"), "rows")


@query(f"""WITH a AS (SELECT id, max(helpful_vote) AS helpful_vote FROM {REVIEWS} GROUP BY id), o AS (SELECT min(ord) AS ord, id FROM pgvector_cluster_order GROUP BY id)
SELECT CAST(row_number() OVER (ORDER BY ord) AS BIGINT) AS position, id, helpful_vote FROM o JOIN a USING (id)""")
def order_table_layout(spark, d):
    """Reviews in the order of a given order table: an id that stands twice takes its first place, ids without a
    review or without a place drop out; of repeated rows of a review the newest vote counts."""
    newest = load(spark, d, REVIEWS).groupBy("id").agg(F.max("helpful_vote").alias("helpful_vote"))
    order = load(spark, d, "pgvector_cluster_order").groupBy("id").agg(F.min("ord").alias("ord"))
    rows = R.global_position(order.join(newest, "id"), [F.col("ord").asc()])
    return rows.select((F.col("position") + 1).alias("position"), "id", "helpful_vote")


# ---------------------------------------------------------------- sources and generated relations


@query("SELECT i AS id, i % 3 AS r FROM generate_series(0, 99) t(i)")
def series(spark, d):
    return spark.range(100).select("id", (F.col("id") % 3).alias("r"))


@query("SELECT DISTINCT * FROM (VALUES ('a', 1), ('b', 2), ('a', 1)) t(k, v)")
def inline_values(spark, d):
    return spark.sql("SELECT DISTINCT k, v FROM VALUES ('a', 1), ('b', 2), ('a', 1) AS t(k, v)")


@query(f"WITH {_T} SELECT id, CAST(i AS BIGINT) AS position, tags[i] AS tag FROM tg, unnest(generate_series(1, len(tags))) u(i)")
def unnest_with_ordinality(spark, d):
    return tagged(spark, d).select("id", F.posexplode("tags").alias("p", "tag")).select("id", (F.col("p") + 1).cast("bigint").alias("position"), "tag")


@query()
def table_sample(spark, d):
    """Repeatable sample (row level), its size only."""
    from tarnfield.sources.files import sample_rows

    return sample_rows(load(spark, d, "orders"), 10, 42).agg(F.count("*").alias("rows"))


# ---------------------------------------------------------------- joins


@query("""WITH m AS (SELECT c_custkey, min(o_orderkey) AS full_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS o_custkey, coalesce(full_id, alt) AS o_orderkey, CASE WHEN full_id IS NOT NULL THEN 'full' ELSE 'fallback' END AS match_type
FROM customer LEFT JOIN m USING (c_custkey) LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS alt FROM orders GROUP BY 1) f ON f.o_custkey = c_custkey WHERE coalesce(full_id, alt) IS NOT NULL""")
def two_key_fallback(spark, d):
    """Anchor of each customer: its first order of status F, else its first order."""
    asked = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    rows = R.two_key_lookup(asked, load(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey", "o_orderstatus"], ["o_custkey"], "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", "match_type")


@query("SELECT o_orderkey AS id, coalesce(c_mktsegment, 'none') AS category FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey")
def left_with_default(spark, d):
    c = load(spark, d, "customer").where("c_acctbal > 0")
    return load(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("id"), F.coalesce("c_mktsegment", F.lit("none")).alias("category"))


@query("""SELECT n_nationkey, o_orderkey FROM nation LEFT JOIN LATERAL (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_nationkey = n_nationkey AND o_totalprice > 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) ON true""")
def left_lateral_top1(spark, d):
    """LEFT JOIN LATERAL ... LIMIT 1 as an aggregate and a left join."""
    rows = load(spark, d, "orders").where("o_totalprice > 300000").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    top = rows.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("o"))).alias("m"))
    return load(spark, d, "nation").join(top, "n_nationkey", "left").select("n_nationkey", (-F.col("m.o")).alias("o_orderkey"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def semi_join(spark, d):
    big = load(spark, d, "orders").where("o_totalprice > 250000")
    return load(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH x AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_totalprice > 100000), y AS (SELECT o_orderkey AS k, o_totalprice + 1 AS v FROM orders WHERE o_orderstatus = 'F')
SELECT k, coalesce(y.v, x.v) AS v FROM x FULL JOIN y USING (k)""")
def shards_last_wins(spark, d):
    o = load(spark, d, "orders")
    x = o.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    y = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"))
    return R.last_write_wins([x, y], ["k"])


@query("""SELECT c_mktsegment, count(*) AS pairs, round(sum(b) / sum(m), 9) AS speedup FROM (
SELECT c_mktsegment, a.o_totalprice AS b, z.o_totalprice AS m FROM orders a JOIN orders z ON z.o_orderkey = a.o_orderkey + 1 JOIN customer ON c_custkey = a.o_custkey) GROUP BY 1""")
def paired_ratio(spark, d):
    o = load(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_custkey").alias("c"))
    b = o.select((F.col("o_orderkey") - 1).alias("k"), F.col("o_totalprice").alias("v"))
    rows = R.paired(a, b, ["k"], "v").join(a.select("k", "c"), "k").join(load(spark, d, "customer"), F.col("c") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("pairs"), F.round(F.sum("baseline") / F.sum("method"), 9).alias("speedup"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def whole_row_audit(spark, d):
    """Keys whose rows differ between two versions of a table."""
    o = load(spark, d, "orders")
    changed = o.withColumn("o_totalprice", F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return R.whole_row_difference(o, changed, ["o_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN least(o_totalprice, 1000.0) ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def update_from(spark, d):
    """UPDATE ... FROM ... with CASE and LEAST as a new version of the table."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    debtors = load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.update_from(o, debtors, ["o_custkey"], {"o_totalprice": F.least(F.col("o_totalprice"), F.lit(1000.0))}).select("o_orderkey", "o_totalprice")
