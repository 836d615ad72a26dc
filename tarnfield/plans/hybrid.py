"""Filtered vector search over a star schema: the query object and its interchangeable strategies.

Every exact strategy gives the same rows in the same order; they differ in where the predicate is applied. The
candidate relation joins vectors, facts, products and grants; dimensions are broadcast by Spark where their measured
size allows it, so a query with small dimensions moves k rows per task and nothing else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions.vector import is_valid, l2, literal
from tarnfield.operators import predicate as P
from tarnfield.operators import topk as K
from tarnfield.operators.bloom import build_bloom, id_bitmap, may_contain
from tarnfield.session import load

#: Workload -> which validity it applies: none, that of the grant, that of the fact, or both.
WORKLOADS = {"acl_only": (), "grant_validity": ("grant",), "fact_validity": ("fact",), "both_validity": ("grant", "fact")}
#: the three workloads of the grid
GRID_WORKLOADS = ("acl_only", "grant_validity", "fact_validity")


def valid_at(as_of: int | Column, start: Column | str = "valid_from", end: Column | str = "valid_to") -> Column:
    """Half-open validity [start, end), a null end being open."""
    s, e = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    t = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return (s <= t) & (e.isNull() | (e > t))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """The candidate relation of the shared test tables: vectors, facts (orders) and products (customers)."""
    o = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("product_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"),
    )
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_nationkey").alias("tenant_id"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("balance"))
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return e.join(o, "id").join(c, "product_id")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """(review_id, product_id, tenant_id, valid_from, valid_to) of all facts, with or without a vector."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("product_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_nationkey").alias("tenant_id"))
    return o.join(c, "product_id").select("review_id", "product_id", "tenant_id", "valid_from", "valid_to")


def secured(rows: DataFrame, grants: DataFrame, principal: str) -> DataFrame:
    """Row-level security: rows whose tenant the principal may read."""
    mine = grants.where((F.col("principal_name") == principal) & F.col("can_read")).select("tenant_id", F.col("valid_from").alias("grant_from"), F.col("valid_to").alias("grant_to"))
    return rows.join(mine, "tenant_id")


@dataclass(frozen=True)
class HybridQuery:
    """One filtered search; ``guide`` may prune but never decides, the predicate is always applied."""

    vector: Sequence[float]
    predicate: object
    k: int = 10
    workload: str = "acl_only"
    principal: str | None = None
    as_of: int | None = None
    exclude: int | None = None
    candidate_valid: bool = True
    columns: tuple[str, ...] = field(default=("id", "distance"))


def candidates(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """All rows a query may return: no vector work, no limit."""
    out = rows
    if query.principal is not None:
        out = secured(out, grants, query.principal)
        kinds = WORKLOADS[query.workload]
        if "grant" in kinds:
            out = out.where(valid_at(query.as_of, "grant_from", "grant_to"))
        if "fact" in kinds:
            out = out.where(valid_at(query.as_of))
    out = out.where(query.predicate.to_column())
    if query.exclude is not None:
        out = out.where(F.col("id") != query.exclude)
    return out.where(is_valid("embedding")) if query.candidate_valid else out


def grid(rows: DataFrame, grants: DataFrame, principal: str, filters: Mapping[str, object], queries: DataFrame, k: int, *, as_of: Mapping[str, int], block_rows: int = 4096) -> DataFrame:
    """(workload, filter_name, query_id, id, distance_sq, rank_no): every workload with every filter, for a query set.

    The candidates are joined and secured once; what tells workloads and filters apart is a set of bits per row, so a
    distance is computed once per row and query. ``as_of`` has the time of each workload that applies a validity.
    """
    seen = secured(rows, grants, principal).where(is_valid("embedding"))
    when = {"grant": ("grant_from", "grant_to"), "fact": ("valid_from", "valid_to")}
    arms = {}
    for w in GRID_WORKLOADS:
        kinds, holds = WORKLOADS[w], F.lit(True)
        for kind in kinds:
            holds = holds & valid_at(as_of[w], *when[kind])
        arms |= {f"{w}/{name}": holds & tree.to_column() for name, tree in filters.items()}
    best = K.batch_nearest_by(seen, arms, queries, k, block_rows=block_rows)
    at = F.split("filter_name", "/", 2)
    return best.select(at[0].alias("workload"), at[1].alias("filter_name"), "query_id", "id", "distance_sq", "rank_no")


def _top(rows: DataFrame, query: HybridQuery) -> DataFrame:
    scored = rows.withColumn("distance", l2("embedding", literal(query.vector)))
    return scored.orderBy("distance", "id").limit(query.k).select(*query.columns)


def prefilter(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Exact: filter, then distance, then top k. The others must equal it."""
    return _top(candidates(query, rows, grants), query)


def allow_list(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Exact: ids first, then a semi join of the bare vectors."""
    ids = candidates(query, rows, grants).select("id")
    return _top(rows.select("id", "embedding").join(ids, "id", "left_semi"), query)


def parallel_join(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None, *, fetch: int | None = None) -> DataFrame:
    """The ids of the predicate and the nearest vectors, computed apart and joined; exact without ``fetch``."""
    near = rows.select("id", "embedding").withColumn("distance", l2("embedding", literal(query.vector)))
    if fetch:
        near = near.orderBy("distance", "id").limit(fetch)
    ids = candidates(query, rows, grants).select("id")
    return near.join(ids, "id").orderBy("distance", "id").limit(query.k).select(*query.columns)


def post_filter(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None, *, fetch: int = 100) -> DataFrame:
    """Nearest ``fetch`` rows first, then the predicate: may return fewer than k, always a subset of the exact order."""
    near = rows.withColumn("distance", l2("embedding", literal(query.vector))).orderBy("distance", "id").limit(fetch)
    return candidates(query, near, grants).orderBy("distance", "id").limit(query.k).select(*query.columns)


def post_filter_until(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None, *, fetch: int = 100) -> DataFrame:
    """Post-filtering with the fetched number doubled until k rows are found or all rows were fetched."""
    total = rows.count()
    while fetch < total and post_filter(query, rows, grants, fetch=fetch).count() < query.k:
        fetch *= 2
    return post_filter(query, rows, grants, fetch=fetch)


def sidecar(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Exact: predicate columns in a narrow sidecar, EXISTS on it."""
    narrow = rows.drop("embedding")
    ids = candidates(HybridQuery(**{**query.__dict__, "candidate_valid": False}), narrow, grants).select("id")
    vectors = rows.select("id", "embedding").join(ids, "id", "left_semi")
    return _top(vectors.where(is_valid("embedding")) if query.candidate_valid else vectors, query)


def memberships(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """(filter_id, id): posting lists of a filter catalog, all from one pass."""
    hits = F.array_compact(F.array(*(F.when(t.to_column(), F.lit(name)) for name, t in filters.items())))
    return rows.select("id", F.explode(hits).alias("filter_id")).select("filter_id", "id")


def by_membership(query: HybridQuery, rows: DataFrame, members: DataFrame, filter_id: str, grants: DataFrame | None = None) -> DataFrame:
    """Exact: semi join with the posting list, the predicate checked again."""
    ids = members.where(F.col("filter_id") == filter_id).select("id")
    return _top(candidates(query, rows.join(ids, "id", "left_semi"), grants), query)


def guided(query: HybridQuery, rows: DataFrame, guide: P.Guide, grants: DataFrame | None = None) -> DataFrame:
    """Exact: prunes by a guide if the predicate implies it, else ignores the guide; the predicate decides."""
    tree = P.Or(tuple(P.And(tuple(P.Not(a.tree) if a.negated else a.tree for a in g)) if len(g) > 1 else (P.Not(g[0].tree) if g[0].negated else g[0].tree) for g in guide.groups))
    tree = tree.parts[0] if len(tree.parts) == 1 else tree
    pruned = rows.where(guide.to_column()) if P.implies(query.predicate, tree) else rows
    return _top(candidates(query, pruned, grants), query)


def bitmap_selector(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Exact: allow-list as packed bitmaps, one per bucket of ids."""
    from tarnfield.operators.bloom import bitmap_filter

    bitmap = id_bitmap(candidates(query, rows, grants))
    return _top(bitmap_filter(rows.select("id", "embedding"), bitmap), query)


def bloom_candidates(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Exact: a Bloom filter of the matching ids prunes (no false negatives), the predicate is checked again."""
    bloom = build_bloom(candidates(query, rows, grants).select("id"))
    return _top(candidates(query, rows.where(may_contain(bloom)), grants), query)


def page_candidates(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None, *, page: str | None = None, page_rows: int = 64) -> DataFrame:
    """Exact: pages (ranges of ids, or a page column) that hold a match, then all their rows with the predicate
    checked again."""
    pages = (F.col(page) if page else F.floor(F.col("id") / page_rows)).alias("__page")
    hit = candidates(query, rows, grants).select(pages).distinct()
    return _top(candidates(query, rows.withColumn("__page", pages).join(hit, "__page", "left_semi"), grants), query)


def limited_candidates(query: HybridQuery, rows: DataFrame, grants: DataFrame | None = None, *, candidates_at_most: int, matches_at_most: int) -> DataFrame:
    """The stream of nearest rows cut by a lossy filter under two limits: of the ``candidates_at_most`` nearest rows
    those that a Bloom filter of the matching ids lets pass, checked again, the first ``matches_at_most`` of them. A
    limit that is met may leave out farther matches; what is returned always satisfies the predicate."""
    bloom = build_bloom(candidates(query, rows, grants).select("id"))
    near = rows.withColumn("distance", l2("embedding", literal(query.vector))).orderBy("distance", "id").limit(candidates_at_most)
    return candidates(query, near.where(may_contain(bloom)), grants).orderBy("distance", "id").limit(matches_at_most).select(*query.columns)


STRATEGIES = {
    "prefilter": prefilter, "allow_list": allow_list, "parallel_join": parallel_join, "sidecar": sidecar,
    "bitmap": bitmap_selector, "bloom": bloom_candidates, "page": page_candidates,
}


def candidate_sql(query: HybridQuery, table: str, grants: str = "grants") -> str:
    """SQL of the candidate relation: joins, access rule, validity and predicate, no vectors and no limit."""
    joins, where = f"{table} v", [P.sql_of(query.predicate, "v")]
    if query.principal is not None:
        name = query.principal.replace("'", "''")
        joins += f" JOIN {grants} g ON g.tenant_id = v.tenant_id AND g.can_read AND g.principal_name = '{name}'"
        for kind, alias in (("grant", "g"), ("fact", "v")):
            if kind in WORKLOADS[query.workload]:
                where.append(f"{alias}.valid_from <= {int(query.as_of)} AND ({alias}.valid_to IS NULL OR {alias}.valid_to > {int(query.as_of)})")
    if query.exclude is not None:
        where.append(f"v.id <> {int(query.exclude)}")
    if "list_has_a" in where[0]:
        raise P.PredicateError("array tests have a DataFrame form only")
    return f"SELECT v.id FROM {joins} WHERE {' AND '.join(where)} ORDER BY v.id"


def hybrid_sql(query: HybridQuery, table: str, grants: str = "grants") -> str:
    """SQL of the whole search, for ``spark.sql`` over registered views."""
    q = ", ".join(f"{float(x)!r}D" for x in query.vector)
    ids = candidate_sql(query, table, grants).removesuffix(" ORDER BY v.id")
    distance = f"sqrt(aggregate(zip_with(v.embedding, array({q}), (a, b) -> (CAST(a AS DOUBLE) - b) * (CAST(a AS DOUBLE) - b)), 0D, (s, x) -> s + x))"
    valid = " AND aggregate(v.embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x) > 0" if query.candidate_valid else ""
    return f"SELECT id, distance FROM ({ids.replace('SELECT v.id FROM', f'SELECT v.id, {distance} AS distance FROM')}{valid}) ORDER BY distance, id LIMIT {query.k}"

