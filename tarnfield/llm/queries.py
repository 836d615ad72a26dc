"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.clusters import hashed_features, kmeans_groups, similar_groups, typical_members
from tarnfield.llm.leakage import leaked
from tarnfield.llm.moderation import rated_sample, score_documents, train
from tarnfield.llm.neighbours import close_neighbours, search
from tarnfield.llm.packing import containers, count_tokens, pack, split_items
from tarnfield.llm.pairs import PairTable, Support
from tarnfield.llm.percentiles import exact_percentile, merge_groups, percentiles, same_group_join, sketch_groups
from tarnfield.llm.terms import mark_terms, term_records
from tarnfield.llm.topn import latest_rows, top_n
from tarnfield.session import load, stored

AMAZON, YFCC, LAION = "amazon_grocery_reviews_10m_pgvector", "yfcc_tags", "laion_labels"
TRIMMED = r"^\s+|\s+$"

# ---------------------------------------------------------------- problem 1


def _measurements(spark: SparkSession, d: str) -> DataFrame:
    """Valid measurements, one row per result_id: run_method, filter_name (trimmed, lower case), run_day, latency_ms."""
    rows = load(spark, d, "query_result").where(F.col("result_id").isNotNull() & (F.col("latency_ms") > 0) & ~F.isnan("latency_ms") & (F.col("latency_ms") != F.lit(float("inf"))))
    rows = rows.where(F.col("filter_name").isNotNull()).select(
        "result_id", "run_method", F.lower(F.regexp_replace("filter_name", TRIMMED, "")).alias("filter_name"), F.to_date("run_ts").alias("run_day"), "latency_ms"
    )
    first = F.min(F.struct("latency_ms", "run_method", "filter_name", "run_day")).alias("x")
    return rows.groupBy("result_id").agg(first).select("x.*")


def _known_filters(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "exact_topk_entry").select(F.lower(F.regexp_replace("filter_name", TRIMMED, "")).alias("filter_name")).where("filter_name IS NOT NULL").distinct()


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    """One mergeable sketch per method, filter and run day; filters not listed are dropped once rows are few."""
    return sketch_groups(_measurements(spark, d), ["run_method", "filter_name", "run_day"], "latency_ms").join(_known_filters(spark, d), "filter_name", "left_semi")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per method and filter: estimates of p50, p90, p99 and p99.9 with brackets that hold the exact values."""
    merged = merge_groups(_day_sketches(spark, d), ["run_method", "filter_name"])
    return percentiles(merged, ["run_method", "filter_name"], {"p50": (1, 2), "p90": (9, 10), "p99": (99, 100), "p999": (999, 1000)})


def p1_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The same for single run days."""
    return percentiles(_day_sketches(spark, d), ["run_method", "filter_name", "run_day"], {"p50": (1, 2), "p99": (99, 100)})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose 99th percentile is at least 6 times the median.

    The brackets of the sketch decide most groups; the rest are settled exactly on the values inside the brackets.
    """
    by = ["run_method", "filter_name"]
    merged = merge_groups(_day_sketches(spark, d), by).where("n >= 100")
    est = stored(percentiles(merged, by, {"p50": (1, 2), "p99": (99, 100)}), "p1-brackets")
    # p50 in (p50_low, p50_high], p99 in (p99_low, p99_high]
    surely = F.col("p99_low") >= 6 * F.col("p50_high")
    never = F.col("p99_high") < 6 * F.col("p50_low")
    undecided = est.where(~surely & ~never)
    if undecided.isEmpty():  # nothing is left for an exact pass
        return est.where(surely).select(*by)
    values = same_group_join(_measurements(spark, d), undecided.select(*by), by, "left_semi").select(*by, "latency_ms")
    p50 = exact_percentile(values, undecided, by, "latency_ms", "p50", 1, 2)
    p99 = exact_percentile(values, undecided, by, "latency_ms", "p99", 99, 100)
    settled = same_group_join(p50, p99, by).where("p99 >= 6 * p50").select(*by)
    return est.where(surely).select(*by).unionByName(settled)


def p1_exact(spark: SparkSession, d: str) -> DataFrame:
    """Median and 99th percentile of every group of at least 100 values, exactly: the values inside the brackets of the
    sketches are ranked, nothing else."""
    by = ["run_method", "filter_name"]
    est = stored(percentiles(merge_groups(_day_sketches(spark, d), by).where("n >= 100"), by, {"p50": (1, 2), "p99": (99, 100)}), "p1-brackets")
    values = same_group_join(_measurements(spark, d), est.select(*by), by, "left_semi").select(*by, "latency_ms")
    found = same_group_join(exact_percentile(values, est, by, "latency_ms", "p50", 1, 2), exact_percentile(values, est, by, "latency_ms", "p99", 99, 100), by)
    return same_group_join(found, est.select(*by, "n"), by).select(*by, "n", "p50", "p99")


P1_SQL = """
WITH v AS (SELECT result_id, min(run_method) AS run_method, min(lower(trim(filter_name))) AS filter_name, min(latency_ms) AS latency_ms
  FROM query_result WHERE isfinite(latency_ms) AND latency_ms > 0 GROUP BY result_id),
g AS (SELECT run_method, filter_name, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.99) AS p99
  FROM v WHERE filter_name IN (SELECT lower(trim(filter_name)) FROM exact_topk_entry) GROUP BY ALL)
SELECT run_method, filter_name FROM g WHERE n >= 100 AND p99 >= 6 * p50"""
P1_EXACT_SQL = P1_SQL.replace("SELECT run_method, filter_name FROM g WHERE n >= 100 AND p99 >= 6 * p50", "SELECT run_method, filter_name, n, p50, p99 FROM g WHERE n >= 100")

# ---------------------------------------------------------------- problem 2


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of at least 5 reviews linked by cosine 0.85 or more."""
    return similar_groups(load(spark, d, AMAZON), "id", "embedding", least=0.85, smallest=5)


def p2_typical(spark: SparkSession, d: str) -> DataFrame:
    """Size of every cluster and its 3 most typical reviews."""
    reviews = load(spark, d, AMAZON)
    groups = stored(similar_groups(reviews, "id", "embedding", least=0.85, smallest=5), "clusters")
    return typical_members(groups, reviews, "id", "embedding")


def p2_topics(spark: SparkSession, d: str) -> DataFrame:
    """Texts vectorised by hashed weighted features and divided into 40 k-means clusters: sizes and typical documents."""
    return kmeans_groups(hashed_features(load(spark, d, "documents"), "doc_id", "text"), k=40)


_USABLE = "len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_AMAZON_CTE = f"u AS (SELECT id, any_value(CAST(embedding AS DOUBLE[64])) AS v FROM {AMAZON} WHERE {_USABLE} GROUP BY id)"
P2_SQL = f"""
WITH RECURSIVE {_AMAZON_CTE},
e AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.id <> b.id WHERE array_cosine_similarity(a.v, b.v) >= 0.85),
r AS (SELECT x AS id, x AS k FROM e UNION SELECT e.y, r.k FROM r JOIN e ON r.id = e.x WHERE r.k < e.y),
c AS (SELECT id, least(min(k), id) AS cluster_key FROM r GROUP BY id)
SELECT cluster_key, id FROM c QUALIFY count(*) OVER (PARTITION BY cluster_key) >= 5"""

# ---------------------------------------------------------------- problem 3


def _term_records(spark: SparkSession, d: str) -> DataFrame:
    tags = term_records(load(spark, d, YFCC), "id", "tags", field="tags")
    return tags.unionByName(term_records(load(spark, d, LAION), "id", "labels", field="labels"))


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return mark_terms(_term_records(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("mark IS NOT NULL").select("field", "term", "mark")


_TERM_CTE = """
r AS (SELECT DISTINCT 'tags' AS field, id, tags AS l FROM yfcc_tags UNION ALL SELECT DISTINCT 'labels', CAST(id AS BIGINT), labels FROM laion_labels),
tok AS (SELECT field, id, CAST(t AS BIGINT) AS term FROM (SELECT field, id, unnest(l) AS t FROM r) WHERE t IS NOT NULL AND t <> -1),
tot AS (SELECT field, count(DISTINCT id) AS total FROM r GROUP BY field),
n AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM tok GROUP BY field, term)"""
_MARK = "CASE WHEN records < 5 THEN 'rare' WHEN records * 10 > total THEN 'common' END"
P3_TERMS_SQL = f"WITH {_TERM_CTE} SELECT field, term, occurrences, records, {_MARK} AS mark FROM n JOIN tot USING (field)"
P3_SQL = f"SELECT field, term, mark FROM ({P3_TERMS_SQL}) WHERE mark IS NOT NULL"

# ---------------------------------------------------------------- problem 4

#: source_table: (table, metric, closeness)
SOURCES = {"amazon": (AMAZON, "cosine", 0.93), "laion": (LAION, "cosine", 0.93), "yfcc": (YFCC, "l2", 14_400.0)}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Close pairs of which at least one is among the 10 most similar of the other."""
    found = []
    for name, (table, metric, bound) in SOURCES.items():
        near = close_neighbours(load(spark, d, table), "id", "embedding", k=10, bound=bound, metric=metric)
        found.append(near.select(F.lit(name).alias("source_table"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct())
    return found[0].unionByName(found[1]).unionByName(found[2])


def p4_search(spark: SparkSession, d: str) -> DataFrame:
    """The exact 10 most similar records, near or far, of every record whose id is divisible by 50."""
    found = []
    for name, (table, metric, _) in SOURCES.items():
        rows = load(spark, d, table)
        asked = rows.where(F.col("id") % 50 == 0).select(F.col("id").cast("bigint").alias("id"), F.col("embedding").alias("vec"))
        near = search(rows, "id", "embedding", asked, k=10, metric=metric)
        found.append(near.select(F.lit(name).alias("source_table"), "id_a", "id_b", F.col("rank_no").cast("bigint").alias("rank_no")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def _p4_sql(name: str) -> str:
    table, metric, bound = SOURCES[name]
    sim = "array_cosine_similarity(a.v, b.v)" if metric == "cosine" else "-CAST(round(pow(array_distance(a.v, b.v), 2)) AS DOUBLE)"
    return f"""(WITH u AS (SELECT CAST(id AS BIGINT) AS id, any_value(CAST(embedding AS DOUBLE[64])) AS v FROM {table} WHERE {_USABLE} GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, {sim} AS s FROM u a JOIN u b ON a.id <> b.id WHERE s >= {bound if metric == "cosine" else -bound}),
t AS (SELECT x, y FROM p QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 10)
SELECT DISTINCT '{name}' AS source_table, least(x, y) AS id_a, greatest(x, y) AS id_b FROM t)"""


def _p4_search_sql(name: str) -> str:
    table, metric, _ = SOURCES[name]
    sim = "array_cosine_similarity(a.v, b.v)" if metric == "cosine" else "-CAST(round(pow(array_distance(a.v, b.v), 2)) AS DOUBLE)"
    return f"""(WITH u AS (SELECT CAST(id AS BIGINT) AS id, any_value(CAST(embedding AS DOUBLE[64])) AS v FROM {table} WHERE {_USABLE} GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, {sim} AS s FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 50 = 0)
SELECT '{name}' AS source_table, id_a, id_b, row_number() OVER (PARTITION BY id_a ORDER BY s DESC, id_b) AS rank_no FROM p QUALIFY rank_no <= 10)"""


P4_SEARCH_SQL = " UNION ALL ".join(_p4_search_sql(n) for n in SOURCES)
P4_SQL = " UNION ALL ".join(_p4_sql(n) for n in SOURCES)

# ---------------------------------------------------------------- problem 5


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    entries = load(spark, d, "exact_topk_entry")
    latest = latest_rows(entries, ["query_id", "filter_name", "query_no"], "computed_at", "kth_distance_sq")
    valid = latest.where((F.col("kth_distance_sq") >= 0) & ~F.isnan("kth_distance_sq") & (F.col("kth_distance_sq") != F.lit(float("inf"))))
    top = top_n(valid, ["query_id"], "kth_distance_sq", ["filter_name", "query_no"], 3)
    return top.select("query_id", "filter_name", F.col("query_no").cast("bigint").alias("query_no"))


P5_SQL = """
WITH l AS (SELECT query_id, filter_name, query_no, kth_distance_sq AS s FROM exact_topk_entry
  QUALIFY row_number() OVER (PARTITION BY query_id, filter_name, query_no ORDER BY computed_at DESC NULLS LAST, kth_distance_sq DESC NULLS LAST) = 1)
SELECT query_id, filter_name, CAST(query_no AS BIGINT) AS query_no FROM l WHERE isfinite(s) AND s >= 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, filter_name, query_no) <= 3"""

# ---------------------------------------------------------------- problem 6


def _pair_table(spark: SparkSession, d: str) -> PairTable:
    """The tags first, as they are delivered; then a batch with the labels and with the tag baskets that hold
    unresolved elements, which are taken out of them."""
    table = PairTable(spark, Support(count=6, share=(3, 1000), lift=4))
    tags = stored(term_records(load(spark, d, YFCC), "id", "tags", field="tags", ignore=None), "tag-baskets")
    labels = term_records(load(spark, d, LAION), "id", "labels", field="labels")
    resolved = tags.where(F.array_contains("terms", -1)).withColumn("terms", F.array_remove("terms", -1))
    return table.apply(tags).apply(resolved.unionByName(labels))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that appear together more often than chance, with counts and lift."""
    return _pair_table(spark, d).scores()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("field", "term_a", "term_b")


def p6_updates(spark: SparkSession, d: str) -> DataFrame:
    """The same after one more batch: records whose id ends in 3 are removed, those ending in 7 keep even terms only."""
    table = _pair_table(spark, d)
    table.scores()
    now = _term_records(spark, d)
    even = F.filter("terms", lambda t: t % 2 == 0)
    gone = now.where("record % 10 = 3").withColumn("terms", F.lit(None).cast("array<bigint>"))
    return table.apply(gone.unionByName(now.where("record % 10 = 7").withColumn("terms", even))).scores()


P6_PAIRS_SQL = f"""
WITH {_TERM_CTE}, u AS (SELECT DISTINCT field, id, term FROM tok),
p AS (SELECT a.field, a.term AS term_a, b.term AS term_b, count(*) AS n_ab FROM u a JOIN u b ON a.field = b.field AND a.id = b.id AND a.term < b.term GROUP BY ALL)
SELECT field, term_a, term_b, n_ab, x.records AS n_a, y.records AS n_b, total, n_ab * total / (x.records * y.records) AS lift
FROM p JOIN tot USING (field) JOIN n x ON x.field = p.field AND x.term = term_a JOIN n y ON y.field = p.field AND y.term = term_b
WHERE n_ab >= 6 AND n_ab * 1000 >= 3 * total AND n_ab * total >= 4 * x.records * y.records"""
P6_PAIRS_SQL = P6_PAIRS_SQL.replace("SELECT field, term_a", "SELECT p.field AS field, term_a")
P6_UPDATES_SQL = P6_PAIRS_SQL.replace("FROM yfcc_tags", "FROM yfcc_tags WHERE id % 10 <> 3").replace("FROM laion_labels", "FROM laion_labels WHERE id % 10 <> 3").replace("AND t <> -1", "AND t <> -1 AND (id % 10 <> 7 OR t % 2 = 0)")

# ---------------------------------------------------------------- problem 8

CAPACITY = 2048


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document (or piece of one) with its container."""
    return pack(count_tokens(load(spark, d, "documents"), "doc_id", "text"), capacity=CAPACITY)


def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every packed document over all its pieces, and whether it was split."""
    rows = p8_pack(spark, d).groupBy(F.col("id").alias("doc_id"))
    return rows.agg(F.sum("tokens").cast("bigint").alias("tokens"), (F.count("*") > 1).alias("split")).where("tokens > 0")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled."""
    used = containers(p8_pack(spark, d)).where("container <> 'empty'")
    return used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * CAPACITY)).alias("fill"), F.max("used").alias("fullest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be split."""
    return split_items(p8_pack(spark, d)).select(F.col("id").alias("doc_id"))


P8_SQL = r"""SELECT doc_id FROM documents
WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s\x1c-\x1f\x{85}]')) > 2048"""
P8_TOKENS_SQL = "SELECT doc_id, n AS tokens, n > 2048 AS split FROM (" + P8_SQL.split("\nWHERE")[0].replace("SELECT doc_id", "SELECT doc_id, len(regexp_extract_all(text, '" + P8_SQL.split("'")[1] + "')) AS n") + ") WHERE n > 0"

# ---------------------------------------------------------------- problem 9


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with held-out reviews in them, and how much of each."""
    return leaked(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "c4_queries"), "query_no", "ori_review")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "query_no")


# ---------------------------------------------------------------- problem 10


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    docs = load(spark, d, "documents")
    rated = rated_sample(docs, load(spark, d, "doc_ratings"))
    net = train([t for t, _ in rated], np.array([y for _, y in rated]))
    return score_documents(docs, net), net.threshold


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d)[0]


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents, flagged documents and their rate per source."""
    scores, threshold = _scored(spark, d)
    flagged = F.count_if(F.col("score") >= threshold)
    rows = load(spark, d, "documents").select("doc_id", "source").join(scores, "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), flagged.alias("flagged"), (flagged / F.count("*")).alias("rate"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    scores, threshold = _scored(spark, d)
    return scores.where(F.col("score") >= threshold).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_percentiles": p1_percentiles,
    "p1_by_day": p1_by_day,
    "p1_exact": p1_exact,
    "p2_found": p2_found,
    "p2_typical": p2_typical,
    "p2_topics": p2_topics,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p4_found": p4_found,
    "p4_search": p4_search,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p6_updates": p6_updates,
    "p8_found": p8_found,
    "p8_pack": p8_pack,
    "p8_tokens": p8_tokens,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_sources": p10_sources,
}
SQL = {
    "p1_found": P1_SQL,
    "p1_exact": P1_EXACT_SQL,
    "p2_found": P2_SQL,
    "p3_found": P3_SQL,
    "p3_terms": P3_TERMS_SQL,
    "p4_found": P4_SQL,
    "p4_search": P4_SEARCH_SQL,
    "p5_found": P5_SQL,
    "p6_found": f"SELECT field, term_a, term_b FROM ({P6_PAIRS_SQL})",
    "p6_pairs": P6_PAIRS_SQL,
    "p6_updates": P6_UPDATES_SQL,
    "p8_found": P8_SQL,
    "p8_tokens": P8_TOKENS_SQL,
}
