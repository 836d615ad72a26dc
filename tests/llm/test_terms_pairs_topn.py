import math
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tarnfield.llm.pairs import PairTable, Support
from tarnfield.llm.terms import count_terms, mark_terms, term_records
from tarnfield.llm.topn import latest_rows, top_n


def lists(n=300):
    return [(i, [7, 7, i % 5, 100 + i % 90, -1, None][: 1 + i % 6]) for i in range(n)]


def test_counts_equal_brute_force(spark):
    rows = lists() + lists(50) + [(None, [1]), (999, None), (998, []), (997, [-1, None])] + [(5, [4242])] + [(0, [7])] * 400
    df = spark.createDataFrame(rows, "id int, l array<int>").withColumn("field", F.lit(1)).withColumn("term", F.lit(1)).withColumn("records", F.lit("x")).repartition(11)
    occ, rec = Counter(), {}
    seen = {(i, tuple(x)) for i, x in rows if i is not None and x}
    for i, x in seen:
        for t in x:
            if t is not None and t != -1:
                occ[t] += 1
                rec.setdefault(t, set()).add(i)
    got = {r.term: (r.occurrences, r.records) for r in count_terms(term_records(df, "id", "l", field="f")).collect()}
    assert got == {t: (occ[t], len(rec[t])) for t in occ}


def test_counter_goes_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(i, [1, 1, 2 + i % 2]) for i in range(40)] + [(3, [1])], "id bigint, l array<int>").coalesce(1)
        got = {r.term: (r.occurrences, r.records) for r in count_terms(term_records(df, "id", "l", field="f")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == {1: (81, 40), 2: (20, 20), 3: (20, 20)}


def test_marks_and_empty(spark):
    df = spark.createDataFrame([(i, [1 + (i >= 4), 3 if i < 11 else 4]) for i in range(100)], "id bigint, l array<int>")
    got = {r.term: r.mark for r in mark_terms(term_records(df, "id", "l", field="f")).collect()}
    assert got == {1: "rare", 2: "common", 3: "common", 4: "common"}
    df = spark.createDataFrame([(i, [3 if i < 10 else 4]) for i in range(100)], "id bigint, l array<int>")
    assert {r.term: r.mark for r in mark_terms(term_records(df, "id", "l", field="f")).collect()} == {3: None, 4: "common"}
    assert mark_terms(term_records(df.limit(0), "id", "l", field="f")).count() == 0


def test_words_as_terms(spark):
    df = spark.createDataFrame([(1, ["rye", "rye", "oat", None, ""]), (2, ["rye"]), (2, ["rye"]), (3, None), (4, ["-1"])], "id bigint, l array<string>")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in mark_terms(term_records(df, "id", "l", field="f", ignore="-1", kind="string"), rare_below=2, common_share=(1, 3)).collect()}
    assert got == {"rye": (3, 2, "common"), "oat": (1, 1, "rare"), "": (1, 1, "rare")}


def brute_pairs(baskets):
    n, ab = Counter(), Counter()
    for x in baskets.values():
        s = sorted(set(x))
        n.update(s)
        ab.update(combinations(s, 2))
    return n, ab


def scores(table):
    return {(r.term_a, r.term_b): (r.n_ab, r.n_a, r.n_b) for r in table.scores().collect()}


def wanted(baskets, count, share, lift):
    n, ab = brute_pairs(baskets)
    total = len(baskets)
    return {p: (c, n[p[0]], n[p[1]]) for p, c in ab.items() if c >= count and c * share[1] >= total * share[0] and c * total >= lift * n[p[0]] * n[p[1]]}


@pytest.mark.parametrize(("share", "lift"), [((0, 1), 0), ((3, 100), 2)])
def test_incremental_pairs_equal_a_full_count(spark, share, lift):
    frame = lambda b: spark.createDataFrame([("f", i, x) for i, x in b.items()], "field string, record bigint, terms array<bigint>")
    first = {i: [i % 4, 10 + i % 7, 20 + i % 3, 20 + i % 3] for i in range(120)}
    t = PairTable(spark, Support(2, share, lift), chunk=2).apply(frame(first))
    assert scores(t) == wanted(first, 2, share, lift)
    change = {5: [], 6: [1, 99], 7: [1, 99], **{200 + i: [1, 99, 13] for i in range(8)}}
    now = {**first, **change}
    t.apply(frame(change))
    assert scores(t) == wanted(now, 2, share, lift)
    t.apply(frame({}) if False else frame({5: [1]}).limit(0))
    assert scores(t) == wanted(now, 2, share, lift)
    t.apply(frame({i: None for i in range(200, 208)}))  # null terms remove the record
    now = {i: x for i, x in now.items() if i < 200}
    assert scores(t) == wanted(now, 2, share, lift) and t.records().first().total == len(now)
    again = PairTable.open(spark, t.folder, t.support, chunk=2).apply(frame({0: [1, 99], 3: now[3]}))
    now[0] = [1, 99]
    assert scores(again) == wanted(now, 2, share, lift)


def test_one_changed_basket_touches_its_buckets_only(spark):
    frame = lambda b: spark.createDataFrame([("f", i, x) for i, x in b.items()], "field string, record bigint, terms array<bigint>")
    first = {i: [i % 4, 10 + i % 7, 20 + i % 3] for i in range(400)}
    t = PairTable(spark, Support(2), buckets=32).apply(frame(first))
    t.scores()
    was = {x: dict(getattr(t, x).current) for x in ("baskets", "marginals", "counts")}
    t.apply(frame({7: [3, 10, 22], 8: first[8]}))  # one term of one basket; the other stays as it is
    changed = {x: sum(getattr(t, x).current.get(b) != p for b, p in was[x].items()) for x in was}
    assert changed["baskets"] == 1 and changed["marginals"] <= 2 and changed["counts"] <= 4 and t.filled == 1
    assert scores(t) == wanted({**first, 7: [3, 10, 22]}, 2, (0, 1), 0)


def test_pairs_nulls_and_long_basket(spark):
    rows = [("f", 1, [*range(300)]), ("f", 2, [*range(300)]), ("f", None, [1, 2]), (None, 3, [1, 2]), ("f", 4, []), ("f", 5, [None, 7, 7]), ("f", 6, None)]
    t = PairTable(spark, Support(2)).apply(spark.createDataFrame(rows, "field string, record bigint, terms array<bigint>"))
    assert t.scores().count() == 300 * 299 // 2 and t.records().first().total == 4


def brute_top(rows, n):
    out = {}
    for g, s, a, b in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, -r[1], r[2], r[3])):
        out.setdefault(g, []).append((s, a, b))
    return {g: v[:n] for g, v in out.items()}


def test_top_n_with_ties_and_a_hot_group(spark):
    rows = [(1 if i % 3 else i % 40, float(i % 17), f"n{i % 11}", i) for i in range(6000)] + [(None, 1.0, "a", 1), (77, None, "a", 1)] + [(500, 2.0, "a", 1)] * 5
    df = spark.createDataFrame(rows, "g int, s double, name string, no int").withColumn("rank_no", F.lit(1)).withColumn("band_", F.lit("x")).repartition(9)
    got = {}
    for r in top_n(df, ["g"], "s", ["name", "no"], 3).orderBy("rank_no").collect():
        got.setdefault(r.g, []).append((r.s, r.name, r.no))
    assert got == brute_top(rows, 3)
    assert top_n(df.limit(0), ["g"], "s", ["name", "no"], 3).count() == 0


def test_latest(spark):
    rows = [(1, "a", 1, 5.0), (1, "a", 2, math.nan), (1, "b", None, 3.0), (1, "b", None, 4.0), (2, "a", 9, None), (2, "a", 8, 1.0)]
    got = {(r.q, r.f): r.x for r in latest_rows(spark.createDataFrame(rows, "q int, f string, v int, x double"), ["q", "f"], "v", "x").collect()}
    assert math.isnan(got[1, "a"]) and got[1, "b"] == 4.0 and got[2, "a"] is None
