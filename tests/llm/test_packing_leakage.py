import random
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfield.llm.leakage import Patterns, leaked, words
from tarnfield.llm.packing import containers, count_tokens, fill, pack, split_items


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=150, deadline=None)
def test_fill_places_every_item_once(lengths):
    counts = np.bincount(lengths or [0], minlength=41)
    counts[0] = 0
    used = np.zeros(41, int)
    for times, content in fill(counts, 40, window=12):
        assert times > 0 and sum(x * c for x, c in content.items()) <= 40
        for x, c in content.items():
            used[x] += times * c
    assert used.tolist() == counts.tolist()


def test_fill_closes_gaps_exactly():
    assert fill(np.bincount([7, 6, 5, 4, 3, 3, 2], minlength=11), 10) == [(1, {7: 1, 3: 1}), (1, {6: 1, 4: 1}), (1, {5: 1, 3: 1, 2: 1})]


def closest(left, room):
    """The largest sum up to room of lengths that are left, by plain enumeration of what can be reached."""
    sums = {0}
    for x in np.repeat(np.arange(len(left)), left).tolist():
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


@given(st.lists(st.integers(1, 40), min_size=1, max_size=40), st.sampled_from([0, 1, 3, 6]))
@settings(max_examples=150, deadline=None)
def test_fill_looks_at_every_length(lengths, window):
    left = np.bincount(lengths, minlength=61)
    for times, content in fill(left, 60, window=window):
        for _ in range(times):
            big = max(np.flatnonzero(left))
            left[big] -= 1
            assert big in content and sum(x * c for x, c in content.items()) == big + closest(left, 60 - big)
            left[big] += 1
            for x, c in content.items():
                left[x] -= c
    assert not left.any()


def test_fill_takes_partners_outside_the_window():
    even = [2 * x for x in range(400, 440)] + [2 * x for x in range(1, 21)]  # the longest and the shortest leave a token free
    out = fill(np.bincount([1001, 201, *even], minlength=2049), 2048)
    assert sum(x * c for x, c in out[0][1].items()) == 2048 and out[0][1][201] == 1


def test_pack_keeps_everything(spark):
    rng = random.Random(4)
    sizes = [rng.choice([rng.randint(1, 60), rng.randint(300, 900), rng.randint(2000, 9000)]) for _ in range(3000)]
    rows = list(enumerate(sizes)) + [(9001, 0), (9002, None), (9003, 2048), (9004, 2049), (9005, 4096), (17, 5)]
    df = spark.createDataFrame(rows, "id bigint, tokens bigint").withColumn("piece", F.lit("x")).withColumn("container", F.lit(1))
    out = pack(df, capacity=2048, shard_items=400)
    out.persist()
    assert out.groupBy("id").agg(F.sum("tokens").alias("t")).agg(F.sum("t")).first()[0] == sum(s or 0 for _, s in rows)
    assert out.count() == sum(max(1, -(-(s or 0) // 2048)) for _, s in rows)
    used = containers(out).where("container <> 'empty'")
    assert used.where("used > 2048").count() == 0
    total = sum(s or 0 for _, s in rows)
    assert used.count() <= -(-total // 2048) * 1.01 + 1
    assert {r.id for r in split_items(out).collect()} == {i for i, s in rows if s and s > 2048}
    assert pack(df.limit(0), capacity=2048).count() == 0


def test_pack_of_items_that_cannot_share(spark):
    df = spark.createDataFrame([(i, 1100) for i in range(500)], "id bigint, tokens bigint")
    out = pack(df, capacity=2048, shard_items=60)
    assert containers(out).count() == 500 and out.select("id").distinct().count() == 500


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Zwölf_3 Äpfel, 2.5 €!"), (2, None), (3, ""), (4, " \n\t "), (None, "x"), (5, "a " * 300_000)], "id bigint, t string").withColumn("tokens", F.lit(1))
    assert {r.id: r.tokens for r in count_tokens(df, "id", "t").collect()} == {1: 8, 2: 0, 3: 0, 4: 0, 5: 300_000}


def brute(docs, tests, num=2, den=5):
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = set()
    for d, t in docs:
        g = grams(words(t))
        for no, r in tests:
            own = grams(words(r))
            if own and len(own & g) * den >= len(own) * num:
                out.add((d, no))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    vocab = ["rye", "Bread", "café", "oil", "x1", "ﬁne", "straße", "on", "top", "jar"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    tests = [(i, text(rng.randint(3, 40))) for i in range(30)] + [(100, None), (101, ""), (102, "one two three four"), (103, "same words in here again"), (104, "Same WORDS, in_here again!")]
    docs = [(i, text(rng.randint(0, 60)) + "; " + "--".join(tests[i % 30][1].upper().split(" ")[: rng.randint(0, 40)])) for i in range(200)]
    docs += [(900, None), (901, ""), (902, "x same   words\nin here AGAIN y"), (903, unicodedata.normalize("NFD", "café oil x1 on top jar")), (904, "pad " * 50_000 + tests[3][1])]
    d = spark.createDataFrame([*docs, docs[0], (None, "x")], "doc_id bigint, text string").withColumn("query_no", F.lit(1)).withColumn("found", F.lit(1)).repartition(4)
    t = spark.createDataFrame([*tests, (None, "x")], "query_no int, r string")
    want = brute(docs, tests)
    assert {(902, 103), (902, 104)} <= want and len(want) > 60
    for at_once in (20_000, 7):
        got = leaked(d, "doc_id", "text", t, "query_no", "r", items_at_once=at_once)
        assert sorted((r.doc_id, r.query_no) for r in got.collect()) == sorted(want)
    assert leaked(d.limit(0), "doc_id", "text", t, "query_no", "r").count() == 0 and leaked(d, "doc_id", "text", t.limit(0), "query_no", "r").count() == 0


def test_window_never_skips_an_occurrence():
    p = Patterns([(1, "a b c d e f"), (2, "c d e f g")], table_bits=4)  # small table: many blocks collide
    rng = random.Random(2)
    seq = [rng.choice("abcdefgz") for _ in range(5000)] + list("abcdefg")
    ids = np.array([p.vocabulary.get(w, 0) for w in seq], np.int32)
    at, which = p.occurrences(ids, lane=64)
    grams = {tuple(row): i for i, row in enumerate(p.words.tolist())}
    want = {(i + 4, grams[tuple(ids[i : i + 5].tolist())]) for i in range(len(ids) - 4) if tuple(ids[i : i + 5].tolist()) in grams}
    assert set(zip(at.tolist(), which.tolist())) == want and want
