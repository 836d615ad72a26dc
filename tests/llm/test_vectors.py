import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnfield.llm import cells as C
from tarnfield.llm.clusters import components, hashed_features, kmeans_groups, similar_groups, typical_members, union_find
from tarnfield.llm.neighbours import _scan, close_neighbours, search


def planted(n=600, groups=12, d=64, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for g in range(groups):
        base = rng.standard_normal(d)
        for i in range(g * 9, g * 9 + 3 + g % 7):
            x[i] = (base + 0.18 * rng.standard_normal(d)) * rng.uniform(0.3, 3)
    x[500:515] = x[0]  # copies
    return x.astype("f4")


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id bigint, v array<float>").withColumn("vec", F.lit(1)).withColumn("cell", F.lit(2)).repartition(5)


def junk(x):
    d = x.shape[1]
    return [(None, [1.0] * d), (9001, None), (9002, [0.0] * d), (9003, [1.0] * (d - 1)), (9004, [float("nan")] * d), (9005, [float("inf")] * d), (9006, [None] * d), (9007, []), (3, [float(v) for v in x[3]])]


def cosines(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    return u @ u.T


def brute_near(sim, least, k):
    out = {}
    for i in range(len(sim)):
        j = [j for j in range(len(sim)) if j != i and sim[i, j] >= least]
        out[i] = sorted(j, key=lambda j: (-round(sim[i, j], 12), j))[:k]
    return {i: j for i, j in out.items() if j}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_close_neighbours_equal_brute_force(spark, metric):
    x = planted()
    if metric == "l2":
        x = np.clip(np.round(x * 40 + 127), 0, 255).astype("f4")
        d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
        sim, bound, least = -d, 60_000.0, -60_000.0
    else:
        sim, bound, least = cosines(x), 0.9, 0.9
    got = {}
    for r in close_neighbours(frame(spark, x, junk(x)), "id", "v", k=4, bound=bound, metric=metric, probes=6).orderBy("rank_no").collect():
        got.setdefault(r.id_a, []).append(r.id_b)
    assert got == brute_near(sim, least, 4)


def test_neighbours_without_a_bound(spark):
    x = planted()
    got = {}
    for r in close_neighbours(frame(spark, x, junk(x)), "id", "v", k=4, bound=None, probes=99).orderBy("rank_no").collect():
        got.setdefault(r.id_a, []).append(r.id_b)
    assert got == brute_near(cosines(x), -2, 4)


def test_buckets_of_a_heavy_cell_lose_nothing(spark):
    x = planted()
    df = frame(spark, x)
    a = close_neighbours(df, "id", "v", k=3, bound=0.9, probes=2, per_root=0.04)
    b = close_neighbours(df, "id", "v", k=3, bound=0.9, probes=2, per_root=0.04, tile_rows=90)
    key = lambda rows: sorted((r.id_a, r.id_b, r.rank_no) for r in rows.collect())
    assert key(a) == key(b) and a.count() > 100


def test_a_dense_region_keeps_its_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((12_000, 64))
    base = rng.standard_normal(64)
    x[:4000] = base + np.sqrt(0.05) * rng.standard_normal((4000, 64)) * np.linalg.norm(base) / 8  # pairwise cosine about 0.95
    x = x.astype("f4")
    sim = cosines(x[:4000])
    np.fill_diagonal(sim, -1)
    want = {(i, int(j)) for i, row in enumerate(np.argpartition(-sim, 10, axis=1)[:, :10]) for j in row}
    assert min(sim[i, j] for i, j in want) > 0.93
    got = {(r.id_a, r.id_b) for r in close_neighbours(frame(spark, x), "id", "v", k=10, bound=0.93, tile_rows=3000).collect()}
    assert len(want & got) >= 0.999 * len(want)


def test_many_copies_of_one_vector(spark):
    x = np.tile(np.arange(1, 65, dtype="f4"), (400, 1))
    got = {}
    for r in close_neighbours(frame(spark, x), "id", "v", k=3, bound=0.9).orderBy("rank_no").collect():
        got.setdefault(r.id_a, []).append(r.id_b)
    assert len(got) == 400 and all(v == [j for j in range(5) if j != i][:3] for i, v in got.items())


def test_more_copies_than_a_byte_counts(spark):
    x = planted()
    x[100:440] = x[100]
    got = {}
    for r in close_neighbours(frame(spark, x), "id", "v", k=300, bound=0.9).orderBy("rank_no").collect():
        got.setdefault(r.id_a, []).append(r.id_b)
    assert got[100] == list(range(101, 401)) and got[439] == list(range(100, 400))


def test_exact_groups_are_those_of_the_cells(spark):
    x = planted()
    key = lambda df: sorted(map(tuple, df.collect()))
    a = similar_groups(frame(spark, x), "id", "v", least=0.85, smallest=2)
    assert key(a) == key(similar_groups(frame(spark, x), "id", "v", least=0.85, smallest=2, exact=True, tile_rows=150))


def test_search_is_exact(spark):
    x = planted()
    df = frame(spark, x, junk(x))
    q = df.where("id % 50 = 0").select("id", F.col("v").alias("vec"))
    for metric in ("cosine", "l2"):
        sim = cosines(x) if metric == "cosine" else -((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
        want = {i: j for i, j in brute_near(sim, -np.inf, 7).items() if i % 50 == 0}
        for block in (4096, 5):
            got = {}
            for r in search(df, "id", "v", q, k=7, metric=metric, block_rows=block).orderBy("rank_no").collect():
                got.setdefault(r.id_a, []).append(r.id_b)
            assert got == want


def test_search_with_an_id_that_is_delivered_often():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 64)).astype("f4")
    x[7] = x[0] + np.float32(0.01)
    ids = np.r_[np.arange(300), np.full(100, 7), np.zeros(50, int)]
    rows = np.r_[x, np.repeat(x[[7]], 100, axis=0), np.repeat(x[[0]], 50, axis=0)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(map(list, rows)), pa.list_(pa.float32()))], names=["id", "vec"])
    (out,) = _scan(np.array([0]), x[:1], 5, "cosine", 64)(iter([batch]))
    assert out["id_b"].to_pylist() == brute_near(cosines(x), -np.inf, 5)[0]
    (out,) = _scan(np.arange(10), x[:10], 5, "cosine", 64, queries_at_once=3)(iter([batch.slice(0, 200), batch.slice(200)]))
    want = brute_near(cosines(x), -np.inf, 5)
    assert out["id_b"].to_pylist() == [j for i in range(10) for j in want[i]]


def test_similar_groups_equal_components(spark):
    x = planted()
    sim = cosines(x)
    links = [(i, j) for i in range(len(x)) for j in range(i) if sim[i, j] >= 0.85]
    label = union_find(links)
    size = {v: sum(w == v for w in label.values()) for v in label.values()}
    want = {(k, i) for i, k in label.items() if size[k] >= 5}
    df = frame(spark, x, junk(x))
    groups = similar_groups(df, "id", "v", least=0.85, smallest=5)
    assert {tuple(r) for r in groups.collect()} == want and len(want) > 20
    top = typical_members(groups, df, "id", "v")
    assert top.where("rank_no = 1").count() == len({k for k, _ in want})
    assert similar_groups(df.limit(0), "id", "v", least=0.85, smallest=5).count() == 0
    assert close_neighbours(df.limit(0), "id", "v", k=3, bound=0.9).count() == 0


def test_kmeans_groups_assign_every_row_and_name_the_nearest(spark):
    x = planted()
    rows = frame(spark, x, junk(x)).drop("vec", "cell").withColumnRenamed("v", "vec")
    got = kmeans_groups(rows, k=12, members=700).collect()
    ids = [r.id for r in got]
    assert sorted(ids) == list(range(600)) and len({r.cluster_key for r in got}) <= 12
    for key in {r.cluster_key for r in got}:
        mine = sorted((r for r in got if r.cluster_key == key), key=lambda r: r.rank_no)
        assert [r.rank_no for r in mine] == list(range(1, mine[0].size + 1))
        assert [(r.distance, r.id) for r in mine] == sorted((r.distance, r.id) for r in mine)
    home = {r.id: r.cluster_key for r in got}
    assert len({home[i] for i in range(500, 515)} | {home[0]}) == 1  # copies stay together
    assert kmeans_groups(rows.limit(0), k=3).count() == 0
    assert len({r.cluster_key for r in kmeans_groups(rows.where("id in (1, 2)"), k=9).collect()}) <= 2


def test_kmeans_centroids_come_from_all_rows(spark):
    x = np.sin(np.arange(1, 80_001)[:, None] * np.array([1.0, 2.3, 3.7, 5.1])).astype("f4")  # more rows than a sample has
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "vec": list(x)}))
    got = [r.distance for r in kmeans_groups(rows, k=1, dim=4, members=5).orderBy("rank_no").collect()]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert got == pytest.approx(np.sort(np.linalg.norm(u - u.mean(axis=0), axis=1))[:5].tolist(), rel=1e-5)


def test_sparse_links_of_a_hot_region_are_all_seen(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 64))
    x[:3000] = rng.standard_normal(64) + 0.66 * rng.standard_normal((3000, 64))
    x = x.astype("f4")
    links = np.argwhere(np.triu(cosines(x) >= 0.85, 1)).tolist()
    label = union_find([tuple(p) for p in links])
    want = {(k, i) for i, k in label.items()}
    got = similar_groups(frame(spark, x), "id", "v", least=0.85, smallest=2, tile_rows=2500)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1, 60)]
    cycle = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    edges = spark.createDataFrame(chain + star + cycle + [(5000, 5000)], "id bigint, rep bigint")
    got = {r.id: r.cluster_key for r in components(edges).collect()}
    assert got == {k: v for k, v in union_find([(a, b) for a, b in chain + star + cycle]).items()}


def test_pack_and_collapse():
    x = np.random.default_rng(0).standard_normal((33, 64)).astype("f4")
    assert np.array_equal(C.unpack(C.pack(x), 33, np.float32, 64), x)
    rep, ids, at = C.collapse(np.vstack([x[:2], x[:1], -0.0 * x[:1], 0.0 * x[:1]]), np.array([5, 9, 1, 7, 7]))
    assert sorted(tuple(ids[a:b]) for a, b in zip(at, at[1:])) == [(1, 5), (7,), (9,)] and len(rep) == 3


def test_hashed_features(spark):
    df = spark.createDataFrame([(1, "rye bread rye"), (2, "rye bread rye"), (3, "olive oil"), (4, None), (5, "")], "id bigint, t string")
    got = {r.id: r.vec for r in hashed_features(df, "id", "t").collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] != got[3] and len(got[1]) == 64
    assert np.count_nonzero(got[1]) == 2 and max(map(abs, got[1])) == pytest.approx((1 + np.log(2)) * np.log1p(3 / 2), rel=1e-6)
    assert hashed_features(df.limit(0), "id", "t").count() == 0
