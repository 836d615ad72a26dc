import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield import schema
from tarnfield.sources import files as S
from tarnfield.sources.binary import read_matrix, register, vectors_equal
from tarnfield.streaming.requests import running_routes, windowed_counts


def test_fbin_round_trip_and_limit(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((1000, 6)).astype("<f4")
    path = f"{tmp_path}/x.fbin"
    with open(path, "wb") as f:
        np.array(x.shape, "<u4").tofile(f)
        x.tofile(f)
    df = read_matrix(spark, path, partitions=3)
    assert df.count() == 1000 and read_matrix(spark, path, limit=10).count() == 10
    assert df.where("id = 777").first().embedding == pytest.approx(x[777].tolist())
    out = f"{tmp_path}/y.fbin"
    df.repartitionByRange(4, "id").write.format("fbin").mode("append").save(out)
    assert open(out, "rb").read() == open(path, "rb").read() and len(os.listdir(tmp_path)) == 2
    assert vectors_equal(df, read_matrix(spark, out)).count() == 0
    assert vectors_equal(df, df.withColumn("embedding", F.when(F.col("id") == 3, F.transform("embedding", lambda v: v + 1)).otherwise(F.col("embedding")))).first().id == 3


def test_other_binary_formats(spark, tmp_path):
    register(spark)
    u = np.arange(12, dtype="u1").reshape(4, 3)
    with open(f"{tmp_path}/u", "wb") as f:
        np.array(u.shape, "<u4").tofile(f)
        u.tofile(f)
    assert [r.embedding for r in read_matrix(spark, f"{tmp_path}/u", "u8bin").orderBy("id").collect()] == u.astype(float).tolist()
    i = np.arange(6, dtype="<i4").reshape(2, 3)
    with open(f"{tmp_path}/i", "wb") as f:
        np.array(i.shape, "<u4").tofile(f)
        i.tofile(f)
        np.zeros((2, 3), "<f4").tofile(f)
    assert [r.ids for r in read_matrix(spark, f"{tmp_path}/i", "ibin").orderBy("id").collect()] == i.tolist()
    with open(f"{tmp_path}/s", "wb") as f:
        np.array([3, 10, 4], "<i8").tofile(f)
        np.array([0, 2, 2, 4], "<i8").tofile(f)
        np.array([1, 5, 0, 9], "<i4").tofile(f)
        np.array([1, 2, 3, 4], "<f4").tofile(f)
    rows = spark.read.format("spmat").option("path", f"{tmp_path}/s").option("partitions", 2).load().orderBy("id").collect()
    assert [r.tags for r in rows] == [[1, 5], [], [0, 9]] and rows[2].weights == [3.0, 4.0]
    np.save(f"{tmp_path}/a.npy", np.ones((2, 2), "f4"))
    np.save(f"{tmp_path}/b.npy", np.zeros((3, 2), "f4"))
    df = spark.read.format("npyshards").load(f"{tmp_path}/a.npy,{tmp_path}/b.npy")
    assert [r.id for r in df.orderBy("id").collect()] == [0, 1, 2, 3, 4]
    with open(f"{tmp_path}/bad", "wb") as f:
        np.array([5, 5], "<u4").tofile(f)
    with pytest.raises(Exception, match="header says"):
        read_matrix(spark, f"{tmp_path}/bad").count()


def test_csv_and_json(spark, tmp_path):
    names = ",".join(schema.TENANTS.names)
    (tmp_path / "t.csv").write_text(f"{names}\na,store,b,c\n")
    assert S.read_csv(spark, str(tmp_path / "t.csv"), schema.TENANTS).first().source_kind == "store"
    (tmp_path / "u.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        S.read_csv(spark, str(tmp_path / "u.csv"), schema.TENANTS)
    (tmp_path / "j.json").write_text('{"id": 1}\n{broken\n{"id": 2}\n')
    assert S.read_json_lines(spark, str(tmp_path / "j.json"), "id bigint").count() == 2
    df = spark.createDataFrame([(1, 2)], "TEXT int, WIDTH int")
    assert S.with_renamed(df, {"text": ["caption", "TEXT"], "width": ["WIDTH"]}).columns == ["text", "width"]
    with pytest.raises(ValueError):
        S.with_renamed(df, {"x": ["y"]})


def test_publish_is_all_or_nothing(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "no" / "b")
    S.publish({a: "old"})
    with pytest.raises(OSError):
        S.publish({a: "new", b: "x"})
    assert open(a).read() == "old" and os.listdir(tmp_path) == ["a"]
    S.publish_rows(str(tmp_path / "r.csv"), [{"x": 1, "y": "z"}])
    assert (tmp_path / "r.csv").read_text() == "x,y\n1,z\n"


def test_versioned_mutations(spark, tmp_path):
    t = S.VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([(1, 0.5, 1), (2, 0.1, 1), (4, 9.0, 2)], "id bigint, x double, tenant int"), ["id"])
    t.mutate(insert=spark.createDataFrame([(9, 1.0, 1)], "id bigint, x double, tenant int"))
    t.mutate(update={"x": "0.0001", "tenant": "1"}, where="id = 4")
    t.mutate(delete="id = 1")
    assert sorted(map(tuple, t.read().collect())) == [(2, 0.1, 1), (4, 0.0001, 1), (9, 1.0, 1)]
    assert t.read(1).count() == 3 and t.version == 4
    t.mutate(truncate=True)
    assert t.read().count() == 0


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/src"
    rows = [(f"2025-01-01 0{i % 5}:10:00", "ab"[i % 2], float(i % 3)) for i in range(40)]
    spark.createDataFrame(rows, "ts string, key string, cost double").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = lambda: spark.readStream.schema("ts timestamp, key string, cost double").parquet(src)
    q = windowed_counts(stream()).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("requests")).first()[0] == 40
    q = running_routes(stream(), least=2, limit=10.0).writeStream.format("memory").queryName("r").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    time.sleep(0.1)
    assert {r.key: (r.requests, r.route) for r in spark.table("r").collect()} == {"a": (20, "prefilter"), "b": (20, "prefilter")}


def test_an_ingest_goes_on_where_it_stopped(spark, tmp_path):
    from tarnfield.sources.files import ingest_csv

    rows = spark.range(30).select("id", (F.col("id") * 1.5).alias("x"))
    sources = [f"{tmp_path}/in{i}" for i in range(3)]
    for i, s in enumerate(sources):
        rows.where(F.col("id") % 3 == i).write.option("header", True).csv(s)
    ingest_csv(spark, sources[:2], f"{tmp_path}/out", rows.schema)
    done = next(p for p in os.listdir(f"{tmp_path}/out"))
    os.remove(f"{tmp_path}/out/{done}/_SUCCESS")  # as if it had been broken off
    got, skipped = ingest_csv(spark, sources, f"{tmp_path}/out", rows.schema)
    assert skipped == 1 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_npy_shards_written_by_tasks_are_read_in_order(spark, tmp_path):
    from tarnfield.sources.binary import register, write_npy_shards

    register(spark)
    df = spark.range(50).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding")).repartition(7)
    paths = write_npy_shards(df, f"{tmp_path}/npy", shards=3)
    got = spark.read.format("npyshards").load(",".join(paths)).orderBy("id").collect()
    assert len(paths) == 3 and [r.embedding for r in got] == [[float(i), 1.0] for i in range(50)]
