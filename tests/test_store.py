"""Databases, collections, transactions, exchange, configuration and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import filters as Q
from vecloom.plans.config import (
    AlreadyExists,
    Conflict,
    IndexConfig,
    IndexType,
    InvalidParameter,
    NotFound,
    NotSupported,
    Settings,
    access_path,
    error_message,
    preset,
)
from vecloom.sources.store import Database, open_database
from vecloom.streaming import ingest


@pytest.fixture
def db(spark, tmp_path):
    return open_database(spark, f"{tmp_path}/db")


def filled(db, n=30, dim=4):
    c = db.create_collection("docs", dim)
    c.insert_batch([[float(i * dim + j) for j in range(dim)] for i in range(n)], [{"n": i, "name": f"a{i % 3}"} for i in range(n)])
    return c


def test_lifecycle(spark, db):
    c = filled(db, 20)
    assert c.count() == 20 and c.get(1) == [0.0, 1.0, 2.0, 3.0] and c.get_meta(2) == {"n": 1, "name": "a1"}
    db.close()
    again = Database(spark, db.path)
    with pytest.raises(NotSupported):
        Database(spark, db.path, read_only=True).collection("docs").insert([0.0] * 4)
    c = again.collection("docs")
    assert again.list_collections() == ["docs"] and c.count() == 20 and c.get_meta(2) == {"n": 1, "name": "a1"}
    assert c.delete_batch(list(range(1, 11)) + [999]) == 10
    assert c.insert([0.0] * 4) == 21 and c.count() == 11
    again.drop_collection("docs")
    assert again.list_collections() == []
    with pytest.raises(NotFound):
        again.collection("docs")
    with pytest.raises(NotFound):
        Database(spark, f"{db.path}/none", create=False)


def test_vids_and_errors(db):
    c = db.create_collection("v", 2)
    c.upsert(42, [1.5, 1.5])
    c.upsert(42, [2.5, 2.5])
    c.upsert(100000, [3.5, 3.5])
    assert c.get(42) == [2.5, 2.5] and c.count() == 2 and c.insert([0.0, 0.0]) == 100001
    for call in (lambda: c.upsert(0, [1.0, 1.0]), lambda: c.upsert(10**9, [1.0, 1.0]), lambda: c.insert([1.0]), lambda: c.insert_batch([]), lambda: c.search([1.0]), lambda: db.create_collection("w", 0), lambda: db.create_collection("a/b", 2)):
        with pytest.raises(InvalidParameter):
            call()
    with pytest.raises(AlreadyExists):
        db.create_collection("v", 2)
    for call in (lambda: c.delete(7), lambda: c.get(7), lambda: c.set_meta(7, {"a": 1})):
        with pytest.raises(NotFound):
            call()
    assert error_message(-4) == "not found" and NotFound.code == -4


def test_metadata_and_filters(db):
    c = filled(db, 12)
    c.set_meta(1, {"name": "new"})
    assert c.get_meta(1) == {"name": "new"}
    assert [r["vid"] for r in c.search_filtered([0.0] * 4, Q.eq("name", "A1"), 2).collect()] == [2, 5]
    assert c.delete_by_filter(Q.eq("name", "a2")) == 4 and c.count() == 8
    c.delete_meta_field("n")
    assert "n" not in c.rows().columns
    assert [r["vid"] for r in c.iterate(Q.eq("name", "a1"))] == [2, 5, 8, 11]
    assert {r["pos"]: r["vid"] for r in c.get_batch([5, 99, 2]).collect()} == {0: 5, 2: 2}
    c.clear()
    assert c.count() == 0 and c.search([0.0] * 4).count() == 0 and c.insert([0.0] * 4) == 1


@pytest.mark.parametrize("kind", ["ivf", "ivf_sq", "hnsw"])
def test_index_of_a_collection(spark, db, kind):
    c = filled(db)
    with pytest.raises(InvalidParameter):
        db.create_collection("empty", 2, index=IndexConfig(type=kind, nlist=2)).build_index()
    exact = [r["vid"] for r in c.search([0.0] * 4, 5).collect()]
    c.build_index(IndexConfig(type=kind, nlist=4, nprobe=2))
    with pytest.raises(AlreadyExists):
        c.build_index()
    assert c.has_index() and c.verify() == []
    assert [r["vid"] for r in c.search([0.0] * 4, 5).collect()] == exact
    assert c.search([0.0] * 4, 25, nprobe=1).count() == 25  # topped up
    reopened = Database(spark, db.path).collection("docs")
    assert reopened.has_index() and [r["vid"] for r in reopened.search([0.0] * 4, 5).collect()] == exact
    c.delete(1)
    assert not c.has_index() and [r["vid"] for r in c.search([0.0] * 4, 4).collect()] == exact[1:]
    c.rebuild_index(IndexConfig(type=kind, nlist=2))
    c.vacuum(1)
    assert c.has_index() and c.count() == 29 and c.verify() == []
    assert c.range_search([[0.0] * 4], 400.0).count() == c.search([0.0] * 4, 100).filter("distance <= 400").count()
    assert c.search_by_id(3, 1).first()["vid"] == 3


def test_transactions(spark, db):
    c = filled(db, 5)
    db.begin()
    c.delete(1)
    assert c.count() == 4 and Database(spark, db.path).collection("docs").count() == 5
    db.rollback()
    assert c.count() == 5
    db.begin()
    c.delete(1)
    db.commit()
    assert Database(spark, db.path).collection("docs").count() == 4
    with pytest.raises(NotFound):
        db.commit()


@pytest.mark.parametrize("form", ["parquet", "json", "csv"])
def test_exchange(db, tmp_path, form):
    filled(db, 6)
    db.export("docs", f"{tmp_path}/out", form)
    other = db.create_collection("copy", 4)
    db.import_rows("copy", f"{tmp_path}/out", form, {"parquet": None, "json": "vid long, vec array<float>, name string", "csv": "vid long, vec string, n long, name string"}[form])
    assert other.count() == 6 and other.get(3) == [8.0, 9.0, 10.0, 11.0] and other.get_meta(3)["name"] == "a2"


def test_backup_rename_views(spark, db, tmp_path):
    filled(db, 6)
    db.backup(f"{tmp_path}/backup")
    db.rename_collection("docs", "texts")
    assert db.list_collections() == ["texts"] and db.collection("texts").config.name == "texts"
    restored = Database.restore(spark, f"{tmp_path}/backup", f"{tmp_path}/back")
    assert restored.collection("docs").count() == 6 and restored.stats()["docs"]["n"] == 6
    db.register_views()
    assert spark.sql("select count(*) from texts").first()[0] == 6


def test_settings_and_presets(tmp_path):
    s = Settings({"a": {"b": "7"}, "collections": {"x": {"dim": 3, "metric": "cosine", "index": {"type": "hnsw", "m": 8, "other": 1}}}})
    assert s.get("a.b", kind=int) == 7 and s.has("a.b") and not s.has("a.c") and s.get("a.b.c", 5) == 5
    s.set("p.q.r", True)
    s.dump(f"{tmp_path}/s.json")
    assert Settings.load(f"{tmp_path}/s.json").get("p.q.r") is True
    c = s.collection("x")
    assert (c.dim, c.metric.value, c.index.type, c.index.m) == (3, "cosine", IndexType.HNSW, 8)
    assert json.loads(c.to_json())["index"]["type"] == "hnsw"
    assert (preset("embedded").m, preset("low_memory").ef_construction, preset("high_performance").ef_search) == (8, 100, 100)
    assert access_path(IndexConfig(type="auto"), 10, True) is IndexType.FLAT and access_path(IndexConfig(type="auto"), 10**6, True) is IndexType.IVF
    with pytest.raises(NotFound):
        preset("none")


def test_streams(spark, db, tmp_path):
    c = db.create_collection("s", 2)
    for i in range(3):
        spark.createDataFrame([(j, [float(j), float(i)], "a") for j in range(1, 4 + i)], "vid long, vec array<float>, k string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("vid long, vec array<float>, k string").parquet(f"{tmp_path}/in")
        ingest.upsert_stream(stream, c, f"{tmp_path}/state").awaitTermination()
    assert c.count() == 5 and c.get(1) == [1.0, 2.0]
    near = ingest.within_radius(spark.createDataFrame([(1, [1.0, 2.0], "a")], "query_id long, qvec array<float>, k string"), c.rows(), "k", 1.0)
    assert {r["vid"] for r in near.collect()} == {1, 2}
    ts = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:07:00", "x")], "t string, by string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r["n"] for r in ingest.windowed_counts(ts, "ts", "by").collect()) == [1, 2]


def test_transactions_see_other_writers(spark, tmp_path):
    db = open_database(spark, f"{tmp_path}/db")
    c = db.create_collection("a", 2)
    c.insert([1.0, 2.0])
    db.begin()
    db.create_collection("b", 2).insert([0.0, 0.0])
    db.rollback()
    assert db.list_collections() == ["a"] and c.count() == 1
    db.begin()
    c.insert([3.0, 4.0])
    other = open_database(spark, f"{tmp_path}/db")
    other.collection("a").insert([5.0, 6.0])
    with pytest.raises(Conflict):
        db.commit()
    assert not db.in_transaction() and sorted(map(tuple, (r["vec"] for r in c.iterate()))) == [(1, 2), (5, 6)]
    other.collection("a").insert([7.0, 8.0])
    with pytest.raises(Conflict):
        c.insert([9.0, 9.0])
    c.refresh()
    c.insert([9.0, 9.0])
    assert c.count() == 4


def test_read_only_changes_nothing(spark, tmp_path):
    open_database(spark, f"{tmp_path}/db").create_collection("a", 2).insert([1.0, 2.0])
    db = open_database(spark, f"{tmp_path}/db", read_only=True)
    for change in (lambda: db.drop_collection("a"), lambda: db.rename_collection("a", "b"), lambda: db.create_collection("c", 2), lambda: db.collection("a").insert([0.0, 0.0]), db.begin):
        with pytest.raises(NotSupported):
            change()
    assert db.list_collections() == ["a"] and db.collection("a").count() == 1
    with pytest.raises(NotFound):
        open_database(spark, f"{tmp_path}/none", read_only=True)
    assert not (tmp_path / "none").exists()


def test_a_manifest_survives_a_stopped_write(spark, tmp_path):
    db = open_database(spark, f"{tmp_path}/db")
    db.create_collection("a", 2).insert([1.0, 2.0])
    (tmp_path / "db/a/manifest.json").rename(tmp_path / "db/a/manifest.json.new")
    again = open_database(spark, f"{tmp_path}/db")
    assert again.list_collections() == ["a"] and again.collection("a").count() == 1


@pytest.mark.parametrize("kind", ["ivf", "hnsw", "ivf_sq", "hnsw_pq"])
def test_filtered_search_on_a_stored_index(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8))
    db = open_database(spark, f"{tmp_path}/db")
    c = db.create_collection("a", 8)
    c.insert_batch(x.tolist(), [{"n": i % 6} for i in range(120)])
    wheres = (Q.eq("n", 1), Q.ne("n", 1), Q.and_(Q.ge("n", 2), Q.lt("n", 4)))
    wants = [[(r["vid"], r["rank"]) for r in c.search_batch(x[:5].tolist(), 5, where=w).orderBy("query_id", "rank").collect()] for w in wheres]
    c.build_index(IndexConfig(type=kind, nlist=4, nprobe=4, nsub=4, nbits=5, ef_construction=100, ef_search=120))
    c = open_database(spark, f"{tmp_path}/db").collection("a")
    for where, want in zip(wheres, wants, strict=True):
        got = [(r["vid"], r["rank"]) for r in c.search_batch(x[:5].tolist(), 5, where=where).orderBy("query_id", "rank").collect()]
        assert len(got) == 25
        if kind != "ivf_sq":  # its distances are those of codes
            assert got == want
