"""Search, filters, aggregates, mutations, quantizers and indexes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import aggregates as A
from vecloom.operators import filters as Q
from vecloom.operators import hnsw as H
from vecloom.operators import mutations as M
from vecloom.operators import search as S
from vecloom.operators.hnsw import HnswIndex
from vecloom.operators.ivf import IvfIndex
from vecloom.operators.kmeans import kmeans
from vecloom.operators.quantize import ProductQuantizer, ScalarQuantizer, adc
from vecloom.plans.config import IndexConfig, InvalidParameter


def gaussian(n, dim, seed=1):
    """Sums of four even draws from a fixed generator."""
    state, out = seed, np.empty(n * dim)
    for i in range(len(out)):
        total = -2.0
        for _ in range(4):
            state = (state * 1103515245 + 12345) & (2**64 - 1)
            total += ((state >> 16) & 0x7FFFFFFF) / 0x7FFFFFFF
        out[i] = total
    return out.reshape(n, dim).astype(np.float32)


@pytest.fixture(scope="module")
def data(spark):
    x = gaussian(400, 32)
    df = spark.createDataFrame([(i + 1, v.tolist(), i % 7, f"name{i % 3}" if i % 5 else None, i / 10, bool(i % 2)) for i, v in enumerate(x)], "vid long, vec array<float>, n int, name string, d double, b boolean").repartition(3).cache()
    return x, df


def test_every_metric_equals_the_expressions(spark, data):
    x, df = data
    q = S.query_frame(spark, x[:4])
    for metric in ("l2", "ip", "cosine", "l1", "hamming"):
        got = {(r["query_id"], r["rank"]): (r["vid"], r["distance"], r["score"]) for r in S.knn(df, q, 7, metric).collect()}
        d = q.crossJoin(F.broadcast(df)).select("query_id", "vid", V.distance(metric, "qvec", "vec").alias("d")).collect()
        for i in range(4):
            best = sorted((r["d"], r["vid"]) for r in d if r["query_id"] == i)[:7]
            assert [(got[(i, k + 1)][1], got[(i, k + 1)][0]) for k in range(7)] == best
        score = {"cosine": lambda z: 1 - z, "ip": lambda z: -z}.get(metric, lambda z: z)
        assert all(v[2] == score(v[1]) for v in got.values())


def test_grid_equals_scan(spark, data, monkeypatch):
    x, df = data
    q = S.query_frame(spark, x[:30])
    want = S.knn(df, q, 5).collect()
    near = S.range_search(df, q, 12.0).collect()
    monkeypatch.setattr(S, "QUERY_BYTES", 100)
    monkeypatch.setattr(S, "TILE_ROWS", 7)
    assert sorted(S.knn(df, q, 5).collect()) == sorted(want)
    assert sorted(S.range_search(df, q, 12.0).collect()) == sorted(near)


def test_edges_of_search(spark, data):
    x, df = data
    q = S.query_frame(spark, [x[0], np.zeros(32), np.full(32, 1e9)])
    assert S.knn(df, q, 0).count() == 0
    assert S.knn(df, q, 1000).count() == 1200
    assert all(np.isfinite(r["distance"]) for r in S.knn(df, q, 3, "cosine").collect())
    assert S.knn(df, S.query_frame(spark, [[1.0, 2.0]]), 3).count() == 0
    assert S.knn(df.limit(0), q, 3).count() == 0
    assert S.knn(df, q.limit(0), 3).count() == 0
    assert S.knn_by_id(df, 5, 1).first()["vid"] == 5
    assert S.knn_by_id(df, 9999).count() == 0
    assert S.range_search(df, q, -0.5).count() == 0
    top = S.knn(df, q.limit(1), 3).orderBy("rank").collect()
    assert {r["vid"] for r in top} <= {r["vid"] for r in S.range_search(df, q.limit(1), top[2]["distance"]).collect()}
    broken = df.unionByName(spark.createDataFrame([(9001, None), (9002, [1.0, None] * 16)], "vid long, vec array<float>"), allowMissingColumns=True)
    assert S.knn(broken, q, 1000).count() == 1200


@pytest.mark.parametrize(
    "tree, keep",
    [
        (Q.eq("N", 3), lambda r: r.n == 3), (Q.ne("name", "NAME1"), lambda r: r.name != "name1"), (Q.eq("name", "Name1"), lambda r: r.name == "name1"), (Q.gt("name", "a"), lambda r: False), (Q.gt("b", False), lambda r: False),
        (Q.eq("d", 1.0 + 1e-13), lambda r: r.d == 1.0), (Q.eq("b", True), lambda r: r.b), (Q.in_("name", ["NAME0"]), lambda r: r.name == "name0"), (Q.not_in("n", [1, 2]), lambda r: r.n not in (1, 2)),
        (Q.like("name", "%2"), lambda r: r.name == "name2"), (Q.regex("name", "[01]$"), lambda r: r.name in ("name0", "name1")), (Q.eq("nope", 1), lambda r: False), (Q.ne("nope", 1), lambda r: True),
        (Q.and_(), lambda r: True), (Q.or_(), lambda r: False), (~Q.eq("name", "name1"), lambda r: r.name != "name1"), (Q.ge("n", 2) & Q.le("n", 4) | Q.lt("d", 0.5), lambda r: 2 <= r.n <= 4 or r.d < 0.5),
    ],
)
def test_filters(data, tree, keep):
    _, df = data
    assert {r.vid for r in Q.matching(df, tree).collect()} == {r.vid for r in df.collect() if keep(r)}


def test_filtered_search_is_exact(spark, data):
    x, df = data
    got = S.knn(df, S.query_frame(spark, x[:2]), 5, where=Q.eq("n", 3)).collect()
    assert sorted(got) == sorted(S.knn(df.filter("n = 3"), S.query_frame(spark, x[:2]), 5).collect()) and len(got) == 10


def test_aggregates(data):
    x, df = data
    groups = np.arange(400) % 7
    for f, want in ((A.vector_sum, lambda v, w: v.sum(0)), (A.vector_mean, lambda v, w: v.mean(0))):
        for ordered in (False, True):
            for r in f(df, ["n"], ordered).collect():
                assert np.allclose(r[1], want(x[groups == r["n"]].astype(float), None))
    for r in A.weighted_mean(df, ["n"], "vid").collect():
        w = (np.arange(400) + 1)[groups == r["n"]]
        assert np.allclose(r[1], np.average(x[groups == r["n"]].astype(float), axis=0, weights=w))
    zero = A.weighted_mean(df.withColumn("w", F.lit(0.0)), ["n"], "w").first()
    assert np.allclose(zero[1], 0)
    s = A.collection_stats(df).first()
    assert (s["n"], s["min_vid"], s["max_vid"], s["min_dim"]) == (400, 1, 400, 32)


def test_mutations(spark, data):
    _, df = data
    new = df.filter("vid <= 50").withColumnRenamed("vid", "old")
    grown = M.insert(df, new, 1001, [F.col("old").desc()])
    assert {r.vid - 1000: r.old for r in grown.filter("vid > 1000").collect()} == {i: 51 - i for i in range(1, 51)}
    assert M.delete(df, spark.createDataFrame([(1,), (151,), (999999,)], "vid long")).count() == 398
    assert M.delete_by_filter(df, Q.eq("n", 0)).filter("n = 0").count() == 0
    assert M.delete_by_filter(df, None).count() == 0
    assert M.get(df, 3).count() == 1
    seen = []
    assert M.foreach(df, lambda r: seen.append(r.vid) or r.vid < 10, Q.gt("vid", 5)) == 4 and seen == [6, 7, 8, 9, 10]
    with pytest.raises(InvalidParameter):
        M.delete_meta_field(df, "vec")


def test_scalar_quantizer(spark, data):
    x, df = data
    q = ScalarQuantizer.train(df)
    assert np.abs(q.decode(q.encode(x)) - x).max() <= (q.high - q.low).max() / 255
    got = df.orderBy("vid").select(q.encode_column("vec").alias("c")).first()["c"]
    assert got == q.encode(x[:1].astype(np.float64))[0].tolist()
    flat = ScalarQuantizer(np.zeros(2), np.zeros(2))
    assert flat.encode(np.zeros((1, 2))).tolist() == [[0, 0]]


def test_product_quantizer(spark, data):
    x, _ = data
    q = ProductQuantizer.train(x.astype(np.float64), nsub=8, nbits=6)
    codes = q.encode(x)
    assert codes.shape == (400, 8) and q.bytes_per_vector() == 8
    error = ((q.decode(codes) - x) ** 2).sum(1).mean()
    assert error < (x.astype(float) ** 2).sum(1).mean() / 2
    table = q.table(x[0].astype(np.float64))
    df = spark.createDataFrame([(codes[1].tolist(), table.ravel().tolist())], "c array<int>, t array<double>")
    assert df.select(adc(F.col("c"), F.col("t"), 64)).first()[0] == pytest.approx(((q.decode(codes[1:2])[0] - x[0]) ** 2).sum(), rel=1e-6)
    with pytest.raises(InvalidParameter):
        ProductQuantizer.train(x, nsub=5)


def test_kmeans_is_repeatable_and_whole():
    x = gaussian(300, 8, 5).astype(np.float64)
    for metric in ("l2", "ip", "cosine"):
        a, b = kmeans(x, 8, metric), kmeans(x, 8, metric)
        assert (a == b).all() and np.isfinite(a).all()
    with pytest.raises(InvalidParameter):
        kmeans(x[:3], 8)


@pytest.mark.parametrize("kind, metric, floor", [("ivf", "l2", 0.9), ("ivf", "ip", 0.9), ("ivf", "cosine", 0.9), ("ivf_sq", "l2", 0.9), ("ivf_pq", "l2", 0.4), ("hnsw", "l2", 0.9), ("hnsw", "ip", 0.9), ("hnsw", "cosine", 0.9), ("hnsw_sq", "l2", 0.9), ("hnsw_pq", "cosine", 0.4)])
def test_recall_of_indexes(spark, data, kind, metric, floor):
    x, df = data
    config = IndexConfig(type=kind, nlist=8, nprobe=8, nsub=16, nbits=6, ef_construction=64, ef_search=64, shards=2)
    q = S.query_frame(spark, x[:20])
    exact = S.knn(df, q, 5, metric)
    if kind.startswith("ivf"):
        index = IvfIndex.train(df, config, metric).add(df)
        assert index.list_sizes().agg(F.sum("n")).first()[0] == 400
        if kind == "ivf":
            assert sorted(index.search(q, 5).collect()) == sorted(exact.collect())
            assert index.search(q, 5, nprobe=2).count() <= 100
    else:
        index = HnswIndex.build(df, config, metric)
        assert index.graph.count() == 400 and index.max_level() >= 0 and index.entry_points().count() == 2
        assert 1 <= index.neighbors(7).count() <= 32
    assert S.recall(index.search(q, 5), exact) >= floor
    gone = df.filter("vid % 2 = 0")
    assert index.remove(gone).search(q, 5).filter("vid % 2 = 0").count() == 0


def test_index_range_search(spark, data):
    x, df = data
    index = IvfIndex.train(df, IndexConfig(type="ivf", nlist=8, nprobe=8)).add(df)
    q = S.query_frame(spark, x[:5])
    assert sorted(index.range_search(q, 14.0).collect()) == sorted(S.range_search(df, q, 14.0).collect())
    assert index.range_search(q, -1.0).count() == 0


@pytest.mark.parametrize("kind, metric", [("ivf_pq", "cosine"), ("hnsw_pq", "l2")])
def test_product_codes_only_choose_candidates(spark, kind, metric):
    """Recall at the registered queries' parameters, fewer lists probed than there are."""
    df = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(gaussian(1000, 64, 9))], "vid long, vec array<float>").repartition(3).cache()
    q = df.filter("vid % 20 = 0").select(F.col("vid").alias("query_id"), F.col("vec").alias("qvec"))
    config = IndexConfig(type=kind, nlist=16, nprobe=8, nsub=8, nbits=6, m=16, ef_construction=100, ef_search=100)
    exact = S.knn(df, q, 10, metric)
    if kind == "hnsw_pq":
        found = HnswIndex.build(df, config, metric).search(q, 10)
        assert S.recall(found, exact) >= 0.9
    else:  # all that the probed lists hold
        index = IvfIndex.train(df, config, metric).add(df)
        found = index.search(q, 10)
        raw = IvfIndex(index.centroids, metric, IndexConfig(type="ivf", nlist=16, nprobe=8)).add(df)
        assert S.recall(found, raw.search(q, 10)) >= 0.9
        assert S.recall(index.search(q, 10, nprobe=16), exact) >= 0.9
        assert S.recall(index.range_search(q, 0.7), raw.range_search(q, 0.7)) == 1
    want = {(r["query_id"], r["vid"]): r["distance"] for r in S.knn(df, q, 1000, metric).collect()}
    assert all(r["distance"] == want[r["query_id"], r["vid"]] for r in found.collect())


def test_nan_distances_come_last():
    d, vid = np.array([3.0, np.nan, 1, np.nan, 2] + [np.nan] * 6), np.arange(1, 12)
    assert S._best(d, vid, 5)[:3].tolist() == [2, 4, 0] and len(S._best(d, vid, 5)) == 5


@pytest.mark.parametrize("kind, metric", [("hnsw", "l2"), ("hnsw_pq", "l2"), ("ivf_pq", "cosine"), ("ivf_sq", "l2")])
def test_recall_on_clustered_rows(spark, kind, metric):
    """Clusters of different spread, as in the catalogue: the nearest links alone leave nodes unreachable."""
    x = gaussian(1000, 64, 9) * (1 + np.arange(1000) % 10)[:, None].astype(np.float32)
    df = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "vid long, vec array<float>").repartition(3).cache()
    q = df.filter("vid % 20 = 0").select(F.col("vid").alias("query_id"), F.col("vec").alias("qvec"))
    config = IndexConfig(type=kind, nlist=16, nprobe=12, nsub=8, nbits=6, m=16, ef_construction=100, ef_search=200)
    index = IvfIndex.train(df, config, metric).add(df) if kind.startswith("ivf") else HnswIndex.build(df, config, metric)
    assert S.recall(index.search(q, 10), S.knn(df, q, 10, metric)) >= 0.9


def test_many_queries_go_in_blocks(spark, data, monkeypatch):
    x, df = data
    q = S.query_frame(spark, x[:40])
    index = IvfIndex.train(df, IndexConfig(type="ivf", nlist=8, nprobe=8)).add(df)
    want = sorted(index.search(q, 3).collect())
    monkeypatch.setattr(S, "QUERY_BYTES", 4000)
    assert len(list(S.packed_queries(q, 32))) > 2 and sorted(index.search(q, 3).collect()) == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_results_of_a_query_are_ranked_where_they_are_found(spark, data, monkeypatch):
    """k beyond the rows, and no result held longer than its query's turn: no shuffle of results, no list of all of them."""
    x, df = data
    got = S.knn(df, S.query_frame(spark, x[:20]), 100_000)
    assert "Window" not in _plan(got) and got.count() == 20 * 400
    spool, ids = S.Spool(lambda b, n: np.frombuffer(b, np.float32).reshape(n, -1)), np.random.default_rng(1).permutation(400)
    twice = np.concatenate((x[:200], x[:200]))  # every distance twice: ties go to the smaller vid
    for a in range(0, 400, 50):
        spool.add(0, pa.py_buffer(ids[a : a + 50].tobytes()), pa.py_buffer(twice[a : a + 50].tobytes()))
    monkeypatch.setattr(S, "HELD", 800)
    for k in (None, 300, 1000):
        found = [r for b in S.gathered("l2", np.arange(5), x[:5], spool, k, None) for r in b.to_pylist()]
        d = S.distances("l2", x[:5], twice)
        for q in range(5):
            want = sorted(zip(d[q], ids, strict=True))[:k]
            assert [(r["distance"], r["vid"], r["rank"]) for r in found if r["query_id"] == q] == [(e, v, n + 1) for n, (e, v) in enumerate(want)]


def test_bounds_are_below_the_distances():
    """So that no nearest row of an all-pairs search is lost, whatever the numbers."""
    rng = np.random.default_rng(3)
    for scale in (1e-30, 1e-9, 1.0, 1e9, 1e25):
        x = (rng.standard_normal((60, 16)) * scale).astype(np.float32)
        x[3], x[4, 2], x[5, 1], x[6] = 0, np.nan, np.inf, x[7]
        for metric in ("l2", "ip", "cosine", "l1", "hamming"):
            with np.errstate(all="ignore"):
                d, low = S.distances(metric, x[:20], x), S._Bounds(metric, x[:20]).of(slice(0, 20), x)
                assert not (low > d).any()
                held = S.Nearest(metric, x[:20], 7)
                for a in (0, 5, 30):
                    held.add(np.arange(60)[::-1][a : {0: 5, 5: 30, 30: 60}[a]], x[a : {0: 5, 5: 30, 30: 60}[a]])
            for i in range(20):
                want = np.lexsort((np.arange(60)[::-1], d[i]))[:7]
                assert held.vid[i].tolist() == (59 - want).tolist() and np.array_equal(held.d[i], d[i][want], equal_nan=True)


def test_range_with_capacity_keeps_no_more(spark, data):
    x, df = data
    got = S.range_search(df, S.query_frame(spark, x[:30]), 1000.0, capacity=7)
    assert got.count() == 30 * 7
    scan = S._scan("l2", np.arange(30), x[:30], 7, 1000.0)
    batches = df.select("vid", "vec").toArrow().to_batches()
    assert sum(b.num_rows for b in scan(batches)) == 30 * 7
    assert sorted(got.drop("score").collect()) == sorted(S.range_search(df, S.query_frame(spark, x[:30]), 1000.0).filter("rank <= 7").drop("score").collect())
    assert S.range_search(df, S.query_frame(spark, x[:3]), 1000.0, capacity=0).count() == 0


def test_range_results_leave_a_task_in_small_batches(spark, data):
    x, df = data
    q = S.query_frame(spark, x[:20])
    assert "Window" not in _plan(S.range_search(df, q, 1000.0)) and S.range_search(df, q, 1000.0).count() == 20 * 400
    spool = S.Spool(lambda b, n: np.frombuffer(b, np.float32).reshape(n, -1))
    many = np.zeros((100_000, 2), np.float32)
    spool.add(0, pa.py_buffer(np.arange(len(many)).tobytes()), pa.py_buffer(many.tobytes()))
    sizes = [b.num_rows for b in S.gathered("l2", np.arange(3), many[:3], spool, None, 1.0)]
    assert sum(sizes) == 300_000 and max(sizes) < 1 << 17


def test_index_range_is_ranked_where_it_is_found(spark, data):
    x, df = data
    q = S.query_frame(spark, x[:50])
    for kind in ("ivf", "ivf_sq", "ivf_pq"):
        index = IvfIndex.train(df, IndexConfig(type=kind, nlist=8, nprobe=3, nsub=16, nbits=6)).add(df)
        got = index.range_search(q, 25.0)
        assert "Window" not in _plan(got)
        assert sorted(index.range_search(q, 25.0, capacity=4).collect()) == sorted(got.filter("rank <= 4").collect())
        assert sorted(index.search(q, 300).collect()) == sorted(index.range_search(q, 1e9).filter("rank <= 300").collect())
        if kind == "ivf":
            assert sorted(index.range_search(q, 25.0, nprobe=8).collect()) == sorted(S.range_search(df, q, 25.0).collect())


def test_vectors_beside_product_codes_rank_the_probed_lists(spark, data):
    """All of them, however the rows are dealt; a partition gives k candidates a query, not k a batch and list."""
    x, df = data
    q = S.query_frame(spark, x[:30])
    index = IvfIndex.train(df, IndexConfig(type="ivf_pq", nlist=8, nprobe=3, nsub=4, nbits=2)).add(df)
    raw = IvfIndex(index.centroids, "l2", IndexConfig(type="ivf", nlist=8, nprobe=3)).add(df)
    assert sorted(index.search(q, 5).collect()) == sorted(raw.search(q, 5).collect())
    probes = index.probes(x[:30])
    found = index._scanned(index.postings.coalesce(1), np.arange(30), x[:30], probes, 5, None)
    assert found.count() <= 30 * 5


@pytest.mark.parametrize("kind, metric", [("hnsw", "l2"), ("hnsw_sq", "cosine"), ("hnsw_pq", "l2")])
def test_many_queries_scan_the_shards(spark, data, monkeypatch, kind, metric):
    """Scans cost less than so many walks, and find the nearest rows that walks may miss; each shard has its own task."""
    x, df = data
    index = HnswIndex.build(df, IndexConfig(type=kind, nsub=8, nbits=4, ef_construction=40, ef_search=10, shards=3), metric)
    assert index.graph.select("shard", F.spark_partition_id().alias("task")).distinct().count() == 3
    q = S.query_frame(spark, x[:30])
    monkeypatch.setattr(H, "SCANNED", 30)
    want = S.knn(df, q, 5, metric)
    assert S.recall(index.search(q, 5), want) >= (0.9 if kind == "hnsw_sq" else 1)
    if kind == "hnsw":
        assert sorted(index.search(q, 5).collect()) == sorted(want.collect())
        assert sorted(index.search(q, 5, where=Q.eq("n", 3)).collect()) == sorted(S.knn(df.filter("n = 3"), q, 5, metric).collect())
