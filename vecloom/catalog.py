"""Queries over the driver tables, one for each operator of the vector engine, with DuckDB SQL beside them.

Vectors are the embeddings scaled by label + 1, so that metrics rank differently;
vid = vec_id + 1; the queries are the rows whose vid is divisible by 20. Metadata comes from
documents, labels and events by the same number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import scalars as X
from vecloom.functions import vectors as V
from vecloom.operators import aggregates as A
from vecloom.operators import filters as Q
from vecloom.operators import mutations as M
from vecloom.operators import search as S
from vecloom.operators.hnsw import HnswIndex, level_column
from vecloom.operators.ivf import IvfIndex, pq_knn
from vecloom.operators.quantize import ProductQuantizer, ScalarQuantizer, sq_code, sq_value
from vecloom.plans.config import IndexConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NLIST, NPROBE, DIM, NSUB, CODES = 16, 4, 64, 8, 16


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# tables


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.transform("embedding", lambda x: (x.cast("double") * (F.col("label") + 1)).cast("float"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") + 1).alias("vid"), vec.alias("vec"), "label")


def queries_of(df: DataFrame) -> DataFrame:
    return df.filter(F.col("vid") % 20 == 0).select(F.col("vid").alias("query_id"), F.col("vec").alias("qvec"))


def with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    docs = read("documents").select((F.col("doc_id") + 1).alias("vid"), "lang", "source", "n_chars")
    labels = read("labels").select((F.col("doc_id") + 1).alias("vid"), (F.col("toxic") == 1).alias("toxic"), "quality")
    events = read("events").select((F.col("event_id") + 1).alias("vid"), "value", "event_type")
    return rows(spark, sf_dir).join(docs, "vid", "left").join(labels, "vid", "left").join(events, "vid", "left")


V_SQL = "v AS (SELECT vec_id + 1 AS vid, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * (label + 1) AS FLOAT)) AS vec, label FROM embeddings)"
Q_SQL = "q AS (SELECT vid AS query_id, vec AS qvec FROM v WHERE vid % 20 = 0)"
M_SQL = (
    "m AS (SELECT v.vid, vec, label, lang, source, n_chars, toxic = 1 AS toxic, quality, value, event_type FROM v LEFT JOIN documents d ON d.doc_id + 1 = v.vid "
    "LEFT JOIN labels l ON l.doc_id + 1 = v.vid LEFT JOIN events e ON e.event_id + 1 = v.vid)"
)


def _fold(x: str) -> str:
    return f"list_reduce(list_prepend(CAST(0 AS DOUBLE), {x}), lambda a, b: a + b)"


def _zip(a: str, b: str, f: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: {f.replace('#1', 'CAST(p[1] AS DOUBLE)').replace('#2', 'CAST(p[2] AS DOUBLE)')})"


def _dot(a: str, b: str) -> str:
    return _fold(_zip(a, b, "#1 * #2"))


def _distance(metric: str, a: str = "qvec", b: str = "vec") -> str:
    if metric == "cosine":
        na, nb = f"sqrt({_dot(a, a)})", f"sqrt({_dot(b, b)})"
        return f"(CASE WHEN {na} < 1.1920929e-07 OR {nb} < 1.1920929e-07 THEN CAST(1 AS DOUBLE) ELSE 1 - {_dot(a, b)} / ({na} * {nb}) END)"
    if metric == "ip":
        return f"(-{_dot(a, b)})"
    return _fold(_zip(a, b, {"l2": "(#1 - #2) * (#1 - #2)", "l1": "abs(#1 - #2)", "hamming": "CAST(#1 <> #2 AS DOUBLE)"}[metric]))


def _score(metric: str) -> str:
    return {"cosine": "1 - distance", "ip": "-distance"}.get(metric, "distance")


def _ranked(metric: str, keep: str, candidates: str, first: str = "") -> str:
    return (
        f"{first}, d AS ({candidates}) SELECT query_id, CAST(rank AS INTEGER) AS rank, vid, distance, {_score(metric)} AS score "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vid) AS rank FROM d) WHERE {keep}"
    )


def _knn_sql(metric: str, k: int = 10, where: str | None = None) -> str:
    source = f"(SELECT * FROM m WHERE {where})" if where else "v"
    return _ranked(metric, f"rank <= {k}", f"SELECT query_id, vid, {_distance(metric)} AS distance FROM q, {source}", f"WITH {V_SQL}, {Q_SQL}" + f", {M_SQL}" * bool(where))


# exact search


def _knn_query(metric: str):
    def run(spark, sf_dir):
        df = rows(spark, sf_dir)
        return S.knn(df, queries_of(df), 10, metric)

    run.__name__ = f"knn_{metric}"
    _query(_knn_sql(metric))(run)


for _metric in ("l2", "ip", "cosine", "l1", "hamming"):
    _knn_query(_metric)


@_query(f"WITH {V_SQL}, q AS (SELECT vid AS query_id, vec AS qvec FROM v WHERE vid = 7)" + _ranked("l2", "rank <= 10", f"SELECT query_id, vid, {_distance('l2')} AS distance FROM q, v"))
def knn_by_id(spark, sf_dir):
    return S.knn_by_id(rows(spark, sf_dir), 7, 10, "l2")


@_query(_ranked("l2", "rank <= 10", f"SELECT query_id, vid, {_distance('l2')} AS distance FROM q, v", f"WITH {V_SQL}, q AS (SELECT vid AS query_id, vec AS qvec FROM v)"))
def knn_batch_join(spark, sf_dir):
    df = rows(spark, sf_dir)
    return S.knn(df, df.select(F.col("vid").alias("query_id"), F.col("vec").alias("qvec")), 10, "l2")


@_query(f"SELECT r.*, m.lang, m.vec[1] AS first FROM ({_knn_sql('cosine')}) r JOIN (WITH {V_SQL}, {M_SQL} SELECT * FROM m) m USING (vid)")
def knn_include_vectors_meta(spark, sf_dir):
    df = with_meta(spark, sf_dir)
    return S.knn(df, queries_of(df), 10, "cosine", include=("vec", "lang")).withColumn("first", F.get("vec", F.lit(0))).drop("vec")


@_query(_ranked("l2", "rank <= 100000", f"SELECT query_id, vid, {_distance('l2')} AS distance FROM q, v", f"WITH {V_SQL}, q AS (SELECT vid AS query_id, vec AS qvec FROM v WHERE vid % 20 = 0)"))
def knn_k_gt_n(spark, sf_dir):
    df = rows(spark, sf_dir)
    return S.knn(df, queries_of(df), 100_000, "l2")


# filtered search: name, filter, SQL of the same

FILTERS = (
    ("eq", Q.eq("label", 3), "label = 3"),
    ("ne_missing", Q.ne("toxic", True), "coalesce(toxic <> true, true)"),
    ("range", Q.and_(Q.ge("n_chars", 500), Q.lt("n_chars", 3000)), "coalesce(n_chars >= 500 AND n_chars < 3000, false)"),
    ("and_or_not", Q.or_(Q.and_(Q.eq("lang", "EN"), Q.not_(Q.eq("source", "src0"))), Q.eq("label", 1)), "(coalesce(lang = 'en', false) AND NOT coalesce(source = 'src0', false)) OR label = 1"),
    ("in", Q.in_("lang", ["DE", "fr"]), "coalesce(lang IN ('de', 'fr'), false)"),
    ("not_in", Q.not_in("lang", ["de", "fr"]), "coalesce(lang NOT IN ('de', 'fr'), false)"),
    ("like", Q.like("source", "src1%"), "coalesce(source LIKE 'src1%', false)"),
    ("regex", Q.regex("source", "^src[0-4]$"), "coalesce(regexp_matches(source, '^src[0-4]$'), false)"),
    ("float_tolerance", Q.or_(Q.gt("value", 50.0), Q.eq("value", 10.0)), "coalesce(value > 50, false) OR coalesce(abs(value - 10) <= 1e-12, false)"),
    ("bool", Q.eq("toxic", False), "coalesce(toxic = false, false)"),
    ("string_ci", Q.eq("LANG", "Es"), "coalesce(lower(lang) = 'es', false)"),
)


def _filter_query(name: str, f: Q.Filter, where: str):
    def run(spark, sf_dir):
        df = with_meta(spark, sf_dir)
        return S.knn(df, queries_of(rows(spark, sf_dir)), 10, "l2", where=f)

    run.__name__ = f"knn_filter_{name}"
    _query(_knn_sql("l2", 10, where))(run)


for _filter in FILTERS:
    _filter_query(*_filter)


# range search


def _range_sql(metric: str, radius: float, keep: str = "true") -> str:
    return _ranked(metric, keep, f"SELECT * FROM (SELECT query_id, vid, {_distance(metric)} AS distance FROM q, v) WHERE distance <= {radius} AND {radius} >= 0", f"WITH {V_SQL}, {Q_SQL}")


@_query(_range_sql("l2", 20.0))
def range_l2(spark, sf_dir):
    df = rows(spark, sf_dir)
    return S.range_search(df, queries_of(df), 20.0, "l2")


@_query(_range_sql("cosine", 0.8))
def range_cosine(spark, sf_dir):
    df = rows(spark, sf_dir)
    return S.range_search(df, queries_of(df), 0.8, "cosine")


@_query(_range_sql("l2", 60.0, "rank <= 7"))
def range_capacity(spark, sf_dir):
    df = rows(spark, sf_dir)
    return S.range_search(df, queries_of(df), 60.0, "l2", capacity=7)


@_query(_range_sql("l2", -1.0))
def range_negative_radius(spark, sf_dir):
    df = rows(spark, sf_dir)
    return S.range_search(df, queries_of(df), -1.0, "l2")


# vector functions; pairs are a row and the row with the next vid

P_SQL = f"WITH {V_SQL}, p AS (SELECT a.vid, a.vec AS a, b.vec AS b FROM v a JOIN v b ON b.vid = a.vid + 1)"


def pairs(spark, sf_dir) -> DataFrame:
    df = rows(spark, sf_dir)
    return df.select("vid", F.col("vec").alias("a")).join(df.select((F.col("vid") - 1).alias("vid"), F.col("vec").alias("b")), "vid")


def _elements(sql: str) -> str:
    return f"{P_SQL} SELECT vid, CAST(unnest(range(len(r))) AS INTEGER) AS pos, unnest(r) AS value FROM (SELECT vid, {sql} AS r FROM p)"


def _vector_query(name: str, column, sql: str):
    def run(spark, sf_dir):
        return pairs(spark, sf_dir).select("vid", F.posexplode(column()).alias("pos", "value"))

    run.__name__ = name
    _query(_elements(sql))(run)


_each = "list_transform(a, lambda x: {})"
_vector_query("vec_add", lambda: V.add("a", "b"), _zip("a", "b", "#1 + #2"))
_vector_query("vec_sub", lambda: V.sub("a", "b"), _zip("a", "b", "#1 - #2"))
_vector_query("vec_scale", lambda: V.scale("a", 2.5), _each.format("CAST(x AS DOUBLE) * CAST(2.5 AS DOUBLE)"))
_vector_query("vec_div", lambda: V.div("a", 3.0), _each.format("CAST(x AS DOUBLE) / CAST(3 AS DOUBLE)"))
_vector_query("vec_div_zero", lambda: V.div("a", 0.0), _each.format("CAST(0 AS DOUBLE)"))
_vector_query(
    "vec_cross", lambda: V.cross(F.slice("a", 1, 3), F.slice("b", 1, 3)),
    "[" + ", ".join(f"CAST(a[{i}] AS DOUBLE) * CAST(b[{j}] AS DOUBLE) - CAST(a[{j}] AS DOUBLE) * CAST(b[{i}] AS DOUBLE)" for i, j in ((2, 3), (3, 1), (1, 2))) + "]",
)
_vector_query("vec_normalize_l2", lambda: V.normalize("a"), _each.format(f"CAST(x AS DOUBLE) / sqrt({_dot('a', 'a')})"))
_vector_query("vec_normalize_l1", lambda: V.normalize_l1("a"), _each.format("CAST(x AS DOUBLE) / " + _fold("list_transform(a, lambda y: abs(CAST(y AS DOUBLE)))")))
_vector_query("vec_int8", lambda: V.int8_quantize("a", -2.0, 2.0), _each.format("CAST(floor(least(greatest((CAST(x AS DOUBLE) + 2) * (CAST(255 AS DOUBLE) / 4), 0), 255) + CAST(0.5 AS DOUBLE)) - 128 AS INTEGER)"))
_vector_query("vec_fill", lambda: V.constant(1.5, 4), "[CAST(1.5 AS DOUBLE), CAST(1.5 AS DOUBLE), CAST(1.5 AS DOUBLE), CAST(1.5 AS DOUBLE)]")


@_query(f"{P_SQL} SELECT vid, {_dot('a', 'b')} AS dot, " + ", ".join(f"{_distance(m, 'a', 'b')} AS {m}" for m in ("l2", "ip", "cosine", "l1", "hamming")) + f", sqrt({_distance('l2', 'a', 'b')}) AS l2_root, 1 - {_distance('cosine', 'a', 'b')} AS similarity FROM p")
def vec_distances(spark, sf_dir):
    return pairs(spark, sf_dir).select("vid", V.dot("a", "b").alias("dot"), *[V.distance(m, "a", "b").alias(m) for m in ("l2", "ip", "cosine", "l1", "hamming")], V.l2("a", "b").alias("l2_root"), V.cosine_similarity("a", "b").alias("similarity"))


@_query(f"{P_SQL} SELECT vid, sqrt({_dot('a', 'a')}) AS l2, {_dot('a', 'a')} AS l2_squared, {_fold('list_transform(a, lambda y: abs(CAST(y AS DOUBLE)))')} AS l1, abs(sqrt({_dot('a', 'a')}) - 1) <= 1e-3 AS unit FROM p")
def vec_norms(spark, sf_dir):
    return pairs(spark, sf_dir).select("vid", V.norm_l2("a").alias("l2"), V.norm_l2_squared("a").alias("l2_squared"), V.norm_l1("a").alias("l1"), V.is_normalized("a", 1e-3).alias("unit"))


_SUM = _fold("list_transform(a, lambda y: CAST(y AS DOUBLE))")


@_query(
    f"{P_SQL}, s AS (SELECT vid, a, {_SUM} AS total FROM p), t AS (SELECT *, total / len(a) AS mean FROM s), u AS (SELECT *, {_fold('list_transform(a, lambda y: (CAST(y AS DOUBLE) - mean) * (CAST(y AS DOUBLE) - mean))')} / len(a) AS variance FROM t) "
    "SELECT vid, total, mean, variance, sqrt(variance) AS stddev, list_max(a) AS high, list_min(a) AS low FROM u"
)
def vec_stats(spark, sf_dir):
    return pairs(spark, sf_dir).select("vid", V.fold("a").alias("total"), V.mean("a").alias("mean"), V.variance("a").alias("variance"), V.stddev("a").alias("stddev"), F.array_max("a").alias("high"), F.array_min("a").alias("low"))


@_query(f"{P_SQL} SELECT vid, CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS argmax, CAST(list_position(a, list_min(a)) - 1 AS INTEGER) AS argmin FROM p")
def vec_argminmax(spark, sf_dir):
    return pairs(spark, sf_dir).select("vid", V.argmax("a").alias("argmax"), V.argmin("a").alias("argmin"))


@_query(f"{P_SQL} SELECT vid, vid % 3 <> 0 AS valid, true AS same, false AS other FROM p")
def vec_valid_equal(spark, sf_dir):
    broken = F.when(F.col("vid") % 3 == 0, F.concat("a", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("a"))
    return pairs(spark, sf_dir).select("vid", V.is_valid(broken).alias("valid"), V.equal("a", "a").alias("same"), V.equal("a", "b").alias("other"))


# aggregates, with sums in vid order


def _grouped(spark, sf_dir, f) -> DataFrame:
    out = f(rows(spark, sf_dir))
    return out.select("label", F.posexplode(out.columns[-1]).alias("pos", "value"))


_X_SQL = f"WITH {V_SQL}, x AS (SELECT label, vid, unnest(range(len(vec))) AS pos, CAST(unnest(vec) AS DOUBLE) AS x FROM v)"


@_query(f"{_X_SQL} SELECT label, CAST(pos AS INTEGER) AS pos, {_fold('list(x ORDER BY vid)')} AS value FROM x GROUP BY label, pos")
def vec_sum_by_label(spark, sf_dir):
    return _grouped(spark, sf_dir, lambda df: A.vector_sum(df, ["label"], ordered=True))


@_query(f"{_X_SQL} SELECT label, CAST(pos AS INTEGER) AS pos, {_fold('list(x ORDER BY vid)')} / count(*) AS value FROM x GROUP BY label, pos")
def vec_mean_by_label(spark, sf_dir):
    return _grouped(spark, sf_dir, lambda df: A.vector_mean(df, ["label"], ordered=True))


@_query(f"{_X_SQL} SELECT label, CAST(pos AS INTEGER) AS pos, {_fold('list(x * vid ORDER BY vid)')} / sum(vid) AS value FROM x GROUP BY label, pos")
def vec_weighted_mean(spark, sf_dir):
    return _grouped(spark, sf_dir, lambda df: A.weighted_mean(df.withColumn("weight", F.col("vid")), ["label"], "weight", ordered=True))


@_query(f"{_X_SQL} SELECT CAST(pos AS INTEGER) AS pos, min(x) AS mn, max(x) AS mx FROM x GROUP BY pos")
def vec_dim_minmax(spark, sf_dir):
    return A.dim_min_max(rows(spark, sf_dir))


@_query(f"WITH {V_SQL} SELECT count(*) AS n, min(vid) AS min_vid, max(vid) AS max_vid, CAST(min(len(vec)) AS INTEGER) AS min_dim, CAST(max(len(vec)) AS INTEGER) AS max_dim FROM v")
def collection_stats(spark, sf_dir):
    return A.collection_stats(rows(spark, sf_dir))


# mutations and point access; results show the vid and a sum of the vector

_VS = f"{_fold('list_transform(vec, lambda y: CAST(y AS DOUBLE))')} AS total"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("vid", V.fold("vec").alias("total"), *more)


@_query(f"WITH {V_SQL} SELECT vid, {_VS}, label FROM v UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY label, vid DESC) - 1 AS vid, {_VS}, label FROM v WHERE vid <= 300")
def coll_insert_vids(spark, sf_dir):
    df = rows(spark, sf_dir)
    new = df.filter("vid <= 300").withColumn("__old", -F.col("vid")).drop("vid")
    return _shown(M.insert(df, new, 1_000_000, ["label", "__old"]), "label")


@_query(f"WITH {V_SQL} SELECT vid, CASE WHEN vid % 2 = 0 THEN 2 * total ELSE total END AS total, label FROM (SELECT vid, label, {_VS} FROM v) UNION ALL SELECT 2000000 + vid, 2 * total, NULL FROM (SELECT vid, {_VS} FROM v WHERE vid <= 10)")
def coll_upsert(spark, sf_dir):
    df = rows(spark, sf_dir)
    doubled = df.select("vid", F.transform("vec", lambda x: x * 2).alias("vec"))
    fresh = doubled.filter("vid <= 10").withColumn("vid", F.col("vid") + 2_000_000)
    return _shown(M.upsert(df, doubled.filter("vid % 2 = 0").unionByName(fresh)), "label")


@_query(f"WITH {V_SQL} SELECT vid, {_VS} FROM v WHERE vid % 7 <> 0")
def coll_delete(spark, sf_dir):
    df = rows(spark, sf_dir)
    return _shown(M.delete(df, df.filter("vid % 7 = 0").select("vid").union(spark.createDataFrame([(999_999,)], "vid long"))))


@_query(f"WITH {V_SQL}, {M_SQL} SELECT vid, {_VS} FROM m WHERE NOT coalesce(lang = 'en', false)")
def coll_delete_by_filter(spark, sf_dir):
    return _shown(M.delete_by_filter(with_meta(spark, sf_dir), Q.eq("lang", "en")))


@_query(f"WITH {V_SQL} SELECT CAST(vid * 3 AS INTEGER) AS pos, vid, {_VS} FROM v WHERE vid IN (5, 9, 11)")
def coll_get_batch(spark, sf_dir):
    ids = spark.createDataFrame([(15, 5), (27, 9), (33, 11), (0, 99_999_999)], "pos int, vid long")
    got = M.get_batch(rows(spark, sf_dir), ids)
    return got.select("pos", "vid", V.fold("vec").alias("total"))


@_query(f"WITH {V_SQL}, {M_SQL} SELECT vid, CASE WHEN vid % 5 = 0 THEN 'new' ELSE lang END AS lang, CASE WHEN vid % 5 = 0 THEN NULL ELSE n_chars END AS n_chars FROM m")
def coll_set_meta(spark, sf_dir):
    df = with_meta(spark, sf_dir).select("vid", "vec", "lang", "n_chars")
    return M.set_meta(df, df.filter("vid % 5 = 0").select("vid", F.lit("new").alias("lang"))).select("vid", "lang", "n_chars")


@_query(f"WITH {V_SQL} SELECT vid, {_VS} FROM v WHERE vid = 42")
def coll_get(spark, sf_dir):
    return _shown(M.get(rows(spark, sf_dir), 42))


@_query(f"WITH {V_SQL}, {M_SQL} SELECT vid, lang FROM m WHERE coalesce(label > 5, false)")
def coll_iterate(spark, sf_dir):
    found = [(r["vid"], r["lang"]) for r in M.iterate(with_meta(spark, sf_dir).select("vid", "lang", "label"), Q.gt("label", 5))]
    return spark.createDataFrame(found, "vid long, lang string")


# quantization

_SQ_SQL = f"{_X_SQL}, r AS (SELECT pos, min(x) AS mn, max(x) AS mx FROM x GROUP BY pos), f AS (SELECT *, CASE WHEN mx - mn > 1e-6 THEN CAST(255 AS DOUBLE) / (mx - mn) ELSE CAST(1 AS DOUBLE) END AS scale FROM r), c AS (SELECT vid, pos, mn, scale, CAST(floor(least(greatest((x - mn) * scale, CAST(0 AS DOUBLE)), CAST(255 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS code FROM x JOIN f USING (pos))"


def _coded(spark, sf_dir) -> DataFrame:
    df = rows(spark, sf_dir)
    x = df.select("vid", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    # a row for each place of a vector
    return x.join(F.broadcast(A.dim_min_max(df)), "pos").withColumn("code", sq_code(F.col("x"), F.col("mn"), F.col("mx")))


@_query(f"{_SQ_SQL} SELECT CAST(pos AS INTEGER) AS pos, mn, scale FROM f")
def sq_train(spark, sf_dir):
    q = ScalarQuantizer.train(rows(spark, sf_dir))
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(q.low, q.scale, strict=True))], "pos int, mn double, scale double")


@_query(f"{_SQ_SQL} SELECT vid, CAST(pos AS INTEGER) AS pos, code FROM c")
def sq_encode(spark, sf_dir):
    return _coded(spark, sf_dir).select("vid", "pos", "code")


@_query(f"{_SQ_SQL} SELECT vid, CAST(pos AS INTEGER) AS pos, mn + code / scale AS value FROM c")
def sq_decode(spark, sf_dir):
    return _coded(spark, sf_dir).select("vid", "pos", sq_value(F.col("code"), F.col("mn"), F.col("mx")).alias("value"))


@_query(
    f"{_SQ_SQL}, {Q_SQL}, w AS (SELECT vid, list(mn + code / scale ORDER BY pos) AS vec FROM c GROUP BY vid)"
    + _ranked("l2", "rank <= 10", f"SELECT query_id, vid, {_distance('l2')} AS distance FROM q, w")
)
def sq_knn(spark, sf_dir):
    df = rows(spark, sf_dir)
    index = IvfIndex(np.zeros((1, DIM)), "l2", IndexConfig(type="ivf_sq", nlist=1), ScalarQuantizer.train(df)).add(df)
    return index.search(queries_of(df), 10)


def _fixed_book(df: DataFrame) -> ProductQuantizer:
    """Sub-vectors of the first CODES vectors as the book."""
    first = np.array([r["vec"] for r in df.filter(F.col("vid") <= CODES).orderBy("vid").select("vec").collect()], np.float64)
    return ProductQuantizer(np.stack(np.split(first, NSUB, axis=1)))


_SUB = DIM // NSUB
_PQ_SQL = (
    f"WITH {V_SQL}, s AS (SELECT unnest(range({NSUB})) AS sub), b AS (SELECT sub, vid - 1 AS code, vec[sub * {_SUB} + 1 : sub * {_SUB} + {_SUB}] AS bv FROM v, s WHERE vid <= {CODES}), "
    f"y AS (SELECT vid, sub, vec[sub * {_SUB} + 1 : sub * {_SUB} + {_SUB}] AS sv FROM v, s), "
    f"e AS (SELECT vid, sub, code FROM (SELECT vid, y.sub, code, row_number() OVER (PARTITION BY vid, y.sub ORDER BY {_distance('l2', 'bv', 'sv')}, code) AS n FROM y JOIN b USING (sub)) WHERE n = 1)"
)


@_query(f"{_PQ_SQL} SELECT vid, CAST(sub AS INTEGER) AS sub, CAST(code AS INTEGER) AS code FROM e")
def pq_encode_fixed_book(spark, sf_dir):
    df = rows(spark, sf_dir)
    index = IvfIndex(np.zeros((1, DIM)), "l2", IndexConfig(type="ivf_pq", nlist=1), _fixed_book(df))
    code = F.conv(F.substring(F.hex("code"), F.col("sub") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return index.assign(df).withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(NSUB - 1)))).select("vid", "sub", code.alias("code"))


@_query(
    f"{_PQ_SQL}, {Q_SQL}, t AS (SELECT query_id, b.sub, code, {_distance('l2', f'qvec[b.sub * {_SUB} + 1 : b.sub * {_SUB} + {_SUB}]', 'bv')} AS part FROM q, b)"
    + _ranked("l2", "rank <= 10", f"SELECT query_id, vid, {_fold('list(part ORDER BY sub)')} AS distance FROM e JOIN t USING (sub, code) GROUP BY query_id, vid")
)
def pq_adc_knn(spark, sf_dir):
    df = rows(spark, sf_dir)
    return pq_knn(df, queries_of(df), _fixed_book(df), 10)


# IVF with the first vectors as centroids


def _fixed_ivf(df: DataFrame, nprobe: int = NPROBE) -> IvfIndex:
    first = np.array([r["vec"] for r in df.filter(F.col("vid") <= NLIST).orderBy("vid").select("vec").collect()], np.float64)
    return IvfIndex(first, "l2", IndexConfig(type="ivf", nlist=NLIST, nprobe=nprobe)).add(df)


_IVF_SQL = (
    f"WITH {V_SQL}, {Q_SQL}, c AS (SELECT vid - 1 AS list_id, vec AS cv FROM v WHERE vid <= {NLIST}), "
    f"a AS (SELECT vid, vec, list_id FROM (SELECT vid, vec, list_id, row_number() OVER (PARTITION BY vid ORDER BY {_distance('l2', 'cv', 'vec')}, list_id) AS n FROM v, c) WHERE n = 1), "
    f"p AS (SELECT query_id, qvec, list_id, n FROM (SELECT query_id, qvec, list_id, row_number() OVER (PARTITION BY query_id ORDER BY {_distance('l2', 'qvec', 'cv')}, list_id) AS n FROM q, c))"
)


@_query(f"{_IVF_SQL} SELECT vid, CAST(list_id AS INTEGER) AS list_id FROM a")
def ivf_assign(spark, sf_dir):
    return _fixed_ivf(rows(spark, sf_dir)).postings.select("vid", "list_id")


@_query(f"{_IVF_SQL} SELECT CAST(list_id AS INTEGER) AS list_id, count(*) AS n FROM a GROUP BY list_id")
def ivf_list_sizes(spark, sf_dir):
    return _fixed_ivf(rows(spark, sf_dir)).list_sizes()


@_query(f"{_IVF_SQL} SELECT query_id, CAST(n AS INTEGER) AS n, CAST(list_id AS INTEGER) AS list_id FROM p WHERE n <= {NPROBE}")
def ivf_probe(spark, sf_dir):
    df = rows(spark, sf_dir)
    index = _fixed_ivf(df)
    q = queries_of(df).orderBy("query_id").collect()
    lists = index.probes(np.array([r["qvec"] for r in q], np.float64))
    return spark.createDataFrame([(r["query_id"], n + 1, int(c)) for r, own in zip(q, lists, strict=True) for n, c in enumerate(own)], "query_id long, n int, list_id int")


def _ivf_knn_sql(nprobe: int, keep: str = "rank <= 10", where: str = "true") -> str:
    return _IVF_SQL + _ranked("l2", keep, f"SELECT * FROM (SELECT query_id, vid, {_distance('l2')} AS distance FROM p JOIN a USING (list_id) WHERE n <= {nprobe}) WHERE {where}")


@_query(_ivf_knn_sql(NPROBE))
def ivf_knn(spark, sf_dir):
    df = rows(spark, sf_dir)
    return _fixed_ivf(df).search(queries_of(df), 10)


@_query(_knn_sql("l2"))
def ivf_full_probe_equals_exact(spark, sf_dir):
    df = rows(spark, sf_dir)
    return _fixed_ivf(df).search(queries_of(df), 10, nprobe=NLIST)


@_query(_ivf_knn_sql(NPROBE, "true", "distance <= 30"))
def ivf_range(spark, sf_dir):
    df = rows(spark, sf_dir)
    return _fixed_ivf(df).range_search(queries_of(df), 30.0)


@_query(_ivf_knn_sql(NPROBE, where="vid % 7 <> 0"))
def ivf_remove(spark, sf_dir):
    df = rows(spark, sf_dir)
    return _fixed_ivf(df).remove(df.filter("vid % 7 = 0")).search(queries_of(df), 10)


# trained indexes and graphs: rows only here, recall in the tests


def _trained(kind: str, metric: str):
    def run(spark, sf_dir):
        df = rows(spark, sf_dir)
        config = IndexConfig(type=kind, nlist=NLIST, nprobe=12, nsub=NSUB, nbits=6, m=16, ef_construction=100, ef_search=200)
        index = IvfIndex.train(df, config, metric).add(df) if kind.startswith("ivf") else HnswIndex.build(df, config, metric)
        return index.search(queries_of(df), 10)

    run.__name__ = f"{kind}_knn_trained"
    _query()(run)


for _kind, _metric in (("ivf", "l2"), ("ivf_sq", "l2"), ("ivf_pq", "cosine"), ("hnsw", "l2"), ("hnsw_sq", "cosine"), ("hnsw_pq", "l2")):
    _trained(_kind, _metric)


@_query()
def hnsw_levels(spark, sf_dir):
    return rows(spark, sf_dir).select(level_column(16).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@_query()
def hnsw_neighbors(spark, sf_dir):
    return HnswIndex.build(rows(spark, sf_dir), IndexConfig(type="hnsw", ef_construction=50)).neighbors(7)


# utilities


@_query(r"SELECT page_id, CAST(len(p) AS INTEGER) AS n, p[3] AS third FROM (SELECT page_id, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS p FROM (SELECT page_id, regexp_split_to_array(url, '[/?=]') AS p FROM pages))")
def str_split_chars(spark, sf_dir):
    parts = X.split_chars(F.col("url"), "/?=")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.size(parts).alias("n"), F.get(parts, F.lit(2)).alias("third"))


@_query("SELECT page_id, trim(replace('  ' || url || ' ', 'http', 'HT')) AS url, upper(url) AS high, instr(url, 'example') - 1 AS place, instr(url, '') * 0 AS none FROM pages")
def str_trim_replace(spark, sf_dir):
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.trim(F.replace(F.concat(F.lit("  "), url, F.lit(" ")), F.lit("http"), F.lit("HT"))).alias("url"), F.upper("url").alias("high"),
        X.find(url, "example").cast("long").alias("place"), X.find(url, "").cast("long").alias("none"),
    )


@_query("SELECT page_id, lower(url) = lower(upper(url)) AS same, CASE WHEN url < 'https' THEN -1 WHEN url > 'https' THEN 1 ELSE 0 END AS sign, CASE WHEN left(url, 4) = 'http' THEN 0 ELSE 1 END AS four FROM pages")
def str_compare(spark, sf_dir):
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.equals_ignore_case(url, F.upper("url")).alias("same"), X.compare(url, F.lit("https")).alias("sign"), X.compare(url, F.lit("http"), 4).alias("four"))


@_query("SELECT page_id, CAST(n AS BIGINT) AS number, CAST(n AS BIGINT) + 0.5::double AS real FROM (SELECT page_id, coalesce(try_cast(regexp_extract(page_id || 'px', '^([0-9]+)', 1) AS BIGINT), 0) AS n FROM pages)")
def str_parse(spark, sf_dir):
    text = F.col("page_id").cast("string")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.parse_integer(F.concat(text, F.lit("px"))).alias("number"), X.parse_double(F.concat(text, F.lit(".5kg"))).alias("real"))


@_query("SELECT event_id, abs(value) AS a, CASE WHEN value > 0 THEN sqrt(value) ELSE 0 END AS r, least(greatest(value, 1), 20) AS c FROM events")
def math_funcs(spark, sf_dir):
    v = F.col("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.abs(v).alias("a"), X.guarded_sqrt(v).alias("r"), X.clamp(v, 1.0, 20.0).alias("c"))


@_query()
def hash_vectors(spark, sf_dir):
    return rows(spark, sf_dir).select("vid", X.hash_bits(F.col("vec")).alias("h"), X.murmur3()(F.col("vid").cast("string")).alias("m"))


@_query()
def vec_random(spark, sf_dir):
    return rows(spark, sf_dir).select("vid", V.fold(V.random_uniform(F.col("vid"), 8)).alias("uniform"), V.fold(V.random_gaussian(F.col("vid"), 8)).alias("gaussian"))
