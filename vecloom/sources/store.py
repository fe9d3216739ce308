"""Databases of named collections on Parquet.

A collection is a folder with immutable versions of its rows and one manifest that
points at the current version; readers see one version throughout. Every mutation
writes a new version and then moves the pointer, unless another writer moved it since
it was read (Conflict); in a transaction the pointers move together at commit. Metadata columns are persisted with the vectors, and an index is
a set of tables beside them that belongs to one version: after a mutation searches
are exact until the index is rebuilt.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom import __version__
from vecloom.operators import mutations as M
from vecloom.operators import search as S
from vecloom.operators.aggregates import collection_stats
from vecloom.operators.filters import Filter
from vecloom.operators.hnsw import HnswIndex
from vecloom.operators.ivf import IvfIndex
from vecloom.operators.quantize import ProductQuantizer, ScalarQuantizer
from vecloom.plans.config import (
    AlreadyExists,
    CollectionConfig,
    Conflict,
    IndexConfig,
    IndexType,
    InvalidParameter,
    Metric,
    NotFound,
    NotSupported,
    access_path,
)
from vecloom.sources.files import Files

_IVF = (IndexType.IVF, IndexType.IVF_SQ, IndexType.IVF_PQ)


class Collection:
    def __init__(self, database: Database, name: str):
        self.database, self.name = database, name
        self.spark, self.files = database.spark, database.files
        self.path = f"{database.path}/{name}"
        self.manifest = self._stored_manifest()
        self._base = json.dumps(self.manifest)
        self.config = CollectionConfig(**self.manifest["config"])
        self._index = None

    # state

    def _stored_manifest(self) -> dict:
        return json.loads(self.files.read_text(f"{self.path}/manifest.json"))

    def _writable(self) -> None:
        """Raises for a read-only database, and if another writer moved the pointer since this object read it."""
        self.database.writable()
        if json.dumps(self._stored_manifest()) != self._base:
            raise Conflict(f"{self.name} was changed by another writer; refresh it")

    def refresh(self) -> None:
        """The current version as other writers left it."""
        self.manifest, self._index = self._stored_manifest(), None
        self._base = json.dumps(self.manifest)

    def _save(self, **changes) -> None:
        self._writable()
        self.manifest |= changes
        if self.database.in_transaction():
            self.database._touched.add(self.name)
        else:
            self._publish()

    def _publish(self) -> None:
        self._base = json.dumps(self.manifest)
        self.files.write_text(f"{self.path}/manifest.json", self._base)

    def rows(self) -> DataFrame:
        """vid, vec and metadata columns of the current version."""
        return self.spark.read.parquet(f"{self.path}/{self.manifest['version']}")

    def _write(self, rows: DataFrame, next_vid: int | None = None) -> None:
        self._writable()
        version = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        self._index = None
        self._save(version=version, next_vid=next_vid or self.manifest["next_vid"], index=None)

    def count(self) -> int:
        return self.rows().count()

    def stats(self) -> dict:
        return collection_stats(self.rows()).first().asDict() | {"dim": self.config.dim, "metric": self.config.metric.value, "next_vid": self.manifest["next_vid"], "indexed": self.has_index()}

    # mutations

    def _frame(self, vectors, meta: list[dict] | None) -> DataFrame:
        """New rows from a DataFrame (vec and metadata) or from driver-side lists; dimensions are checked."""
        if isinstance(vectors, DataFrame):
            bad = vectors.filter(F.col("vec").isNull() | (F.size("vec") != self.config.dim) | F.exists("vec", lambda x: x.isNull()))
            if not bad.isEmpty():
                raise InvalidParameter(f"vectors must have {self.config.dim} elements")
            return vectors.withColumn("vec", F.col("vec").cast("array<float>"))
        vectors = [[float(x) for x in v] for v in vectors]
        if any(len(v) != self.config.dim for v in vectors):
            raise InvalidParameter(f"vectors must have {self.config.dim} elements")
        fields = [T.StructField("vec", T.ArrayType(T.FloatType()))]
        keys = sorted({k for m in meta or [] for k in m})
        known = {f.name: f.dataType for f in self.rows().schema}
        for k in keys:
            value = next(m[k] for m in meta if m.get(k) is not None)
            fields.append(T.StructField(k, known.get(k) or {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(value), T.StringType())))
        rows = [(v, *[(meta[i] or {}).get(k) for k in keys]) for i, v in enumerate(vectors)]
        return self.spark.createDataFrame(rows, T.StructType(fields)).coalesce(1)

    def insert(self, vector, meta: dict | None = None) -> int:
        return self.insert_batch([vector], [meta] if meta else None)[0]

    def insert_batch(self, vectors, meta: list[dict] | None = None, order: list[str] | None = None) -> range:
        """Appends rows under new vids, all or none; a DataFrame is numbered in the given column order."""
        if isinstance(vectors, DataFrame):
            if not order:
                raise InvalidParameter("name the columns that order the new rows")
            new, n = self._frame(vectors, None), vectors.count()
        else:
            if not len(vectors):
                raise InvalidParameter("nothing to insert")
            new, n = self._frame(vectors, meta).withColumn("__i", F.monotonically_increasing_id()), len(vectors)
            order = ["__i"]
        first = self.manifest["next_vid"]
        if first + n - 1 > self.config.max_vid:
            raise InvalidParameter(f"vids end at {self.config.max_vid}")
        joined = M.insert(self.rows(), new, first, order)
        self._write(joined.drop("__i"), first + n)
        return range(first, first + n)

    def upsert(self, vid: int, vector, meta: dict | None = None) -> None:
        frame = self._frame([vector], [meta] if meta else None)
        self.upsert_batch(frame.withColumn("vid", F.lit(vid).cast("long")))

    update = upsert

    def upsert_batch(self, new: DataFrame) -> None:
        """Rows (vid, vec, metadata) replace or join those stored; of a vid given twice, the larger vector counts."""
        ends = new.agg(F.min("vid").alias("a"), F.max("vid").alias("b"), F.count(F.when(F.col("vid").isNull(), 1)).alias("n")).first()
        if ends["n"] or ends["a"] is None or ends["a"] < 1 or ends["b"] > self.config.max_vid:
            raise InvalidParameter(f"vids run from 1 to {self.config.max_vid}")
        names = [c for c in new.columns if c != "vid"]
        single = self._frame(new, None).groupBy("vid").agg(F.max(F.struct("vec", *[c for c in names if c != "vec"])).alias("r")).select("vid", *[F.col(f"r.{c}").alias(c) for c in names])
        rows = self.rows()
        for c in names:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(single.schema[c].dataType))
        self._write(M.upsert(rows, single), max(self.manifest["next_vid"], ends["b"] + 1))

    def delete(self, vid: int) -> None:
        if M.get(self.rows(), vid).isEmpty():
            raise NotFound(vid)
        self.delete_batch([vid])

    def delete_batch(self, vids) -> int:
        """Rows gone; missing vids don't matter."""
        ids = vids if isinstance(vids, DataFrame) else self.spark.createDataFrame([(int(v),) for v in vids], "vid long")
        before = self.count()
        self._write(M.delete(self.rows(), ids))
        return before - self.count()

    def delete_by_filter(self, where: Filter | Column | None) -> int:
        before = self.count()
        self._write(M.delete_by_filter(self.rows(), where))
        return before - self.count()

    def clear(self) -> None:
        """No rows, vids from 1; the configured index type stays."""
        self._write(self.rows().limit(0), 1)

    def set_meta(self, vid: int, meta: dict) -> None:
        if M.get(self.rows(), vid).isEmpty():
            raise NotFound(vid)
        rows = self.rows()
        fresh = self._frame([[0.0] * self.config.dim], [meta]).drop("vec").withColumn("vid", F.lit(vid).cast("long"))
        for c in fresh.columns:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(fresh.schema[c].dataType))
        self._write(M.set_meta(rows, fresh))

    def delete_meta_field(self, name: str) -> None:
        self._write(M.delete_meta_field(self.rows(), name))

    # point access

    def get_record(self, vid: int) -> Row:
        row = M.get(self.rows(), vid).first()
        if row is None:
            raise NotFound(vid)
        return row

    def get(self, vid: int) -> list[float]:
        return list(self.get_record(vid)["vec"])

    def get_meta(self, vid: int) -> dict:
        return {k: v for k, v in self.get_record(vid).asDict().items() if k not in ("vid", "vec") and v is not None}

    def get_batch(self, vids: list[int]) -> DataFrame:
        return M.get_batch(self.rows(), self.spark.createDataFrame(list(enumerate(vids)), "pos int, vid long"))

    def iterate(self, where: Filter | Column | None = None) -> Iterator[Row]:
        return M.iterate(self.rows(), where)

    def foreach(self, visit: Callable[[Row], bool | None], where: Filter | Column | None = None) -> int:
        return M.foreach(self.rows(), visit, where)

    # search

    def _queries(self, queries) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries
        if any(len(q) != self.config.dim for q in queries):
            raise InvalidParameter(f"queries must have {self.config.dim} elements")
        return S.query_frame(self.spark, queries)

    def search_batch(self, queries, k: int = 10, where: Filter | Column | None = None, include: tuple[str, ...] = (), nprobe: int | None = None, ef_search: int | None = None) -> DataFrame:
        """query_id, rank, vid, distance, score (and the columns of include)."""
        q, metric = self._queries(queries), self.config.metric.value
        rows = self.rows()
        index = self._load_index() if k > 0 else None
        if index is None:
            return S.knn(rows, q, k, metric, where, include)
        found = index.search(q, k, nprobe, where) if isinstance(index, IvfIndex) else index.search(q, k, ef_search, where)
        found = self._topped_up(found, q, rows, k, metric, where)
        return found.join(rows.select("vid", *include), "vid").select(*found.columns, *include) if include else found

    def _topped_up(self, found: DataFrame, queries: DataFrame, rows: DataFrame, k: int, metric: str, where: Filter | Column | None) -> DataFrame:
        """Queries that the index gave fewer than k rows are answered exactly."""
        short = queries.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k), "query_id", "left_anti")
        if short.isEmpty():
            return found
        exact = S.knn(rows, short, k, metric, where)
        return found.join(short.select("query_id"), "query_id", "left_anti").select(*exact.columns).unionByName(exact)

    def search(self, query, k: int = 10, **options) -> DataFrame:
        return self.search_batch([query], k, **options).drop("query_id").orderBy("rank")

    def search_filtered(self, query, where: Filter | Column, k: int = 10, **options) -> DataFrame:
        return self.search(query, k, where=where, **options)

    def search_by_id(self, vid: int, k: int = 10, where: Filter | Column | None = None) -> DataFrame:
        return S.knn_by_id(self.rows(), vid, k, self.config.metric.value, where)

    def range_search(self, queries, radius: float, capacity: int | None = None, where: Filter | Column | None = None) -> DataFrame:
        return S.range_search(self.rows(), self._queries(queries), radius, self.config.metric.value, capacity, where)

    # index

    def build_index(self, config: IndexConfig | None = None) -> None:
        """Trains and stores the index of the current version; an empty collection or a second index is refused."""
        if self.manifest.get("index"):
            raise AlreadyExists("drop or rebuild the index")
        config = config or self.config.index
        rows, n = self.rows(), self.count()
        if not n:
            raise InvalidParameter("the collection is empty")
        kind = access_path(config, n, True)
        if kind is IndexType.FLAT:
            return
        name = f"index-{uuid.uuid4().hex}"
        if kind in _IVF:
            used = IndexConfig(**(vars(config) | {"type": kind}))
            index = IvfIndex.train(rows, used, self.config.metric.value)
            index.assign(rows).repartition("list_id").write.partitionBy("list_id").parquet(f"{self.path}/{name}")
            state = {"centroids": index.centroids.tolist(), "config": used.to_dict()}
        else:
            index = HnswIndex.build(rows, config, self.config.metric.value)
            index.graph.write.parquet(f"{self.path}/{name}")
            state = {"dim": index.dim, "config": config.to_dict()}
        state |= {"metric": index.metric, "quantizer": _quantizer_state(index.quantizer)}
        self._save(index={"folder": name, "kind": kind.value, "state": state})

    def rebuild_index(self, config: IndexConfig | None = None) -> None:
        self.drop_index()
        self.build_index(config)

    update_index = rebuild_index

    def drop_index(self) -> None:
        self._index = None
        self._save(index=None)

    def has_index(self) -> bool:
        return bool(self.manifest.get("index"))

    def _load_index(self) -> IvfIndex | HnswIndex | None:
        entry = self.manifest.get("index")
        if entry and self._index is None:
            state, table = entry["state"], self.spark.read.parquet(f"{self.path}/{entry['folder']}")
            config, quantizer = IndexConfig(**state["config"]), _quantizer(state["quantizer"])
            if IndexType(entry["kind"]) in _IVF:
                self._index = IvfIndex(np.array(state["centroids"], np.float64), state["metric"], config, quantizer, table, self.rows())
            else:
                self._index = HnswIndex(table, state["metric"], config, state["dim"], quantizer, self.rows())
        return self._index if entry else None

    # maintenance

    def verify(self) -> list[str]:
        """Broken invariants: dimensions, vids, repeated vids, index rows."""
        rows, out = self.rows(), []
        bad = rows.agg(
            F.count(F.when(F.col("vec").isNull() | (F.size("vec") != self.config.dim), 1)).alias("dim"),
            F.count(F.when(F.col("vid").isNull() | (F.col("vid") < 1) | (F.col("vid") >= self.manifest["next_vid"]), 1)).alias("vid"),
            (F.count("vid") - F.count_distinct("vid")).alias("repeated"),
        ).first()
        out += [f"{k}: {n} rows" for k, n in bad.asDict().items() if n]
        index = self._load_index()
        if index is not None and (index.postings if isinstance(index, IvfIndex) else index.graph).count() != rows.count():
            out.append("index: other rows than the collection")
        return out

    def vacuum(self, files: int | None = None) -> None:
        """Rewrites the rows into fewer files and deletes versions and indexes that nothing points at."""
        rows = self.rows()
        entry = self.manifest.get("index")
        self._write(rows.coalesce(files or max(1, rows.rdd.getNumPartitions() // 2)))
        self._save(index=entry)
        used = {"manifest.json", self.manifest["version"], (entry or {}).get("folder")}
        for name in self.files.list(self.path):
            if name not in used:
                self.files.delete(f"{self.path}/{name}")


def _quantizer_state(quantizer: ScalarQuantizer | ProductQuantizer | None) -> dict | None:
    if quantizer is None:
        return None
    if isinstance(quantizer, ScalarQuantizer):
        return {"low": quantizer.low.tolist(), "high": quantizer.high.tolist()}
    return {"books": quantizer.books.tolist(), "metric": quantizer.metric}


def _quantizer(state: dict | None) -> ScalarQuantizer | ProductQuantizer | None:
    if state is None:
        return None
    if "low" in state:
        return ScalarQuantizer(np.array(state["low"], np.float64), np.array(state["high"], np.float64))
    return ProductQuantizer(np.array(state["books"], np.float64), state["metric"])


class Database:
    def __init__(self, spark: SparkSession, path: str, create: bool = True, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.files = Files(spark)
        if not self.files.exists(self.path):
            if not create or read_only:
                raise NotFound(path)
            self.files.make(self.path)
        self._open: dict[str, Collection] = {}
        self._open_transaction = False
        self._touched: set[str] = set()
        self._made: set[str] = set()
        self.closed = False

    version = __version__

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        if self.in_transaction():
            self.rollback()
        self._open.clear()
        self.closed = True

    def is_open(self) -> bool:
        return not self.closed

    def sync(self) -> None:
        """Every mutation is on storage already."""

    def writable(self) -> None:
        if self.read_only:
            raise NotSupported("the database is open for reading only")
        if self.closed:
            raise NotSupported("the database is closed")

    def create_collection(self, name: str, dim: int, metric: Metric | str = Metric.L2, index: IndexConfig | None = None) -> Collection:
        """A new, empty collection; made in a transaction, it goes with a rollback."""
        self.writable()
        if self.has_collection(name):
            raise AlreadyExists(name)
        config = CollectionConfig(name, dim, Metric(metric), index or IndexConfig())
        folder = f"{self.path}/{name}"
        self.spark.createDataFrame([], "vid long, vec array<float>").write.mode("overwrite").parquet(f"{folder}/rows-0")
        self.files.write_text(f"{folder}/manifest.json", json.dumps({"config": json.loads(config.to_json()), "version": "rows-0", "next_vid": 1, "index": None}))
        if self.in_transaction():
            self._made.add(name)
        return self.collection(name)

    def collection(self, name: str) -> Collection:
        if not self.has_collection(name):
            raise NotFound(name)
        if name not in self._open:
            self._open[name] = Collection(self, name)
        return self._open[name]

    def has_collection(self, name: str) -> bool:
        return self.files.has_text(f"{self.path}/{name}/manifest.json")

    def list_collections(self) -> list[str]:
        return [n for n in self.files.list(self.path) if self.has_collection(n)]

    def _outside_transactions(self) -> None:
        self.writable()
        if self.in_transaction():
            raise NotSupported("collections are dropped and renamed outside transactions")

    def drop_collection(self, name: str) -> None:
        self._outside_transactions()
        if not self.has_collection(name):
            raise NotFound(name)
        self._open.pop(name, None)
        self.files.delete(f"{self.path}/{name}")

    def rename_collection(self, old: str, new: str) -> None:
        self._outside_transactions()
        if not self.has_collection(old):
            raise NotFound(old)
        if self.has_collection(new):
            raise AlreadyExists(new)
        self._open.pop(old, None)
        self.files.rename(f"{self.path}/{old}", f"{self.path}/{new}")
        place = f"{self.path}/{new}/manifest.json"
        manifest = json.loads(self.files.read_text(place))
        manifest["config"]["name"] = new
        self.files.write_text(place, json.dumps(manifest))

    def insert(self, name: str, vector, meta: dict | None = None) -> int:
        return self.collection(name).insert(vector, meta)

    def insert_batch(self, name: str, vectors, meta: list[dict] | None = None) -> range:
        return self.collection(name).insert_batch(vectors, meta)

    def search(self, name: str, query, k: int = 10, **options) -> DataFrame:
        return self.collection(name).search(query, k, **options)

    def register_views(self) -> None:
        """Every collection as a temporary view of its name."""
        for name in self.list_collections():
            self.collection(name).rows().createOrReplaceTempView(name)

    def stats(self) -> dict:
        return {name: self.collection(name).stats() for name in self.list_collections()}

    # transactions: pointers move together

    def in_transaction(self) -> bool:
        return self._open_transaction

    def begin(self) -> None:
        if self.in_transaction():
            raise AlreadyExists("a transaction is open")
        self.writable()
        for name in self.list_collections():
            self.collection(name).refresh()
        self._open_transaction, self._touched, self._made = True, set(), set()

    def commit(self) -> None:
        """Moves the pointers of all changed collections; if another writer moved one, none moves and it rolls back."""
        if not self.in_transaction():
            raise NotFound("no transaction is open")
        try:
            for name in sorted(self._touched):
                self._open[name]._writable()
        except Conflict:
            self.rollback()
            raise
        self._open_transaction = False
        for name in sorted(self._touched):
            self._open[name]._publish()

    def rollback(self) -> None:
        """Changed collections go back to what is stored; those made in the transaction go."""
        if not self.in_transaction():
            raise NotFound("no transaction is open")
        self._open_transaction = False
        for name in self._made:
            self.drop_collection(name)
        for name in self._touched - self._made:
            self._open[name].refresh()

    # copies and exchange

    def backup(self, to: str) -> None:
        self.files.copy(self.path, to)

    @classmethod
    def restore(cls, spark: SparkSession, backup: str, to: str) -> Database:
        Files(spark).copy(backup, to)
        return cls(spark, to)

    def export(self, name: str, to: str, form: str = "parquet") -> None:
        """parquet, json, or csv (vectors as JSON arrays)."""
        rows = self.collection(name).rows()
        if form == "csv":
            rows.withColumn("vec", F.to_json("vec")).write.option("header", True).csv(to)
        elif form in ("json", "parquet"):
            getattr(rows.write, form)(to)
        else:
            raise InvalidParameter(form)

    def import_rows(self, name: str, path: str, form: str = "parquet", schema: str | None = None) -> None:
        """Upserts exported rows (vid, vec, metadata)."""
        if form == "csv":
            reader = self.spark.read.option("header", True)
            rows = reader.schema(schema or "vid long, vec string").csv(path).withColumn("vec", F.from_json("vec", "array<float>"))
        elif form == "json":
            rows = self.spark.read.schema(schema or "vid long, vec array<float>").json(path)
        elif form == "parquet":
            rows = self.spark.read.parquet(path)
        else:
            raise InvalidParameter(form)
        self.collection(name).upsert_batch(rows)


def open_database(spark: SparkSession, path: str, create: bool = True, read_only: bool = False) -> Database:
    return Database(spark, path, create, read_only)

