"""Inverted-file index: raw, scalar-quantized or product-quantized postings.

The index is a table of postings (list_id, vid, vec or code) to be written
partitioned by list_id, and a few centroids. Every row is indexed. A search finds
each query's nearest lists, prunes the postings to the union of those lists, and
scores every row only against the queries that probe its list, in one scan. The
vectors beside product codes rank all rows of the probed lists; codes are scored only
in postings without vectors. Where a query may have many results (a radius, a large
k), queries that probe the same lists meet their rows in one task, which ranks them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.operators import search as S
from vecloom.operators.filters import Filter, matching
from vecloom.operators.kmeans import kmeans, nearest, training_sample
from vecloom.operators.quantize import ProductQuantizer, ScalarQuantizer
from vecloom.plans.config import IndexConfig, IndexType, InvalidParameter


@dataclass
class IvfIndex:
    centroids: np.ndarray
    metric: str
    config: IndexConfig
    quantizer: ScalarQuantizer | ProductQuantizer | None = None
    postings: DataFrame | None = None
    rows: DataFrame | None = None  # the indexed rows, whose metadata filters need

    @classmethod
    def train(cls, rows: DataFrame, config: IndexConfig, metric: str = "l2", centroids: np.ndarray | None = None) -> IvfIndex:
        sample = training_sample(rows)
        if centroids is None:
            centroids = kmeans(sample, config.nlist, metric, config.max_iter, config.tolerance)
        quantizer = None
        if config.type is IndexType.IVF_SQ:
            quantizer = ScalarQuantizer.train(rows)
        elif config.type is IndexType.IVF_PQ:
            quantizer = ProductQuantizer.train(sample, config.nsub, config.nbits, metric)
        return cls(np.asarray(centroids, np.float64), str(getattr(metric, "value", metric)), config, quantizer)

    def assign(self, rows: DataFrame) -> DataFrame:
        """list_id, vid and vec (or code; both for product codes) of every row."""
        centroids, metric, quantizer = self.centroids, self.metric, self.quantizer
        kind = "vec array<float>" if quantizer is None else "code binary, vec array<float>" if isinstance(quantizer, ProductQuantizer) else "code binary"

        def run(batches):
            for batch in batches:
                at, x = S.matrix(batch.column("vec"), centroids.shape[1])
                if not len(at):
                    continue
                lists = pa.array(nearest(metric, x, centroids).astype(np.int32))
                vid = batch.column("vid").take(pa.array(at))
                if quantizer is None:
                    yield pa.RecordBatch.from_arrays([lists, vid, batch.column("vec").take(pa.array(at))], names=["list_id", "vid", "vec"])
                else:
                    codes = [c.tobytes() for c in quantizer.encode(x)]
                    more = {"vec": batch.column("vec").take(pa.array(at))} if isinstance(quantizer, ProductQuantizer) else {}
                    yield pa.RecordBatch.from_arrays([lists, vid, pa.array(codes, pa.binary()), *more.values()], names=["list_id", "vid", "code", *more])

        return rows.select("vid", "vec").filter("vid is not null and vec is not null").mapInArrow(run, f"list_id int, vid long, {kind}")

    def add(self, rows: DataFrame) -> IvfIndex:
        new = self.assign(rows)
        every = rows if self.rows is None else self.rows.unionByName(rows, allowMissingColumns=True)
        return replace(self, postings=new if self.postings is None else self.postings.unionByName(new), rows=every)

    def remove(self, vids: DataFrame) -> IvfIndex:
        return replace(self, postings=self.postings.join(vids.select("vid"), "vid", "left_anti"))

    def list_sizes(self) -> DataFrame:
        return self.postings.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))

    def probes(self, queries: np.ndarray, nprobe: int | None = None) -> np.ndarray:
        """Nearest lists of each query, nearest first."""
        n = min(nprobe or self.config.nprobe, len(self.centroids))
        return np.argsort(distances_to(self.metric, queries, self.centroids), axis=1, kind="stable")[:, :n]

    def _found(self, queries: DataFrame, k: int | None, nprobe: int | None, radius: float | None, where: Filter | Column | None) -> DataFrame:
        """Ranked results: the k nearest, within the radius if there is one; all of them if k is None."""
        if self.postings is None:
            raise InvalidParameter("the index has no postings")
        postings = allowed(self.postings, self.rows, where)
        parts, final = [], True
        for qid, q in S.packed_queries(queries, self.centroids.shape[1]):
            probes = self.probes(q, nprobe)
            if k is not None and k <= S.FEW and len(q) * k <= S.HELD:
                parts.append(self._scanned(postings, qid, q, probes, k, radius))
                final = False
            else:
                parts.append(self._tiled(postings, qid, q, probes, k, radius))
                final = final and len(np.unique(qid)) == len(qid)  # a tile has all results of its queries
        if final:
            return S._scored(reduce(DataFrame.union, parts), self.metric)
        return S._ranked(reduce(DataFrame.union, [x.select("query_id", "vid", "distance") for x in parts]), self.metric, k)

    def _loader(self, postings: DataFrame):
        """The column that distances need, and its blocks' vectors. Codes only where postings of before have no vectors beside them."""
        dim, quantizer = self.centroids.shape[1], self.quantizer
        if "vec" in postings.columns:
            return "vec", lambda data, n: np.frombuffer(data, np.float32).reshape(n, dim)
        return "code", lambda data, n: quantizer.decode(np.frombuffer(data, np.uint8).reshape(n, -1))

    def _scanned(self, postings: DataFrame, qid: np.ndarray, q: np.ndarray, probes: np.ndarray, k: int, radius: float | None) -> DataFrame:
        """Candidates of one block of queries: a partition's rows, list by list, meet the queries that probe their list."""
        by_list = {int(c): np.flatnonzero((probes == c).any(axis=1)) for c in np.unique(probes)}
        metric, (column, load) = self.metric, self._loader(postings)
        postings = postings.filter(F.col("list_id").isin(sorted(by_list))).select("list_id", "vid", column)

        def run(batches):
            held = S.Nearest(metric, q, k, radius)
            for c, ids, data in _lists(batches, column, q.shape[1]):
                held.add(np.frombuffer(ids, np.int64), load(data, len(ids) // 8), by_list[c], c)
            yield held.found(qid)

        return postings.mapInArrow(run, S._FOUND)

    def _tiled(self, postings: DataFrame, qid: np.ndarray, q: np.ndarray, probes: np.ndarray, k: int | None, radius: float | None) -> DataFrame:
        """Ranked results of one block of queries: those that probe the same lists make a tile, and a list's rows are copied to the tiles that probe it."""
        spark, metric, dim = postings.sparkSession, self.metric, q.shape[1]
        S.small_batches(spark)
        tiles = np.array_split(np.lexsort(np.sort(probes, axis=1).T[::-1]), S.tile_count(spark, len(q), k))
        wanted: dict[int, list[int]] = {int(c): [] for c in np.unique(probes)}
        for t, own in enumerate(tiles):
            for c in np.unique(probes[own]):
                wanted[int(c)].append(t)
        column, load = self._loader(postings)

        def pack(batches):
            for c, ids, data in _lists(batches, column, dim):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([ids], pa.binary()), pa.array([data], pa.binary()), pa.array([wanted[c]], pa.list_(pa.int32()))], names=["list", "ids", "data", "tiles"])

        def answer(batches):
            spool, tile = S.Spool(load), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    tile = batch.column("tile")[i].as_py()
                    spool.add(batch.column("list")[i].as_py(), batch.column("ids")[i].as_buffer(), batch.column("data")[i].as_buffer())
            if spool.ids:
                own = tiles[tile]
                yield from S.answered(metric, qid[own], q[own], spool, k, radius, probes[own])
            spool.close()

        blocks = postings.filter(F.col("list_id").isin(sorted(wanted))).select("list_id", "vid", column).mapInArrow(pack, f"{S._BLOCK}, tiles array<int>")
        dealt = blocks.select("list", "ids", "data", F.explode("tiles").alias("tile")).repartitionById(len(tiles), F.col("tile"))
        return dealt.mapInArrow(answer, f"{S._FOUND}, rank int")

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, where: Filter | Column | None = None) -> DataFrame:
        return self._found(queries, k, nprobe, None, where) if k > 0 else self._none()

    def range_search(self, queries: DataFrame, radius: float, capacity: int | None = None, nprobe: int | None = None) -> DataFrame:
        return self._found(queries, capacity, nprobe, radius, None) if radius >= 0 and (capacity is None or capacity > 0) else self._none()

    def _none(self) -> DataFrame:
        if self.postings is None:
            raise InvalidParameter("the index has no postings")
        return self.postings.sparkSession.createDataFrame([], "query_id long, rank int, vid long, distance double, score double")


def _lists(batches, column: str, dim: int):
    """List, ids and vectors (or codes) of blocks of one list each; small ones wait for more rows of their list."""
    kept: dict[int, list[tuple[bytes, bytes]]] = {}
    count: dict[int, int] = {}

    def block(c: int):
        own = kept.pop(c)
        count.pop(c)
        return c, b"".join(i for i, _ in own), b"".join(d for _, d in own)

    for batch in batches:
        vid, lists = batch.column("vid").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("list_id").to_numpy()
        if column == "vec":
            at, x = S.matrix(batch.column("vec"), dim)
        else:
            at, x = np.arange(len(vid)), np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(vid), -1) if len(vid) else None
        for c in np.unique(lists[at]).tolist():
            rows = np.flatnonzero(lists[at] == c)
            for a in range(0, len(rows), S.PACKED):
                some = rows[a : a + S.PACKED]
                kept.setdefault(c, []).append((vid[at[some]].tobytes(), x[some].tobytes()))
                count[c] = count.get(c, 0) + len(some)
                if count[c] >= S.PACKED:
                    yield block(c)
        if sum(count.values()) >= 16 * S.PACKED:
            yield from [block(c) for c in list(kept)]
    yield from [block(c) for c in list(kept)]


def pq_knn(rows: DataFrame, queries: DataFrame, quantizer: ProductQuantizer, k: int = 10) -> DataFrame:
    """Exact scan of product codes: each distance is a sum over the query's lookup table. Squared L2, or negative product for IP."""
    dim = quantizer.books.shape[0] * quantizer.books.shape[2]
    rows = rows.select("vid", "vec").filter("vid is not null and vec is not null")
    found = [rows.mapInArrow(_coded_scan(quantizer, dim, qid, q, k), S._FOUND) for qid, q in S.packed_queries(queries, dim)]
    return S._ranked(reduce(DataFrame.union, found), "ip" if quantizer.metric == "ip" else "l2", k)


def _coded_scan(quantizer: ProductQuantizer, dim: int, qid: np.ndarray, q: np.ndarray, k: int):
    def run(batches):
        tables = None
        for batch in batches:
            at, x = S.matrix(batch.column("vec"), dim)
            if not len(at):
                continue
            tables = tables or [quantizer.table(v) for v in q.astype(np.float64)]
            codes, vid = quantizer.encode(x), batch.column("vid").to_numpy(zero_copy_only=False)[at]
            ids, vids, ds = [], [], []
            for i, table in enumerate(tables):
                d = np.zeros(len(at))
                for s, own in enumerate(table):
                    d = d + own[codes[:, s]]
                best = S._best(d, vid, k)
                ids.append(np.full(len(best), qid[i]))
                vids.append(vid[best])
                ds.append(d[best])
            yield S._emit(ids, vids, ds)

    return run


def allowed(postings: DataFrame, rows: DataFrame | None, where: Filter | Column | None) -> DataFrame:
    """The postings whose row matches a filter on the indexed rows' columns."""
    if where is None:
        return postings
    if rows is None:
        raise InvalidParameter("a filtered search needs the indexed rows")
    return postings.join(matching(rows, where).select("vid").hint("merge"), "vid", "left_semi")


def distances_to(metric: str, queries: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return S.distances(metric, queries, centroids)
