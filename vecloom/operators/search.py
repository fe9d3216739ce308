"""Exact nearest neighbours: top-k, by id, filtered, and range search.

Vectors are scanned once, where they lie: each partition scores its rows against
the packed queries in numpy and keeps k candidates a query, and a window over those
gives the final ranks. Distances are summed element by element from the left in
double precision, which is bit for bit what the Catalyst expressions compute; lower
bounds from a matrix product choose the pairs that are worth it.

Queries ride along with the tasks while they fit QUERY_BYTES, which is counted
first. Beyond that, and where a query may have many results (large k, a radius),
queries are cut into tiles and packed blocks of vectors are copied to each tile. A
task holds a tile, reads its blocks from a spool and ranks the results itself, so
neither side is broadcast and no result is shuffled.

Rows come back as query_id, rank (from 1), vid, distance (ascending) and score
(index convention). Ties go to the smaller vid. k below 1 gives no rows; null
vectors and vectors of another length take no part.
"""

from __future__ import annotations

import math
import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators.filters import Filter, matching

#: Bytes of packed queries that may be sent with the tasks, and query rows of a tile beyond that.
QUERY_BYTES = 32 << 20
TILE_ROWS = 4096
#: Candidates by product codes that are ranked again by their vectors: at least WIDE, and WIDER for each result.
WIDE, WIDER = 600, 60
#: Scores held at once in a block of numpy work.
BLOCK_SCORES = 1 << 20
#: Sums of a block that stays in a core's cache.
CACHED = 1 << 14
#: More results a query than FEW are gathered whole; results and scores held at once; rows of a packed block.
FEW, HELD, PACKED = 256, 1 << 22, 4096
#: Bytes of packed blocks that go to a worker at once.
BATCH = 16 << 20


def _folded(metric: str, q, x) -> np.ndarray:
    """Sums over the elements, from the left; q and x give one array an element, of shapes that broadcast."""
    out = None
    for a, b in zip(q, x, strict=True):
        if metric == "l2":
            d = a - b
            d *= d
        elif metric == "l1":
            d = np.abs(a - b)
        elif metric == "hamming":
            d = (a != b).astype(np.float64)
        else:
            d = a * b
        if out is None:
            out = np.zeros(d.shape)
        out += d
    return out


def _finished(metric: str, out: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances from the sums; a and b are the vectors' norms (cosine only)."""
    if metric == "ip":
        return -out
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            near = 1.0 - out / (a * b)
        return np.where((a < V.EPSILON) | (b < V.EPSILON), 1.0, near)
    return out


def _norms(columns: np.ndarray) -> np.ndarray:
    return np.sqrt(_folded("ip", columns, columns)) if len(columns) else np.zeros(columns.shape[1])


def distances(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All distances, one row a query; sums run over the elements from the left, in blocks that stay in a core's cache."""
    out = np.zeros((len(queries), len(rows)))
    columns, wanted = np.ascontiguousarray(rows.T, np.float64), np.ascontiguousarray(queries.T, np.float64)
    if len(columns):
        width = min(max(1, len(rows)), CACHED)
        height = max(1, CACHED // width)
        for i in range(0, len(queries), height):
            for j in range(0, len(rows), width):
                out[i : i + height, j : j + width] = _folded(metric, wanted[:, i : i + height, None], columns[:, None, j : j + width])
    a, b = (_norms(wanted), _norms(columns)) if metric == "cosine" else (np.zeros(0), np.zeros(0))
    return _finished(metric, out, a[:, None], b[None, :])


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and vectors of the rows that have `dim` elements, none of them null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32)
    ends = np.cumsum(np.maximum(size, 0))
    ok = size == dim
    if flat.null_count:
        gaps = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
        ok &= gaps[ends] == gaps[ends - np.maximum(size, 0)]
    at = np.flatnonzero(ok)
    return at, values[(ends[at] - dim)[:, None] + np.arange(dim)]


def _best(d: np.ndarray, vid: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances, ties to the smaller vid; NaN is the largest."""
    at = np.arange(len(d))
    if len(d) > k:
        cut = np.partition(d, k - 1)[k - 1]
        if not np.isnan(cut):
            at = np.flatnonzero(d <= cut)
    return at[np.lexsort((vid[at], d[at]))[:k]]


def _emit(ids, vids, ds):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, vids, ds)], names=["query_id", "vid", "distance"])


class _Bounds:
    """Lower bounds of the distances from a set of queries, by one matrix product a block.

    A product in single precision (double, if numbers are large) is off by less than the slack, so a distance is never below
    its bound. NaN stands for "not known". Metrics without a product give the distances.
    """

    def __init__(self, metric: str, queries: np.ndarray):
        self.metric, self.q = metric, np.asarray(queries, np.float64)
        self.square = np.einsum("ij,ij->i", self.q, self.q)
        self.made: dict[type, np.ndarray] = {}

    def of(self, own: np.ndarray | slice, rows: np.ndarray) -> np.ndarray:
        if self.metric not in ("l2", "ip", "cosine"):
            return distances(self.metric, self.q[own], rows)
        x = np.asarray(rows, np.float64)
        square = np.einsum("ij,ij->i", x, x)
        kind = np.float32 if self.metric == "cosine" or max(self.square.max(initial=0), square.max(initial=0)) < 1e15 else np.float64
        slack = 4 * (x.shape[1] + 8) * float(np.finfo(kind).eps)
        with np.errstate(all="ignore"):
            if kind not in self.made:
                self.made[kind] = self._sides(self.q, self.square, slack, True).astype(kind)
            return self.made[kind][own] @ self._sides(x, square, slack, False).astype(kind).T

    def _sides(self, x: np.ndarray, square: np.ndarray, slack: float, left: bool) -> np.ndarray:
        one = np.ones((len(x), 1))
        if self.metric == "cosine":
            norm = np.sqrt(square)
            unit = x / np.where(norm < 2 * V.EPSILON, np.nan, norm)[:, None]
            return np.hstack((-unit, one * (1 - slack))) if left else np.hstack((unit, one))
        if self.metric == "ip":
            return np.hstack((-x, one * -slack / 2, (-slack / 2 * square - 1e-36)[:, None])) if left else np.hstack((x, square[:, None], one))
        return np.hstack((-2 * x, one * (1 - slack), ((1 - slack) * square - 1e-36)[:, None])) if left else np.hstack((x, square[:, None], one))


class Nearest:
    """The k nearest rows (within a radius) of each of a set of queries, met block by block.

    Bounds choose the pairs whose distance is computed, so results are those of all distances.
    """

    def __init__(self, metric: str, queries: np.ndarray, k: int, radius: float | None = None):
        self.metric, self.k, self.radius = metric, k, radius
        self.q = np.asarray(queries, np.float64)
        self.columns = np.ascontiguousarray(self.q.T)
        self.norms = _norms(self.columns) if metric == "cosine" else np.zeros(len(self.q))
        self.bounds = _Bounds(metric, self.q)
        self.d = np.full((len(self.q), k), np.nan)
        self.vid = np.full((len(self.q), k), np.iinfo(np.int64).max)
        self.n = np.zeros(len(self.q), np.int64)
        self.seen: dict[int, int] = {}

    def add(self, vid: np.ndarray, x: np.ndarray, own: np.ndarray | None = None, key: int = 0) -> None:
        """Rows for all queries, or for some (places); key names the rows' list."""
        own = np.arange(len(self.q)) if own is None else own
        a = 0
        while a < len(x):  # early blocks are small, as they have no good limits yet
            b = min(len(x), a + min(max(3 * self.seen.get(key, 0), 256), PACKED))
            step = max(1, 2 * BLOCK_SCORES // (b - a))
            for i in range(0, len(own), step):
                self._block(vid[a:b], x[a:b], own[i : i + step])
            self.seen[key] = self.seen.get(key, 0) + b - a
            a = b

    def _block(self, vid: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
        limit = self.d[own, -1]  # NaN until k are held
        if self.radius is not None:
            limit = np.fmin(limit, self.radius)
        low = self.bounds.of(slice(own[0], own[-1] + 1) if own[-1] - own[0] + 1 == len(own) else own, x)
        # rounded up, as bounds may be in single precision
        at = np.flatnonzero(~(low > np.nextafter(limit.astype(low.dtype), low.dtype.type(np.inf))[:, None]))
        if len(at) > low.size / 4:
            d = distances(self.metric, self.q[own], x)
            keep = np.ones(d.shape, bool)
            if x.shape[0] > self.k:
                keep = ~(d > np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k])
            at = np.flatnonzero(keep)
            d = d.ravel()[at]
        else:
            columns = np.ascontiguousarray(x.T, np.float64)
            norms = _norms(columns) if self.metric == "cosine" else np.zeros(len(x))
            d = np.empty(len(at))
            for a in range(0, len(at), CACHED):
                i, j = np.divmod(at[a : a + CACHED], len(x))
                sums = _folded(self.metric, (c[own[i]] for c in self.columns), (c[j] for c in columns)) if len(columns) else np.zeros(len(i))
                d[a : a + CACHED] = _finished(self.metric, sums, self.norms[own[i]], norms[j])
        i, j = np.divmod(at, len(x))
        good = ~(d > limit[i])
        if self.radius is not None:
            good &= d <= self.radius
        self._merge(own[i[good]], d[good], vid[j[good]])

    def _merge(self, i: np.ndarray, d: np.ndarray, vid: np.ndarray) -> None:
        if not len(i):
            return
        touched, count = np.unique(i, return_counts=True)
        who = np.concatenate((np.repeat(touched, self.k), i))
        d, vid = np.concatenate((self.d[touched].ravel(), d)), np.concatenate((self.vid[touched].ravel(), vid))
        order = np.lexsort((vid, d, who))  # empty places are NaN with the largest vid
        first = np.cumsum(count + self.k) - count - self.k
        best = order[(first[:, None] + np.arange(self.k))]
        self.d[touched], self.vid[touched] = d[best], vid[best]
        self.n[touched] = np.minimum(self.n[touched] + count, self.k)

    def found(self, qid: np.ndarray) -> pa.RecordBatch:
        full = np.arange(self.k) < self.n[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, self.n)), pa.array(self.vid[full]), pa.array(self.d[full])], names=["query_id", "vid", "distance"])


def _scan(metric: str, qid: np.ndarray, q: np.ndarray, k: int, radius: float | None):
    def run(batches):
        held = Nearest(metric, q, k, radius)
        for batch in batches:
            at, x = matrix(batch.column("vec"), q.shape[1])
            held.add(batch.column("vid").to_numpy(zero_copy_only=False)[at], x)
        yield held.found(qid)

    return run


_FOUND = "query_id long, vid long, distance double"


def query_frame(spark: SparkSession, vectors: list[list[float]] | np.ndarray, first_id: int = 0) -> DataFrame:
    """Queries (query_id, qvec) from driver-side vectors."""
    return spark.createDataFrame([(first_id + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, qvec array<float>")


def packed_queries(queries: DataFrame, dim: int):
    """Query ids and vectors, in blocks of at most about QUERY_BYTES dealt by a hash of the id."""
    table = queries.select("query_id", "qvec").filter("qvec is not null and query_id is not null")
    n = max(1, math.ceil(8 * table.count() * (dim + 1) / QUERY_BYTES))
    for i in range(n):
        block = table if n == 1 else table.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        packed = block.toArrow()
        at, q = matrix(packed.column("qvec"), dim)
        yield packed.column("query_id").to_numpy()[at], q


def _searched(rows: DataFrame, queries: DataFrame, k: int | None, metric: str, radius: float | None) -> DataFrame:
    """Ranked results: the k nearest, within the radius if there is one; all of them if k is None."""
    rows = rows.select("vid", "vec").filter("vec is not null and vid is not null")
    queries = queries.select("query_id", "qvec").filter("qvec is not null and query_id is not null")
    sizes = queries.groupBy(F.size("qvec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    parts = []
    for dim, n in sizes:
        own = queries.filter(F.size("qvec") == dim)
        if k is not None and k <= FEW and n * k <= HELD and 8 * n * (dim + 1) <= QUERY_BYTES:
            table = own.toArrow()
            at, q = matrix(table.column("qvec"), dim)
            parts.append(rows.mapInArrow(_scan(metric, table.column("query_id").to_numpy()[at], q, k, radius), _FOUND))
            continue
        small_batches(rows.sparkSession)
        tiles = tile_count(rows.sparkSession, n, k)
        blocks = packed_rows(rows, dim).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        asked = own.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int"))
        asked = asked.mapInArrow(_packed(dim, "query_id", "qvec", "tile"), f"{_BLOCK}, tile int").select(F.lit(True).alias("query"), "list", "ids", "data", "tile")
        dealt = blocks.select(F.lit(False).alias("query"), "list", "ids", "data", "tile").union(asked).repartitionById(tiles, F.col("tile"))
        parts.append(dealt.mapInArrow(_answers(metric, dim, k, radius), f"{_FOUND}, rank int"))
        if len(sizes) == 1 and own.select(F.count_distinct("query_id")).first()[0] == n:
            return _scored(parts[0], metric)  # a tile has all results of its queries
    found = reduce(DataFrame.union, [p.select("query_id", "vid", "distance") for p in parts]) if parts else rows.sparkSession.createDataFrame([], _FOUND)
    return _ranked(found, metric, k)


def tile_count(spark: SparkSession, n: int, k: int | None) -> int:
    """Tiles that n queries are cut into: each meets all rows, so there are no more than give work to all cores and fit the memory."""
    most = TILE_ROWS if k is None or k > FEW else min(TILE_ROWS, max(1, HELD // k))
    return max(1, math.ceil(n / most), min(3 * spark.sparkContext.defaultParallelism, math.ceil(n / 8)))


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limit of an Arrow batch to BATCH bytes, unless it is lower: blocks are held twice on their way to a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, f"{BATCH}b")


_BLOCK = "list int, ids binary, data binary"


def packed_rows(rows: DataFrame, dim: int) -> DataFrame:
    """Blocks of ids and vectors."""
    return rows.mapInArrow(_packed(dim, "vid", "vec"), f"{_BLOCK}, tile int").drop("tile")


def _packed(dim: int, ids: str, vec: str, tile: str | None = None):
    def run(batches):
        for batch in batches:
            at, x = matrix(batch.column(vec), dim)
            own = batch.column(ids).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            tiles = batch.column(tile).to_numpy(zero_copy_only=False)[at] if tile else np.zeros(len(at), np.int32)
            out = []
            for t in np.unique(tiles):
                these = np.flatnonzero(tiles == t)
                out += [(int(t), own[w].tobytes(), x[w].tobytes()) for w in (these[a : a + PACKED] for a in range(0, len(these), PACKED))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary()), pa.array([o[0] for o in out], pa.int32())], names=["list", "ids", "data", "tile"]
            )

    return run


def unpacked(batch: pa.RecordBatch):
    """query, list, ids and data of each block, the last two as buffers of the batch."""
    for i in range(batch.num_rows):
        yield batch.column("query")[i].as_py(), batch.column("list")[i].as_py(), batch.column("ids")[i].as_buffer(), batch.column("data")[i].as_buffer()


class Spool:
    """Blocks of rows that a task reads again and again: in memory while they are few, else in a file without a name."""

    def __init__(self, load):
        self.load, self.file, self.places, self.ids = load, tempfile.SpooledTemporaryFile(max_size=HELD * 8), [], []  # noqa: SIM115

    def add(self, key: int, ids: pa.Buffer, data: pa.Buffer) -> None:
        self.ids.append(np.frombuffer(ids, np.int64).copy())
        self.places.append((key, self.file.tell(), data.size))
        self.file.write(memoryview(data))

    def close(self) -> None:
        self.file.close()

    def read(self):
        """Number, list and vectors of each block."""
        for i, (key, start, size) in enumerate(self.places):
            self.file.seek(start)
            yield i, key, self.load(self.file.read(size), len(self.ids[i]))


def gathered(metric: str, qid: np.ndarray, q: np.ndarray, spool: Spool, k: int | None, radius: float | None, probes: np.ndarray | None = None):
    """All results of some queries, ranked: a few queries at a time meet all blocks (those of their lists)."""
    ids = np.concatenate(spool.ids) if spool.ids else np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    ids, number = ids[order], np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))  # places in the order of the vids, which settles ties
    number = np.split(number, np.cumsum([len(x) for x in spool.ids])[:-1]) if spool.ids else []
    out, size = [], 0
    step = max(1, HELD // max(1, len(ids)))
    for a in range(0, len(q), step):
        parts = [[] for _ in q[a : a + step]]
        for n, key, x in spool.read():
            own = np.arange(len(parts)) if probes is None else np.flatnonzero((probes[a : a + step] == key).any(axis=1))
            for b in range(0, len(own), max(1, BLOCK_SCORES // max(1, len(x)))):
                some = own[b : b + max(1, BLOCK_SCORES // max(1, len(x)))]
                for i, d in zip(some, distances(metric, q[a + some], x), strict=True):
                    if radius is None:
                        parts[i].append((number[n], d.copy()))
                    elif len(at := np.flatnonzero(d <= radius)):
                        parts[i].append((number[n][at], d[at]))
        for i, part in enumerate(parts):
            if not part:
                continue
            at, d = np.concatenate([p for p, _ in part]), np.concatenate([p for _, p in part])
            at, d = _sorted(at, d, len(ids), k)
            for b in range(0, len(at), 1 << 16):
                these = at[b : b + (1 << 16)]
                out.append((np.full(len(these), qid[a + i]), ids[these], d[b : b + (1 << 16)], np.arange(b + 1, b + len(these) + 1, dtype=np.int32)))
                size += len(these)
                if size >= 1 << 16:
                    yield _columns(out)
                    out, size = [], 0
            parts[i] = None
    if out:
        yield _columns(out)


def _columns(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vid", "distance", "rank"])


def _sorted(at: np.ndarray, d: np.ndarray, n: int, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places below n and distances, by distance and place; NaN is the largest. The k first, or all."""
    if k is not None and len(d) > k and not np.isnan(cut := np.partition(d, k - 1)[k - 1]):
        near = np.flatnonzero(d <= cut)
        at, d = at[near], d[near]
    order = np.argsort(d)
    at, d = at[order], d[order]
    with np.errstate(invalid="ignore"):
        new = (d[1:] != d[:-1]) & ~(np.isnan(d[1:]) & np.isnan(d[:-1]))
    if not new.all():  # one number for distance and place, which sorts faster than two keys
        run = np.concatenate(([0], np.cumsum(new)))
        at = np.sort(run * n + at) - run * n
    return at[:k], d[:k]


def _answers(metric: str, dim: int, k: int | None, radius: float | None):
    """A tile of queries against all rows."""

    def run(batches):
        spool, ids, vectors = Spool(lambda data, n: np.frombuffer(data, np.float32).reshape(n, dim)), [], []
        for batch in batches:
            for is_query, key, own, data in unpacked(batch):
                if is_query:
                    ids.append(np.frombuffer(own, np.int64).copy())
                    vectors.append(np.frombuffer(data, np.float32).reshape(-1, dim).copy())
                else:
                    spool.add(key, own, data)
        if ids and spool.ids:
            yield from answered(metric, np.concatenate(ids), np.concatenate(vectors), spool, k, radius)
        spool.close()

    return run


def answered(metric: str, qid: np.ndarray, q: np.ndarray, spool: Spool, k: int | None, radius: float | None, probes: np.ndarray | None = None):
    if k is None or k > FEW:
        yield from gathered(metric, qid, q, spool, k, radius, probes)
        return
    held = Nearest(metric, q, k, radius)
    for i, key, x in spool.read():
        own = None if probes is None else np.flatnonzero((probes == key).any(axis=1))
        if own is None or len(own):
            held.add(spool.ids[i], x, own, key)
    rank = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in held.n])
    found = held.found(qid)
    for a in range(0, len(rank), 1 << 16):
        yield pa.RecordBatch.from_arrays([*(c.slice(a, 1 << 16) for c in found.columns), pa.array(rank[a : a + (1 << 16)])], names=["query_id", "vid", "distance", "rank"])


def _ranked(found: DataFrame, metric: str, k: int | None) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "vid")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if k is not None:
        ranked = ranked.filter(F.col("rank") <= k)
    return _scored(ranked, metric)


def _scored(ranked: DataFrame, metric: str) -> DataFrame:
    return ranked.select("query_id", "rank", "vid", "distance", V.score(metric, F.col("distance")).alias("score"))


def knn(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", where: Filter | Column | None = None, include: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest rows (vid, vec, ...) of every query (query_id, qvec); filtered before ranking.

    include names further columns of rows to attach to the results.
    """
    rows = matching(rows, where)
    if k < 1:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vid long, distance double, score double")
    found = _searched(rows, queries, k, metric, None)
    return found.join(rows.select("vid", *include), "vid").select("query_id", "rank", "vid", "distance", "score", *include) if include else found


def knn_by_id(rows: DataFrame, vid: int, k: int = 10, metric: str = "l2", where: Filter | Column | None = None) -> DataFrame:
    """The nearest rows of a stored row, itself included; none if there is no such row."""
    return knn(rows, rows.filter(F.col("vid") == vid).select(F.col("vid").alias("query_id"), F.col("vec").alias("qvec")).limit(1), k, metric, where)


def range_search(rows: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", capacity: int | None = None, where: Filter | Column | None = None) -> DataFrame:
    """All rows within radius (in the metric's own distance), nearest first; at most capacity a query. A negative radius gives none."""
    rows = matching(rows, where)
    if radius < 0:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vid long, distance double, score double")
    if capacity is not None and capacity < 1:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vid long, distance double, score double")
    return _searched(rows, queries, capacity, metric, radius)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query_id, vid) that were found."""
    total = exact.count()
    hit = exact.select("query_id", "vid").join(found.select("query_id", "vid"), ["query_id", "vid"], "left_semi").count()
    return hit / total if total else 1.0
