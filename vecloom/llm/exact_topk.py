"""Exact top-k search by tiled matrix products.

Vectors are quantised to integers and packed into shards, query vectors into
tiles. A grid of cells pairs every tile with every shard: shards are dealt to grid
rows, tiles to grid columns, and each cell multiplies its tiles and shards, keeping
k candidates a query (partial selection by the k-th score, then a sort of those).
Lists of cells are merged as a tree of fixed fan-in, so no task ever sees more than
FAN_IN lists of a query, however many shards there are.

The grid has rows in proportion to the vectors and columns in proportion to the
queries; a shard is copied once per column and a tile once per row.

Defined results: vectors that are null or hold a null, a NaN or an infinity take
no part, nor do null vec_ids; vectors meet only vectors of their own length; a
query never meets rows of its own vec_id; repeated rows are candidates each; ties
go to the smaller vec_id; empty vectors score 0; other columns are ignored; no
rows give no rows. A score beyond 64 bits is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, SCALE, EVERY = 5, 256, 50
#: Vectors of a packed shard and queries of a packed tile.
SHARD, TILE = 4096, 1024
#: Vectors of a grid row and queries of a grid column.
ROW, COLUMN = 1 << 16, 1 << 14
FAN_IN = 16


def _quantised(batch, scale: int):
    """vec_id and integer vectors of the rows that take part, by length."""
    column = batch.column("embedding")
    ids = batch.column("vec_id")
    take = np.array(column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False))
    flat = column.flatten()  # of valid rows only
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.zeros(len(column), np.int64)
    sizes[:] = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    take &= bad[ends] == bad[ends - sizes]
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[take]):
        rows = np.flatnonzero(take & (sizes == size))
        at = (ends[rows] - size)[:, None] + np.arange(size)
        yield int(size), numbers[rows], np.floor(scale * values[at])


_PACK = "size int, part int, ids binary, data binary"
_PACK_SCHEMA = pa.schema([("size", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])


def _pack(scale: int, rows: int, parts: int, every: int):
    """Packed matrices of at most `rows` vectors, dealt to `parts` parts in turn."""

    def run(batches):
        from pyspark import TaskContext

        dealt = TaskContext.get().partitionId()
        held: dict[int, list] = {}

        def flush(size: int):
            nonlocal dealt
            ids = np.concatenate([x for x, _ in held[size]])
            data = np.concatenate([x for _, x in held.pop(size)])
            for at in range(0, len(ids), rows):
                dealt += 1
                part = [pa.array([v], t) for v, t in zip((size, dealt % parts, ids[at : at + rows].astype("<i8").tobytes(), data[at : at + rows].astype("<f8").tobytes()), _PACK_SCHEMA.types, strict=True)]
                yield pa.RecordBatch.from_arrays(part, schema=_PACK_SCHEMA)

        for batch in batches:
            for size, ids, data in _quantised(batch, scale):
                if every > 1:
                    pick = ids % every == 0
                    ids, data = ids[pick], data[pick]
                if len(ids):
                    held.setdefault(size, []).append((ids, data))
                    if sum(len(x) for x, _ in held[size]) >= rows:
                        yield from flush(size)
        for size in list(held):
            yield from flush(size)

    return run


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: higher scores, then smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: 64-bit integers, or Python's where doubles could round."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), object)
    for i, p in enumerate(a.tolist()):
        for j, q in enumerate(b.tolist()):
            out[i, j] = sum(int(x) * int(y) for x, y in zip(p, q, strict=True))
    return out


_LIST = "query_id long, row int, vec_id long, score long"


def _cells(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                qi, ci = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                q, c = (np.frombuffer(x, "<f8").reshape(-1, r["size"]) if r["size"] else np.zeros((n, 0)) for x, n in ((r["q_data"], len(qi)), (r["data"], len(ci))))
                out = []
                for at in range(0, len(qi), 128):  # scores of 128 queries at once
                    scores = _product(q[at : at + 128], c)
                    for i, s in zip(range(at, at + 128), scores, strict=False):
                        own = np.flatnonzero(ci != qi[i])
                        pick = own[best(s[own], ci[own], k)]
                        out.append((np.full(len(pick), qi[i]), ci[pick], s[pick].astype(np.int64)))
                query, vec, score = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.full(len(query), r["row"], np.int32)), pa.array(vec), pa.array(score)], names=["query_id", "row", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row whose vec_id is divisible by `every`."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    height, width = max(1, math.ceil(size["n"] / ROW)), max(1, math.ceil(size["q"] / COLUMN))
    # the grid also gives every core of a small cluster something to do
    height = max(height, min(math.ceil(size["n"] / SHARD), rows.sparkSession.sparkContext.defaultParallelism))
    shards = rows.mapInArrow(_pack(scale, SHARD, height, 1), _PACK)
    tiles = rows.filter(F.col("vec_id") % every == 0).mapInArrow(_pack(scale, TILE, width, every), _PACK)
    shards = shards.withColumnRenamed("part", "row").withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    tiles = tiles.selectExpr("size", "part AS col", "ids AS q_ids", "data AS q_data").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    cells = height * width
    key = ["size", "row", "col"]
    pairs = shards.repartition(cells, *key).join(tiles.repartition(cells, *key), key)
    lists = pairs.select("size", "row", "ids", "data", "q_ids", "q_data").mapInArrow(_cells(k), _LIST)
    order = [F.col("score").desc(), F.col("vec_id")]
    while height > FAN_IN:
        height = math.ceil(height / FAN_IN)
        lists = lists.withColumn("row", (F.col("row") / FAN_IN).cast("int"))
        lists = _top(lists, W.partitionBy("query_id", "row").orderBy(*order), k).drop("rank")
    return _top(lists, W.partitionBy("query_id").orderBy(*order), k).select("query_id", "rank", "vec_id", "score")


def _top(lists: DataFrame, window, k: int) -> DataFrame:
    return lists.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


#: DuckDB SQL for the rows of op3.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
