"""Shared pieces of the training-data operators: block iteration over Arrow
batches, word spans and span hashes in numpy, and lineage cuts.

All numpy helpers work on one bounded block of rows at a time, so a task's
memory follows the block size (and the longest single text), not its partition.
"""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy block holds (a longer text is a block of its own).
BLOCK_BYTES = 1 << 21

#: Bytes that separate words: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's own spark.checkpoint.dir.

    A machine-local one is set only where the session has none, as in local tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "vecloom-checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder; later stages reread it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """df written as a table to the shared folder and read again; `old`, a table of before, is deleted then."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vecloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if old is not None:
        drop_stored(old)
    out = spark.read.schema(df.schema).parquet(path)
    out.vecloom_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes a table written by `stored`."""
    path = df.__dict__.get("vecloom_path")
    if path is not None:
        remove_folder(df.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def blocks(batches, column: str = "text", size: int = BLOCK_BYTES):
    """Slices of the batches with at most `size` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = text_buffers(batch.column(column))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
            yield batch.slice(at, min(end, n) - at)
            at = min(end, n)


#: Bytes of rows that go to a Python worker at once in the pipeline.
BATCH = 4 << 20


def small_batches(spark: SparkSession, size: int = BATCH) -> None:
    """Sets the session's limit of an Arrow batch to `size` bytes, unless it is lower.

    A batch of long texts is held several times over: by the JVM on its way out and back, by
    the worker while the next one comes. Which rows come together changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= size:
        spark.conf.set(name, f"{size}b")


def tidy(run):
    """run, then what it freed goes back to the system: Spark keeps its Python workers for later stages."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim is not None:
                trim(0)

    return tidied


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and each row's first word number (n + 1 of them)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    gap = _SPACE[data]
    start, end = ~gap, ~gap
    start[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    filled = off[:-1] < off[1:]
    first, last = off[:-1][filled], off[1:][filled] - 1
    start[first] = ~gap[first]
    end[last] = ~gap[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Base ** i and base ** -i for i below n, modulo 2 ** 64 (bases are odd)."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        n = max(n, min(1 << (n - 1).bit_length(), BLOCK_BYTES + 1))  # a worker keeps them: no more than its blocks need
        base, tables = _BASES[which], []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(n, np.uint64(b))
            t[0] = 1
            tables.append(np.cumprod(t))
        if n > 4 * BLOCK_BYTES:  # of one huge text: not kept
            return tables[0], tables[1]
        _POWERS[which] = (tables[0], tables[1])
    return _POWERS[which]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    return h ^ (h >> np.uint64(31))


def _prefix(codes: np.ndarray, which: int) -> np.ndarray:
    c = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes), which)[0][: len(codes)], out=c[1:])
    return c


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes; the same bytes hash alike at any place."""
    c = _prefix(_BYTE_CODE[data], 0)
    h = (c[ends] - c[starts]) * powers(len(data) + 1, 0)[1][starts]
    return mix(h + (ends - starts).astype(np.uint64))


def run_hashes(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of codes[p : p + length] for each p in `at`."""
    c = _prefix(codes, 1)
    return mix((c[at + length] - c[at]) * powers(len(codes) + 1, 1)[1][at])


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text; as plain columns where the type fits, so that equal subplans stay equal."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id" if kind == "bigint" else docs["doc_id"].cast("long").alias("doc_id"), "text")


def text_tag() -> Column:
    """Hash of the text, to tell rows that repeat a doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


#: Parts that a group's rows are dealt to on their way to what the whole group knows.
PARTS = 64


def with_group(rows: DataFrame, keys: list[str], parts: dict[str, Column], whole: dict[str, Column], by: str) -> DataFrame:
    """rows with aggregates of their group: `parts` over each part (dealt by the column `by`), `whole` over these.

    A group's result is copied to the parts that it has, so no task gets all rows of a hot group.
    """
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    some = dealt.groupBy(*keys, "__part").agg(*[c.alias(n) for n, c in parts.items()])
    all_ = some.groupBy(*keys).agg(*[c.alias(n) for n, c in whole.items()], F.collect_list("__part").alias("__parts"))
    all_ = all_.select(*keys, *whole, F.explode("__parts").alias("__part"))
    return dealt.join(all_.hint("merge"), [*keys, "__part"]).drop("__part")


#: Words of 64 bits of a bit table, as a power of two.
TABLE = 18


def bit_table(keys: DataFrame) -> np.ndarray:
    """A fixed table of 2 ** (TABLE + 6) bits with one set for each key (the only column, a well mixed 64-bit hash).

    Combined in the executors; at most 2 ** TABLE words reach the driver, whatever the
    number of keys. A key that is not in keys may find its bit set.
    """
    key = F.col(keys.columns[0])
    word = F.shiftrightunsigned(key, 64 - TABLE).cast("int").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 58 - TABLE).bitwiseAND(F.lit(63)).cast("int")).alias("bit")
    found = keys.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << TABLE, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint64)


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64 bits each) find their bit set."""
    keys = keys.view(np.uint64)
    return (table[keys >> np.uint64(64 - TABLE)] >> ((keys >> np.uint64(58 - TABLE)) & np.uint64(63)) & np.uint64(1)).astype(bool)


def sieved(batches, column: str, table: np.ndarray, inside: bool = True):
    """The batches' rows whose key (long) finds its bit set, or the others."""
    for batch in batches:
        yield batch.filter(pa.array(in_table(table, batch.column(column).to_numpy(zero_copy_only=False)) == inside))


def sieve(df: DataFrame, column: str, table: np.ndarray, inside: bool = True) -> DataFrame:
    """`sieved` rows of a table; nothing is shuffled."""
    return df.mapInArrow(tidy(lambda batches: sieved(batches, column, table, inside)), df.schema)


def keep_rows(docs: DataFrame, kept: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Of the rows of docs whose text tag is doubtful (one column), those whose doc_id and text tag stand in
    kept (doc_id, tag), one of each that repeats both; and all other rows, which are not shuffled."""
    keys = ["__no_id", "__id", "__tag"]
    table = bit_table(doubtful)

    def keyed(df: DataFrame, tag: Column) -> DataFrame:
        return df.withColumns({"__no_id": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__tag": tag})

    tagged = docs.withColumn("__tag", text_tag())
    right = keyed(kept, F.col("tag")).select(*keys).hint("merge")
    some = keyed(sieve(tagged, "__tag", table), F.col("__tag"))
    staying = some.join(right, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
    return sieve(tagged, "__tag", table, inside=False).select(*docs.columns).unionByName(staying)
