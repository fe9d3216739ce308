"""Exact dedup by composable polynomial fingerprints.

A text of bytes b_0 b_1 ... has the fingerprint sum((b_i + 1) * x ** i) modulo
2 ** 31 - 1, for two bases x, and its length. Chunks are hashed on their own (one
matrix product for all chunks of a block of texts) and combined by
left + x ** len(left) * right; a huge text is hashed in windows that combine alike.

Texts of repeated fingerprints, and no others, are then compared byte by byte without
bringing them together: for each fingerprint and chunk number the smallest and the
largest chunk are kept by a combinable aggregate; they differ only where two texts
differ. Groups with such a chunk are split by their SHA-256.

Defined results: null counts as an empty text; of equal texts the row with the
largest doc_id stays (a null doc_id is the smallest; of rows that repeat both,
one stays); other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import bit_table, blocks, ids_and_texts, keep_rows, sieved, stored, text_buffers, text_tag, tidy, with_group

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_812_433_253)
#: Bytes hashed by one row of the matrix product; sums stay below 2 ** 53.
CHUNK = 1024
#: Bytes of a text that are hashed at once, a multiple of CHUNK.
WINDOW = 1 << 21
#: Bytes of a chunk that the comparison handles.
COMPARE = 1 << 15


def chunk_weights(size: int = CHUNK) -> np.ndarray:
    """x ** i for i below size, one column for each base."""
    w = np.ones((size, len(BASES)), np.int64)
    for k, base in enumerate(BASES):
        for i in range(1, size):
            w[i, k] = w[i - 1, k] * base % PRIME
    return w


def combine(left: tuple[int, ...], left_size: int, right: tuple[int, ...]) -> tuple[int, ...]:
    """Fingerprint of two texts in a row from the fingerprints of each."""
    return tuple((a + pow(x, left_size, PRIME) * b) % PRIME for a, b, x in zip(left, right, BASES, strict=True))


def fingerprints(data: np.ndarray, off: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Both residues of every text in one 62-bit number; a text of over `window` bytes is hashed window by window."""
    out = np.zeros((len(off) - 1, len(BASES)), np.int64)
    huge = np.flatnonzero(np.diff(off) > window)
    for i in huge.tolist():
        total = (0,) * len(BASES)
        for at in range(int(off[i]), int(off[i + 1]), window):
            part = data[at : min(at + window, int(off[i + 1]))]
            total = combine(total, at - int(off[i]), tuple(_residues(part, np.array([0, len(part)]), weights)[0].tolist()))
        out[i] = total
    first = 0
    for last in [*huge.tolist(), len(off) - 1]:  # the texts between two huge ones
        if last > first:
            out[first:last] = _residues(data[off[first] : off[last]], off[first : last + 1] - off[first], weights)
        first = last + 1
    return (out[:, 0] << 31) | out[:, 1]


def _residues(data: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of residues for each text: a matrix product over its chunks, whose sums are shifted and added."""
    size = len(weights)
    n = np.diff(off)
    chunks = np.maximum((n + size - 1) // size, 1)
    first = np.concatenate(([0], np.cumsum(chunks)))
    padded = np.zeros(int(first[-1]) * size, np.float64)
    for a, b, at in zip(off[:-1].tolist(), off[1:].tolist(), (first[:-1] * size).tolist(), strict=True):
        padded[at : at + b - a] = data[a:b]
        padded[at : at + b - a] += 1
    parts = (padded.reshape(-1, size) @ weights.astype(np.float64)).astype(np.int64) % PRIME
    number = np.arange(len(parts)) - np.repeat(first[:-1], chunks)
    out = np.zeros((len(n), len(BASES)), np.int64)
    for k, base in enumerate(BASES):
        shift = np.ones(int(chunks.max(initial=1)), np.int64)
        step = pow(base, size, PRIME)
        for j in range(1, len(shift)):
            shift[j] = shift[j - 1] * step % PRIME
        out[:, k] = np.add.reduceat(parts[:, k] * shift[number] % PRIME, first[:-1]) % PRIME
    return out


def _describe(batches):
    weights = chunk_weights()
    for block in blocks(batches):
        data, off = text_buffers(block.column("text"))
        view = memoryview(data)
        shas = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("tag"), pa.array(fingerprints(data, off, weights)), pa.array(np.diff(off)), pa.array(shas, pa.string())],
            names=["doc_id", "tag", "fp", "n_bytes", "text_sha256"],
        )


def _tagged(batches):
    """Fingerprints and texts; of equal texts of a block one."""
    weights = chunk_weights()
    for block in blocks(batches):
        data, off = text_buffers(block.column("text"))
        prints, sizes = fingerprints(data, off, weights), np.diff(off)
        seen: dict[tuple[int, int], list[bytes]] = {}
        rows = []
        for i, key in enumerate(zip(prints.tolist(), sizes.tolist(), strict=True)):
            text = data[off[i] : off[i + 1]].tobytes()
            others = seen.setdefault(key, [])
            if text not in others:
                others.append(text)
                rows.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(prints[rows]), pa.array(sizes[rows]), block.column("text").take(pa.array(rows))], names=["fp", "n_bytes", "text"])


def differing_groups(docs: DataFrame, info: DataFrame, size: int = COMPARE) -> DataFrame:
    """The fingerprints (fp, n_bytes) of info (with the tags of its texts) under which two texts of docs differ.

    Only texts of repeated fingerprints are shuffled.
    """
    key = ["fp", "n_bytes"]
    repeated = info.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    # a text has one tag and one fingerprint: these are the distinct pairs, however often a text stands
    tags = info.select(*key, "tag").distinct().join(repeated.hint("merge"), key, "left_semi").select("tag")
    kind = "fp long, n_bytes long, text string"
    table, work = bit_table(tags), _tagged
    # sieved in the same worker: two in a task would double the memory
    texts = docs.select(text_tag().alias("tag"), "text").mapInArrow(tidy(lambda batches: work(sieved(batches, "tag", table))), kind)
    texts = texts.join(repeated.hint("shuffle_hash"), key)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    numbered = texts.select("fp", "n_bytes", raw.alias("raw"), F.explode(F.sequence(F.lit(0), (F.col("n_bytes") / size).cast("int"))).alias("chunk"))
    chunks = numbered.select("fp", "n_bytes", "chunk", F.expr(f"substring(raw, chunk * {size} + 1, {size})").alias("piece"))
    span = chunks.groupBy("fp", "n_bytes", "chunk").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"))
    return span.filter("lo <> hi").select("fp", "n_bytes").distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return decide(docs).drop("tag")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; only rows of repeated texts are shuffled."""
    several = decide(docs).filter("group_size > 1")
    return keep_rows(docs, several.filter("kept"), several.select("tag"))


def decide(docs: DataFrame) -> DataFrame:
    """exact_dedup with each row's text tag."""
    rows = ids_and_texts(docs)
    described = rows.withColumn("tag", text_tag()).mapInArrow(tidy(_describe), "doc_id long, tag long, fp long, n_bytes long, text_sha256 string")
    info = stored(described.withColumn("row", F.monotonically_increasing_id()))
    key = ["fp", "n_bytes"]
    # compared once; where no texts differ under one fingerprint, as nearly always, nothing is left to join
    differ = stored(differing_groups(rows, info).withColumn("differ", F.lit(True)))
    split = info.withColumn("part", F.lit(""))
    if not differ.isEmpty():
        split = info.join(differ.hint("merge"), key, "left").withColumn("part", F.when(F.col("differ"), F.col("text_sha256")).otherwise("")).drop("differ")
    last = F.max(F.struct("doc_id", "row"))
    grouped = with_group(split, [*key, "part"], {"n": F.count(F.lit(1)), "last": last}, {"group_size": F.sum("n"), "stays": F.max("last")}, "row")
    return grouped.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256", "tag")


#: DuckDB SQL for the rows of op7.
ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
