"""Substring dedup by difference-cover anchors.

A word window of WINDOW words is removed from a document when the same word
sequence also starts in a document with a smaller doc_id. Two equal windows at
word numbers i and j always hold, at one common distance d below the period,
positions i + d and j + d that both lie in the difference cover modulo the
period. So it is enough to hash short anchors at cover positions (6 of 31);
documents that share no anchor share no window. Around shared anchors the match
is extended to whole windows. Anchors only propose (64-bit hashes); a window's words,
joined by one space, are compared by 128-bit BLAKE2 digests.

Plan: scan -> anchors (combined within each block, so that a hot passage sends
one row a block) -> shuffle by anchor -> documents with shared anchors -> window
hashes around them (combined likewise) -> shuffle by window -> removed runs,
joined to the texts. Texts that share an anchor are shuffled once, the others never.

Defined results: a null text has no words; a null doc_id is neither larger nor
smaller than another, so such rows stay whole; rows that repeat a doc_id never
remove each other's words; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import bit_table, blocks, ids_and_texts, mix, run_hashes, shuffle_width, sieve, sieved, stored, text_buffers, word_hashes, word_spans

WINDOW = 50
#: A perfect difference set: every residue modulo 31 is a difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

_ROWS = pa.schema([("key", pa.int64()), ("rest", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("run", pa.int32()), ("known", pa.bool_()), ("more", pa.list_(pa.int32()))])
_ROWS_SQL = "key long, rest long, doc_id long, at long, run int, known boolean, more array<int>"


def _split_groups(keys: np.ndarray, ids: np.ndarray):
    """Of rows with equal keys within a block: which belong to the smallest id, and which groups hold several ids."""
    order = np.lexsort((ids, keys))
    k, d = keys[order], ids[order]
    first = np.empty(len(k), bool)
    first[:1] = True
    first[1:] = k[1:] != k[:-1]
    group = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    low = np.empty(len(k), bool)
    several = np.empty(len(k), bool)
    tails = np.append(heads[1:], len(k)) - 1
    low[order] = d == d[heads][group]
    several[order] = (d[heads] < d[tails])[group]
    return low, several


def _rows(keys, ids, at, run, known, more=None, rest=None) -> pa.RecordBatch:
    more = pa.nulls(len(keys), _ROWS.field("more").type) if more is None else more
    rest = pa.nulls(len(keys), pa.int64()) if rest is None else pa.array(rest)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(keys).view(np.int64)), rest, pa.array(ids), pa.array(at), pa.array(run.astype(np.int32)), pa.array(known), more], schema=_ROWS
    )


def _asked(ask: np.ndarray, keys: np.ndarray, doc: np.ndarray, local: np.ndarray):
    """Of the asking rows, one for each key and document, and where else in it the key stands (null if nowhere)."""
    ask = ask[np.lexsort((local[ask], doc[ask], keys[ask]))]
    new = np.append(True, (np.diff(doc[ask]) != 0) | (keys[ask][1:] != keys[ask][:-1]))
    heads = np.flatnonzero(new)
    others = np.diff(np.append(heads, len(ask))) - 1
    more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(others))).astype(np.int32)), pa.array(local[ask[~new]].astype(np.int32)), mask=pa.array(others == 0))
    order = np.argsort(ask[heads])  # back in text order: neighbouring rows of a document compress well
    return ask[heads][order], more.take(pa.array(order))


def _words(block: pa.RecordBatch):
    """Hashes of all words, words a row, and each word's row and number in it; the words' bytes and places with them."""
    data, off = text_buffers(block.column("text"))
    starts, ends, first = word_spans(data, off)
    hashes = word_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    local = np.arange(len(starts)) - first[doc]
    return hashes, n, doc, local, (data, off, starts, ends)


def _digests(spans, at: np.ndarray, window: int) -> np.ndarray:
    """128-bit BLAKE2 digests of the windows that start at the words `at`: words joined by one space."""
    data, off, starts, ends = spans
    raw = data.tobytes()
    rows = (b" ".join(raw[a:b].split()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
    joined = b" ".join(row for row in rows if row)
    place = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    digest = hashlib.blake2b
    parts = [digest(joined[a:b], digest_size=16).digest() for a, b in zip(place[at].tolist(), (place[at + window] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)


def _codes(digests: np.ndarray) -> np.ndarray:
    """Numbers that are equal where the digests are."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    sorted_ = digests[order]
    codes = np.empty(len(digests), np.int64)
    codes[order] = np.cumsum(np.append(False, (sorted_[1:] != sorted_[:-1]).any(axis=1)))
    return codes


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    length = window - period + 1
    is_cover = np.zeros(period, bool)
    is_cover[[c % period for c in cover]] = True

    def run(batches):
        for block in blocks(batches):
            hashes, n, doc, local, _ = _words(block)
            at = np.flatnonzero(is_cover[local % period] & (n[doc] >= window) & (local + length <= n[doc])) if len(local) else local
            if not len(at):
                continue
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)[doc[at]]
            tag = block.column("tag").to_numpy(zero_copy_only=False)[doc[at]]
            keys = run_hashes(hashes, at, length)
            low, several = _split_groups(keys, ids)
            where = (tag << 32) | local[at]
            known = several & ~low
            # one row for each anchor and block asks the other blocks; the rest are hits already
            ask, more = _asked(np.flatnonzero(low), keys, doc[at], local[at])
            yield _rows(keys[ask], ids[ask], where[ask], np.ones(len(ask)), several[ask], more)
            told = np.flatnonzero(known)
            if len(told):
                yield _rows(mix(ids[told].astype(np.uint64) + np.uint64(977)), ids[told], where[told], np.ones(len(told)), np.ones(len(told), bool))

    return run


def _windows(window: int, period: int):
    def run(batches):
        for block in blocks(batches):
            hashes, n, doc, local, spans = _words(block)
            if not len(hashes):
                continue
            hits = block.column("hits")
            first = np.concatenate(([0], np.cumsum(n)))
            owner = np.repeat(np.arange(block.num_rows), np.diff(hits.offsets.to_numpy()))
            p = hits.flatten().to_numpy().astype(np.int64)
            # a window that starts at most period - 1 words before a shared anchor is a candidate
            lo = np.maximum(p - period + 1, 0)
            hi = np.minimum(p, n[owner] - window)
            ok = lo <= hi
            edge = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(edge, (first[owner] + lo)[ok], 1)
            np.add.at(edge, (first[owner] + hi + 1)[ok], -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if not len(at):
                continue
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)[doc[at]]
            tag = block.column("tag").to_numpy(zero_copy_only=False)[doc[at]]
            digests = _digests(spans, at, window)
            codes = _codes(digests)
            low, _ = _split_groups(codes, ids)
            where = (tag << 32) | local[at]
            ask, more = _asked(np.flatnonzero(low), codes, doc[at], local[at])
            yield _rows(digests[ask, 0], ids[ask], where[ask], np.ones(len(ask)), np.zeros(len(ask), bool), more, digests[ask, 1])
            told = np.flatnonzero(~low)
            if len(told):  # removed already, by a smaller doc_id of this block: as runs of window starts
                new = np.append(True, (np.diff(at[told]) != 1) | (np.diff(doc[at[told]]) != 0))
                head = np.flatnonzero(new)
                size = np.diff(np.append(head, len(told)))
                rows = told[head]
                yield _rows(mix(ids[rows].astype(np.uint64) + np.uint64(977)), ids[rows], where[rows], size, np.ones(len(rows), bool))

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary()), ("removed_runs", pa.list_(pa.int32()))])
_OUT_SQL = "doc_id long, n_words long, n_removed long, kept_text binary, removed_runs array<int>"


def _keep(window: int, digest: bool, without: np.ndarray | None = None):
    def run(batches):
        schema = pa.schema([*list(_OUT)[:3], ("kept_sha256", pa.string())]) if digest else _OUT
        for block in blocks(batches if without is None else sieved(batches, "row_key", without, inside=False)):
            out = []
            every = block.column("runs").to_pylist() if "runs" in block.schema.names else [None] * block.num_rows
            for doc_id, text, runs in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), every, strict=True):
                words = (text or "").encode().split()
                cover, kept = [], words
                if runs:
                    edge = np.zeros(len(words) + 1, np.int32)
                    starts = np.array([r["start"] for r in runs])
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + np.array([r["run"] for r in runs]) + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    if not digest:
                        cover = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
                text = b" ".join(kept)
                row = [doc_id, len(words), len(words) - len(kept)]
                out.append([*row, hashlib.sha256(text).hexdigest()] if digest else [*row, text, cover])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (UTF-8), removed_runs
    (start, end, start, end, ... in words). With digest: kept_sha256 instead of the last two.
    """
    if period > window:
        raise ValueError("the period must not exceed the window")
    # the tag tells rows that repeat a doc_id apart
    rows = ids_and_texts(docs).withColumn("tag", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 33))
    known_ids = rows.filter(F.col("doc_id").isNotNull())
    n = shuffle_width(docs)

    same = W.partitionBy("key")
    anchors = known_ids.mapInArrow(_anchors(window, period, cover), _ROWS_SQL).drop("rest").repartition(n, "key")
    shared = anchors.withColumn("lo", F.min("doc_id").over(same)).withColumn("hi", F.max("doc_id").over(same)).filter("known or lo < hi")
    place = [F.col("doc_id"), F.shiftrightunsigned("at", 32).alias("tag")]
    start = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    hits = shared.groupBy(*place).agg(F.collect_list(start).alias("hits"), F.flatten(F.collect_list("more")).alias("more"))
    hits = stored(hits.select("doc_id", "tag", F.concat("hits", "more").alias("hits")))

    # texts without shared anchors lose nothing and stay where they are
    row_key = F.xxhash64("doc_id", "tag").alias("row_key")
    table = bit_table(hits.select(row_key))
    asking = sieve(known_ids.select("*", row_key), "row_key", table).drop("row_key")
    near = asking.join(hits.hint("shuffle_hash"), ["doc_id", "tag"])
    windows = near.select("doc_id", "tag", "text", "hits").mapInArrow(_windows(window, period), _ROWS_SQL).repartition(n, "key")
    same = W.partitionBy("key", "rest")
    removed = windows.withColumn("lo", F.min("doc_id").over(same)).filter("known or lo < doc_id")
    single = F.transform(F.flatten(F.collect_list("more")), lambda x: F.struct(x.alias("start"), F.lit(1).alias("run")))
    runs = removed.groupBy(*place).agg(F.collect_list(F.struct(start.alias("start"), "run")).alias("runs"), single.alias("more"))
    runs = runs.select("doc_id", "tag", F.concat("runs", "more").alias("runs"))

    # a repeated row collects its runs twice, which removes no more
    sql = "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else _OUT_SQL
    with_runs = asking.join(runs.hint("shuffle_hash"), ["doc_id", "tag"], "left").select("doc_id", "text", "runs").mapInArrow(_keep(window, digest), sql)
    whole = known_ids.select("doc_id", "text", row_key).mapInArrow(_keep(window, digest, table), sql)
    no_id = rows.filter(F.col("doc_id").isNull()).select("doc_id", "text").mapInArrow(_keep(window, digest), sql)
    return with_runs.unionByName(whole).unionByName(no_id)
