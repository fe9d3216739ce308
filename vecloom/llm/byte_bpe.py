"""Byte-level BPE encoding and decoding by merge replay.

The distinct words of a block of the corpus are laid out as one array of symbols
with links to neighbours. An inverted index lists, for each merge rank, the
positions where that pair stands. Ranks are applied in order; a merge touches
only its own two symbols and the pairs with its neighbours, which enter the index
under their own ranks. The texts are then written from their words' ids, so each
distinct word is merged once for a block, and once for a worker while its table
of words has room.

Words are independent of each other, so replaying the corpus block by block
gives what one replay of the whole corpus gives, in bounded memory and without
shuffling a single word.

Defined results: a null text is an empty one (no ids); other columns, repeated
rows and null ids pass through unchanged; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.llm import pieces
from vecloom.llm.common import blocks, ids_and_texts

#: Words that a worker keeps ready; beyond that it starts over.
WORD_TABLE = 400_000
_SHIFT = 20


class MergeTable:
    """A vocabulary of token bytes by rank, and which pairs of tokens merge into which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[(a << _SHIFT) | b] = rank
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        self.first = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = ranks.get(bytes([a, b]), -1)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, as little-endian 32-bit numbers."""
        out = [b""] * len(words)
        rest = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif word:
                rest.append(i)
        if not rest:
            return out
        data = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(words[i]) for i in rest])))
        ids = np.array(self._merge(data, bounds), np.int64)
        alive = ids >= 0
        counts = np.concatenate(([0], np.cumsum(alive)))[bounds].tolist()
        packed = ids[alive].astype("<u4").tobytes()
        for i, a, b in zip(rest, counts[:-1], counts[1:], strict=True):
            out[i] = packed[4 * a : 4 * b]
        return out

    def _merge(self, data: np.ndarray, bounds: np.ndarray) -> list[int]:
        n = len(data)
        symbols = self.byte_ids[data].tolist()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[bounds[1:] - 1] = -1
        before[bounds[:-1]] = -1
        # the inverted index: rank -> positions of the pair's left symbol
        found = np.where(after[:-1] >= 0, self.first[data[:-1], data[1:]], -1)
        at = np.flatnonzero(found >= 0)
        at = at[np.argsort(found[at], kind="stable")]
        ranks, heads = np.unique(found[at], return_index=True)
        index = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(at, heads[1:]), strict=True)} if len(at) else {}
        after, before, pair = after.tolist(), before.tolist(), self.pairs.get
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            todo = index.pop(rank, None)
            if todo is None:
                continue
            todo.sort()
            for k, left in enumerate(todo):
                right = after[left]
                a = symbols[left]
                if a < 0 or right < 0 or pair((a << _SHIFT) | symbols[right]) != rank:
                    continue  # a neighbour's merge has taken one of the two
                symbols[left], symbols[right] = rank, -1
                beyond = after[left] = after[right]
                lower = False
                if beyond >= 0:
                    before[beyond] = left
                    r = pair((rank << _SHIFT) | symbols[beyond])
                    if r is not None:
                        if r in index:
                            index[r].append(left)
                        else:
                            index[r] = [left]
                            heappush(heap, r)
                        lower = r < rank
                prior = before[left]
                if prior >= 0:
                    r = pair((symbols[prior] << _SHIFT) | rank)
                    if r is not None:
                        if r in index:
                            index[r].append(prior)
                        else:
                            index[r] = [prior]
                            heappush(heap, r)
                        lower = lower or r < rank
                if lower:  # an earlier rank has appeared: it goes first
                    if k + 1 < len(todo):
                        index.setdefault(rank, []).extend(todo[k + 1 :])
                        heappush(heap, rank)
                    break
        return symbols


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.table = MergeTable.load(path)
        single = {bytes([b]): b for b in range(256)}

        def matches(pattern: str, text: str) -> str:
            return bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)).decode()

        self.classes = pieces.class_table(matches)
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        words, first = pieces.split(texts, self.classes, spaced=True)
        known = self.words
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > WORD_TABLE:
                known.clear()
                new = list(set(words))
            known.update(zip(new, self.table.replay([w.encode() for w in new]), strict=True))
        ids = list(map(known.__getitem__, words))
        return [b"".join(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _decimals(path: str) -> dict[int, bytes]:
    return {i: b"%d" % i for i in encoder(path).table.tokens}


def encode(docs: DataFrame, path: str, column: str = "text", to: str = "ids") -> DataFrame:
    """docs without `column`, with its token ids in `to` (array<int>)."""
    names = [c for c in docs.columns if c not in (column, to)]
    kinds = dict(docs.dtypes)

    def run(batches):
        e = encoder(path)
        for block in blocks(batches, column):
            ids = [np.frombuffer(x, "<u4") for x in e.encode([t or "" for t in block.column(column).to_pylist()])]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[*names, to])

    return docs.select(*names, column).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{to}` array<int>"]))


def decode(encoded: DataFrame, path: str, column: str = "ids", to: str = "bytes") -> DataFrame:
    """encoded without `column`, with the bytes of its ids in `to`; null ids give null."""
    names = [c for c in encoded.columns if c not in (column, to)]
    kinds = dict(encoded.dtypes)

    def run(batches):
        e = encoder(path)
        for batch in batches:
            out = [None if x is None else e.decode(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, to])

    return encoded.select(*names, column).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{to}` binary"]))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, from its encoded and decoded text."""

    def run(batches):
        e, decimals = encoder(path), _decimals(path)
        for block in blocks(batches):
            n, ids_sha, text_sha = [], [], []
            for packed in e.encode([t or "" for t in block.column("text").to_pylist()]):
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(decimals.__getitem__, ids))).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
