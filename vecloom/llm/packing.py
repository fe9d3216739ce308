"""Best-fit packing of tokenised documents by patterns and non-negative least squares.

Documents become pieces of at most CAPACITY tokens. Only the histogram of piece
lengths (CAPACITY numbers at most, whatever the corpus) reaches the driver. There

1. all patterns of up to DEPTH length bins that fill a sequence are enumerated;
2. repeat counts are fitted to the histogram by non-negative least squares and
   rounded down, and the bins' real lengths are dealt to the patterns in order;
3. what is left is packed best-fit decreasing, first into the room that the
   patterns leave, then into new sequences, whole groups of equal lengths at once.

The result is a list of exact patterns with repeat counts. A piece finds its place
from its length and its number among all pieces of that length, which comes from
counts by partition; pieces are never collected or sorted in one place.

Defined results: a null or empty text has no ids of its own but still its end id;
null and repeated doc_ids are packed like any other row; other columns are
ignored; no rows give no rows. Strings of special tokens in a text are ordinary.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm import pieces
from vecloom.llm.common import blocks, cut_lineage, ids_and_texts, tidy

CAPACITY = 4096
END_ID = 1
#: Length bins and documents of the fitted patterns; shorter pieces than LEAST fill the gaps.
BINS, DEPTH, LEAST = 128, 3, 800
#: Bins that a fitted pattern leaves open: best fit closes them with pieces of just that length.
GAP = 24
WORD_TABLE = 400_000
#: Text bytes of a block: its list of words takes a multiple of them.
BLOCK = 1 << 19


@lru_cache(maxsize=2)
def classes(path: str) -> bytes:
    """The class table of the file's own split pattern (zlib); made on the driver."""
    from tokenizers import Regex, pre_tokenizers

    def matches(pattern: str, text: str) -> str:
        parts = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)
        return "".join(p for p, _ in parts)

    return zlib.compress(pieces.class_table(matches).tobytes())


class WordTokenizer:
    """Ids of whole texts from the model's ids of their distinct words."""

    def __init__(self, path: str, table: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = np.frombuffer(zlib.decompress(table), np.uint8)
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the stand-in character of each byte, read off two-byte characters
        self.letters = {}
        for code in range(0x800):
            shown = level.pre_tokenize_str(chr(code))[0][0]
            self.letters.update(zip(chr(code).encode(), shown, strict=True))
        for code in (0x800, 0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xD000, 0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000):
            shown = level.pre_tokenize_str(chr(code))[0][0]
            self.letters.update(zip(chr(code).encode(), shown, strict=True))
        self.words: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        # lower case by single characters: no final sigma
        plain = [(t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ")).lower() for t in texts]
        words, first = pieces.split(plain, self.table, spaced=False)
        known = self.words
        new = set(words).difference(known)
        if len(known) + len(new) > WORD_TABLE:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self._ids(w)
        ids = list(map(known.__getitem__, words))
        return [b"".join(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def tokenizer(path: str, table: bytes) -> WordTokenizer:
    return WordTokenizer(path, table)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces."""
    table = classes(path)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = tokenizer(path, table).encode
        for block in blocks(batches, size=BLOCK):
            out, ids = [], []
            for doc_id, packed in zip(block.column("doc_id").to_pylist(), encode([t or "" for t in block.column("text").to_pylist()]), strict=True):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return ids_and_texts(docs).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def patterns(total: int, depth: int, least: int = 1) -> list[tuple[int, ...]]:
    """All ways to write total as a sum of at most depth numbers, each at least `least`, in rising order."""
    out = [(total,)]
    if depth > 1:
        for first in range(least, total // 2 + 1):
            out += [(first, *rest) for rest in patterns(total - first, depth - 1, first)]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with the least |a @ x - b|, by an active set of columns."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= limit or len(active) >= a.shape[0]:
            break
        active.append(best)
        while True:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z > 0).all():
                break
            now = x[active]
            down = z <= 0
            step = (now[down] / np.maximum(now[down] - z[down], 1e-300)).min()
            now = now + step * (z - now)
            x[:] = 0
            keep = now > 1e-12
            if not keep.any():
                active = []
                break
            x[[c for c, k in zip(active, keep, strict=True) if k]] = now[keep]
            active = [c for c, k in zip(active, keep, strict=True) if k]
        x[:] = 0
        if active:
            x[active] = z
    return x


def _fitted(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Exact patterns of real lengths with repeat counts, and the lengths' counts that stay."""
    left = counts.copy()
    grain = -(-capacity // BINS)
    total = capacity // grain
    bin_of = -(-np.arange(capacity + 1) // grain)
    # a bin stands for its longest length, so a full pattern never exceeds the capacity
    use = np.arange(capacity + 1) >= min(LEAST, capacity)
    bulk = np.bincount(bin_of, np.where(use, counts, 0), minlength=total + 1)[: total + 1]
    if bulk.sum() < 2:
        return [], left
    choice = [p for p in patterns(max(total - GAP, 1), DEPTH) if bulk[list(p)].min() >= 1]
    if not choice:
        return [], left
    a = np.zeros((total + 1, len(choice)))
    for j, p in enumerate(choice):
        for b in p:
            a[b, j] += 1
    x = nnls(a, bulk.astype(float))
    out: list[tuple[tuple[int, ...], int]] = []
    queue = {b: [n for n in range(int(b) * grain, (int(b) - 1) * grain, -1) if n <= capacity and use[n] and left[n]] for b in range(1, total + 1)}

    def take(b: int, n: int) -> list[list[int]]:
        runs = []
        while n:
            length = queue[b][-1]
            k = min(n, int(left[length]))
            left[length] -= k
            n -= k
            runs.append([length, k])
            if not left[length]:
                queue[b].pop()
        return runs

    for j in np.argsort(-x, kind="stable"):
        p = choice[j]
        room = [sum(int(left[n]) for n in queue[b]) // p.count(b) for b in set(p)]
        repeat = min(int(x[j]), *room)
        if repeat < 1:
            continue
        # the longest lengths of one bin meet the shortest of the others
        slots = [take(b, repeat)[:: 1 if i % 2 else -1] for i, b in enumerate(p)]
        while slots[0]:
            n = min(s[0][1] for s in slots)
            out.append((tuple(s[0][0] for s in slots), n))
            for s in slots:
                s[0][1] -= n
                if not s[0][1]:
                    s.pop(0)
    return out, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: of pieces `length` from number `first` on, number
    first + i stands at `offset` in sequence `sequence` + i. Sorted by length and first.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    exact, left = _fitted(counts, capacity)
    nodes: list[tuple[int, int, int]] = []  # of a sequence's content: what stands before, length, how many of it
    open_at: dict[int, list[list[int]]] = {}  # free room -> [last node, sequences]
    rooms: list[int] = []

    def put(room: int, node: int, n: int) -> None:
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append([node, n])

    for lengths, n in exact:
        node = -1
        for length in lengths:
            nodes.append((node, length, 1))
            node = len(nodes) - 1
        put(capacity - sum(lengths), node, n)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                for k, sequences in ((each, n // each), (n % each, 1)):
                    if k and sequences:
                        nodes.append((-1, length, k))
                        put(capacity - k * length, len(nodes) - 1, sequences)
                n = 0
                continue
            room = rooms[at]
            groups = open_at[room]
            node, sequences = groups.pop()
            if not groups:
                del open_at[room], rooms[at]
            k = min(room // length, max(n // sequences, 1))
            used = min(sequences, n // k)
            nodes.append((node, length, k))
            put(room - k * length, len(nodes) - 1, used)
            if used < sequences:
                put(room, node, sequences - used)
            n -= used * k
    rows: list[tuple[int, int, int, int]] = []
    dealt = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for room in rooms:
        for node, n in open_at[room]:
            path = []
            while node >= 0:
                before, length, k = nodes[node]
                path += [length] * k
                node = before
            offset = 0
            for length in reversed(path):
                rows.append((length, int(dealt[length]), sequence, offset))
                dealt[length] += n
                offset += length
            sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T, strict=True)) | {"sequences": np.array([sequence])}


def _numbered(capacity: int):
    def run(batches):
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)
            sizes = np.diff(np.append(heads, len(ranked)))
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(ranked)) - np.repeat(heads, sizes) + seen[ranked]
            seen[ranked[heads]] += sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "number"])

    return run


def _placed(found: dict[str, np.ndarray]):
    shift = 44
    keys = (found["length"] << shift) | found["first"]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(keys, (length << shift) | number, side="right") - 1
            names = [n for n in batch.schema.names if n not in ("number", "before", "part")]
            sequence = found["sequence"][at] + number - found["first"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(found["offset"][at])], names=[*names, "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    cut = cut_lineage(cut_pieces(docs, path, capacity, end_id, with_ids).withColumn("part", F.spark_partition_id()))
    kinds = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    counts = cut_lineage(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = plan(histogram, capacity)
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.mapInArrow(_numbered(capacity), f"{kinds}, number long")
    out = ", ".join(f"{n} {t}" for n, t in cut.dtypes if n != "part")
    return numbered.join(before, ["part", "length"]).select(*cut.columns, "number", "before").mapInArrow(_placed(found), f"{out}, sequence_id long, offset long")
