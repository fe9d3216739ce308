"""Near copies by the Jaccard similarity of their word shingles, found exactly.

Two texts are near copies if their sets of shingles (words as in SimHash, compared
by 64-bit hashes) have a similarity of at least SIMILARITY; components of such pairs
keep one row. No SimHash radius bounds this similarity, least of all in short texts,
so the covering tables only give the first candidates and the rest is found whole:

1. Prefixes: all sets are put in one order, common shingles last. Of n shingles two
   similar sets share at least SIMILARITY * n, so they share one of the first
   n - SIMILARITY * n + 1 of either. Texts that share such a shingle form a group.
2. Stars: each text of a group is paired with the group's first one, and covering
   links and equal fingerprints give further pairs. All are verified, on outlines of
   their sets first, then on their texts. This settles clusters of copies, and grows
   with the texts, not with pairs.
3. Rounds: in groups whose texts still stand in different components, each text is
   paired with a text of the group that another order of the whole group puts first,
   ROUNDS times. This joins large clusters of which only some pairs are similar.
4. Others: pairs of one group that still stand in different components are verified
   too, so no link between texts is lost. In steps 3 and 4, pairs must pass bounds on
   sizes, places and sketches (outlines of a fixed size) before they leave the join.

A shingle is common if it stands in more than COMMON texts, so other groups have
COMMON texts at most and step 4 grows with the texts. Common ones stand in a bit table
of fixed size, which decides cost only; their groups are dealt to SALTS parts, and in
step 4 to one for every PART rows. Texts that consist of common shingles to over
SIMILARITY and stand in different components after step 3 are compared by their
sketches: these comparisons grow with the square of a group, and so do the pairs
(16 bytes each) whose sketches leave it open.

Defined results: texts without words are alike; texts of fewer words than a shingle
have one shingle; of a component the row with the smallest doc_id stays (a null one
is the largest); equal texts are one node. Other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import bit_table, blocks, drop_stored, ids_and_texts, in_table, keep_rows, mix, sieve, sieved, stored, text_buffers, text_tag, tidy, word_spans
from vecloom.llm.components import connected_components
from vecloom.llm.simhash import SEED, fingerprints, links

#: Words of a shingle, and the least similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Texts that share a shingle from which on it is common, and parts of a common shingle's group.
COMMON, SALTS = 16, 32
#: Hashes below it are counted (35 %; without common ones, prefixes reach 20 %), and orders that a group's first text is chosen by.
COUNTED, CENTRES = np.uint64(35 * (1 << 64) // 100), 4
#: Words of 64 bits of a sketch, rounds in which a group's texts meet a centre, and rows of a group for each part of its pairs.
WORDS, ROUNDS, PART = 8, 3, 256
#: Text bytes of a block: the sorts of its shingles take a multiple of them.
BLOCK = 1 << 19

_BYTE_CODE = np.random.default_rng(20250817).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a run of one hash from which on it is handled in parts.
_LONG = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[:1] = 1
    return np.cumprod(out)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes, without the tables of `common` (a worker would keep them)."""
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(word)) - first[word]
    return mix(np.add.reduceat(_BYTE_CODE[data[starts[word] + place]] * _powers(int(size.max()))[place], first) + size.astype(np.uint64))


def _run_hashes(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    h = np.full(len(at), np.uint64(length))
    for k in range(length):
        h = mix(h * _BASE + codes[at + k])
    return h


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each row's distinct shingles, by row, then hash; one shingle a row at least."""
    data, off = text_buffers(column)
    data = _LOWER[data]
    starts, ends, first = word_spans(data, off)
    n = np.diff(first)
    codes = _word_hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    row, h = [np.flatnonzero(n == 0)], [np.zeros(int((n == 0).sum()), np.uint64)]
    for length in range(1, shingle):
        short = np.flatnonzero(n == length)
        if len(short):
            row.append(short)
            h.append(_run_hashes(codes, first[short], length))
    if (n >= shingle).any():
        of_word = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(np.arange(len(codes)) + shingle <= first[1:][of_word])
        row.append(of_word[at])
        h.append(_run_hashes(codes, at, shingle))
    return _distinct(np.concatenate(row), np.concatenate(h))


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def similarities(left: pa.Array, right: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each row's two texts."""
    (i, a), (j, b) = shingle_sets(left, shingle), shingle_sets(right, shingle)
    row, h = np.concatenate((i, j)), np.concatenate((a, b))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=len(left))
    return both / (np.bincount(i, minlength=len(left)) + np.bincount(j, minlength=len(left)) - both)


def _tagged(docs: DataFrame) -> DataFrame:
    return ids_and_texts(docs).select(text_tag().alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def _outlines(texts: DataFrame, table: np.ndarray, shingle: int) -> DataFrame:
    """tag, size and outline of each text: bit i tells if an odd number of its shingles falls in cell i.

    The cells are the power of two from the set's size on, so an outline is far smaller than its text.
    """

    def run(batches):
        # sieved in the same worker: two in a task would double the memory
        for block in _new_texts(sieved(batches, "tag", table)):
            row, h = shingle_sets(block.column("text"), shingle)
            size = np.bincount(row, minlength=block.num_rows)
            cells = np.maximum(128, 1 << np.ceil(np.log2(size)).astype(np.int64))
            first = np.cumsum(cells) - cells
            odd = np.bincount(first[row] + (h & (cells[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(cells.sum())) & 1
            raw = np.packbits(odd.astype(bool), bitorder="little").tobytes()
            parts = [raw[a // 8 : (a + n) // 8] for a, n in zip(first.tolist(), cells.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("tag"), pa.array(size.astype(np.int32)), pa.array(parts, pa.binary())], names=["tag", "size", "outline"])

    return texts.mapInArrow(tidy(run), "tag long, size int, outline binary").dropDuplicates(["tag"])


def least_difference(left: bytes, right: bytes) -> int:
    """A number of shingles that stand in one of two sets only, at least, from their outlines."""
    x, y, n, m = int.from_bytes(left, "little"), int.from_bytes(right, "little"), len(left), len(right)
    if n < m:
        x, y, n, m = y, x, m, n
    while n > m:
        n //= 2
        x = (x ^ (x >> (8 * n))) & ((1 << (8 * n)) - 1)
    return (x ^ y).bit_count()


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of text tags whose texts are similar; outlines rule most others out before texts move."""

    def ends_of(pairs):
        return pairs.select(F.explode(F.array("a", "b")).alias("tag")).distinct()

    def joined(pairs, ends, value):
        left = ends.select(F.col("tag").alias("a"), *[F.col(v).alias(f"left_{v}") for v in value])
        right = ends.select(F.col("tag").alias("b"), *[F.col(v).alias(f"right_{v}") for v in value])
        return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    def outlined(batches):
        for batch in batches:
            total = batch.column("left_size").to_numpy().astype(np.float64) + batch.column("right_size").to_numpy()
            least = [least_difference(x, y) for x, y in zip(batch.column("left_outline").to_pylist(), batch.column("right_outline").to_pylist(), strict=True)]
            # of sizes that sum to t, similar sets differ in at most t * (1 - s) / (1 + s) elements
            yield batch.select(["a", "b"]).filter(pa.array(np.array(least, np.float64) <= total * (1 - similarity) / (1 + similarity) + 1e-6))

    def judge(batches):
        for block in blocks(batches, "left_text", BLOCK // 2):
            ok = similarities(block.column("left_text"), block.column("right_text"), shingle) >= similarity
            yield block.select(["a", "b"]).filter(pa.array(ok))

    outlines = _outlines(_tagged(docs), bit_table(ends_of(pairs)), shingle)
    likely = stored(joined(pairs, outlines, ("size", "outline")).mapInArrow(tidy(outlined), "a long, b long"))
    ends = ends_of(likely)
    whole = sieve(_tagged(docs), "tag", bit_table(ends)).join(ends.hint("merge"), "tag", "left_semi").dropDuplicates(["tag"])
    return joined(likely, whole, ("text",)).mapInArrow(tidy(judge), "a long, b long")


def _covering_pairs(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Pairs (a, b) of text tags within the covering tables' radius, as a star in each meeting."""
    prints = stored(fingerprints(docs, shingle, seed).select("tag", "fp").distinct())
    least = prints.groupBy("fp").agg(F.min("tag").alias("low"))
    same = prints.join(least.hint("merge"), "fp").filter("tag <> low").select(F.col("tag").alias("a"), F.col("low").alias("b"))
    met = links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("low").alias("x")).hint("merge"), "a")
    met = met.join(least.select(F.col("fp").alias("b"), F.col("low").alias("y")).hint("merge"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.union(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _new_texts(batches):
    """Blocks without the rows that repeat a tag within them."""
    for block in blocks(batches, size=BLOCK):
        _, first = np.unique(block.column("tag").to_numpy(zero_copy_only=False), return_index=True)
        yield block if len(first) == block.num_rows else block.take(pa.array(np.sort(first)))


def _runs(batches):
    """Batches sorted by h, as tables that hold whole runs of equal h; a run of over a batch comes in parts."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        h = table.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
        if cut or len(h) > _LONG:
            cut = cut or len(h) - 1
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()[0] if len(h) else None
    if held is not None:
        yield pa.Table.from_batches([held])


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Bit table of the shingles in the COUNTED range of hashes that stand in more than COMMON texts."""

    def count(batches):
        for block in _new_texts(batches):
            _, h = shingle_sets(block.column("text"), shingle)
            h, n = np.unique(h[h < COUNTED], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    def many(batches):
        last, before = None, 0
        for table in _runs(batches):
            h = table.column("h").to_numpy()
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            total = np.add.reduceat(table.column("n").to_numpy().astype(np.int64), first)
            if h[0] == last:
                total[0] += before
            last, before = h[-1], int(total[-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[first[total > COMMON]])], names=["h"])

    counted = _tagged(docs).mapInArrow(tidy(count), "h long, n int").repartition("h").sortWithinPartitions("h").mapInArrow(tidy(many), "h long")
    # the highest bit is 0: one place on, so that more of the table is used
    return bit_table(counted.select(F.shiftleft("h", 1).alias("h")))


_PREFIX = "h long, part int, rank int, tag long, size int, place int"


def _prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """h, part, rank, tag, size, place of each text's prefix shingles.

    part deals a common shingle's texts to SALTS groups (SALTS itself: one group), rank orders a group
    by one of CENTRES orders of all texts.
    """
    common = _common(docs, shingle)

    def run(batches):
        for block in _new_texts(batches):
            row, h = shingle_sets(block.column("text"), shingle)
            late = (h < COUNTED) & in_table(common, h << np.uint64(1))
            order = np.lexsort((h, late, row)) if late.any() else slice(None)  # by hash within each row already
            row, h, late = row[order], h[order], late[order]
            size = np.bincount(row, minlength=block.num_rows)
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            keep = place <= size[row] - np.ceil(similarity * size[row] - 1e-9)
            row, h, late, place = row[keep], h[keep], late[keep], place[keep]
            tag = block.column("tag").to_numpy(zero_copy_only=False)[row]
            part = np.where(late, mix(tag.view(np.uint64)) % np.uint64(SALTS), np.uint64(SALTS)).astype(np.int32)
            rank = (mix(tag.view(np.uint64) + h % np.uint64(CENTRES)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), part, rank, tag, size[row].astype(np.int32), place.astype(np.int32))], names=["h", "part", "rank", "tag", "size", "place"])

    return _tagged(docs).mapInArrow(tidy(run), _PREFIX)


def _possible(similarity: float, size: str, place: str, other_size: str, other_place: str) -> Column:
    """Can two sets of these sizes that share the elements at these places be similar? (In a common order.)"""
    low, high = F.least(size, other_size), F.greatest(size, other_size)
    most = F.least(place, other_place) + F.least(F.col(size) - F.col(place), F.col(other_size) - F.col(other_place))
    return (low >= similarity * high - 1e-6) & (most * (1 + similarity) >= similarity * (low + high) - 1e-6)


def _met(prefixes: DataFrame) -> DataFrame:
    """The prefix rows that meet another one, with the first of their group (low, low_size, low_place)."""

    def run(batches):
        last, centre = None, None
        for table in _runs(batches):
            h, part, tag, size, place = (table.column(c).to_numpy() for c in ("h", "part", "tag", "size", "place"))
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
            low = [x[first] for x in (tag, size, place)]
            met = (np.diff(np.append(first, len(h))) > 1)[group] | (part < SALTS)
            if h[0] == last:  # the rest of a long run
                met[group == 0] = True
                for x, c in zip(low, centre, strict=True):
                    x[0] = c
            elif len(table) > _LONG:  # its first part
                met[:] = True
            last, centre = h[-1], [x[-1] for x in low]
            low = [x[group][met] for x in low]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[met], part[met], tag[met], size[met], place[met], *low)], names=["h", "part", "tag", "size", "place", "low", "low_size", "low_place"])

    dealt = prefixes.repartition("h", "part").sortWithinPartitions("h", "rank")
    return dealt.mapInArrow(tidy(run), "h long, part int, tag long, size int, place int, low long, low_size int, low_place int")


def _star_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of every text and the first of each of its groups."""
    fit = met.filter("tag <> low").filter(_possible(similarity, "size", "place", "low_size", "low_place"))
    return fit.select(F.least("low", "tag").alias("a"), F.greatest("low", "tag").alias("b"))


_ROW = ["h", "part", "tag", "size", "place"]
_SKETCH = [f"sketch{k}" for k in range(WORDS)]
_SIDE = ["tag", "size", "place", "component", *_SKETCH]


def _open(rows: DataFrame, component: DataFrame) -> DataFrame:
    """The rows of groups whose texts stand in different components, with the component, and the parts that
    the group's pairs are dealt to."""
    rows = rows.drop("component", "parts")
    named = rows.join(component.hint("merge"), rows["tag"] == component["node"], "left").select(*rows.columns, F.coalesce("component", "tag").alias("component"))
    groups = named.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.collect_set("part").alias("dealt"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    parts = (F.lit(1) + F.floor(F.col("n") / PART)).cast("int").alias("parts")
    return named.join(groups.select("h", F.explode("dealt").alias("part"), parts).hint("merge"), ["h", "part"])


def _sketched(rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """rows with their texts' sketches: outlines of a fixed WORDS * 64 cells, as long columns."""

    def run(batches):
        for block in _new_texts(batches):
            row, h = shingle_sets(block.column("text"), shingle)
            odd = np.bincount(row * (WORDS * 64) + (h % np.uint64(WORDS * 64)).astype(np.int64), minlength=block.num_rows * WORDS * 64) & 1
            words = np.packbits(odd.astype(bool), bitorder="little").view(np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([block.column("tag"), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(WORDS)]], names=["tag", *_SKETCH])

    sketches = _tagged(texts).mapInArrow(tidy(run), ", ".join(["tag long", *[f"{c} long" for c in _SKETCH]])).dropDuplicates(["tag"])
    return rows.join(sketches.hint("merge"), "tag")


def _worth(both: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the joined rows in different components that may be similar by sizes, places and sketches."""
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in _SKETCH), F.lit(0))
    fit = both.filter("component <> other_component").filter(_possible(similarity, "size", "place", "other_size", "other_place"))
    # as for outlines in _verified
    fit = fit.filter(differ * (1 + similarity) <= (F.col("size") + F.col("other_size")) * (1 - similarity) + 1e-6)
    return fit.select(F.least("tag", "other_tag").alias("a"), F.greatest("tag", "other_tag").alias("b"))


def _centre_pairs(rows: DataFrame, number: int, similarity: float) -> DataFrame:
    """Pairs of each group's texts and one of them, another one in each round and group."""
    order = F.xxhash64("tag", "h", F.lit(number)).alias("order")
    centre = rows.groupBy("h").agg(F.min(F.struct(order, *_SIDE)).alias("centre"), F.collect_set("part").alias("dealt"))
    centre = centre.select("h", F.explode("dealt").alias("part"), *[F.col(f"centre.{c}").alias(f"other_{c}") for c in _SIDE])
    return _worth(rows.join(centre.hint("merge"), ["h", "part"]), similarity)


def _other_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs that share a prefix shingle."""
    here = rows.withColumn("part", F.pmod(F.xxhash64("tag"), F.col("parts")).cast("int"))
    other = rows.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"other_{c}") for c in _SIDE])
    return _worth(here.join(other.hint("merge"), ["h", "part"]).filter("tag < other_tag"), similarity)


def components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """node (text tag) and component of all texts that have near copies, but for the component's own tag."""
    met = stored(_met(_prefixes(docs, shingle, similarity)))
    tried = stored(_covering_pairs(docs, shingle, seed).union(_star_pairs(met, similarity)).distinct())
    settled = connected_components(_verified(docs, tried, shingle, similarity))
    rows = stored(_open(met.select(_ROW), settled))
    drop_stored(met)
    tagged = ids_and_texts(docs).withColumn("tag", text_tag())
    texts = stored(sieve(tagged, "tag", bit_table(rows.select("tag"))).select("doc_id", "text"))
    rows = stored(_sketched(rows, texts, shingle), rows)
    for number in range(ROUNDS + 1):
        if rows.isEmpty():
            break
        pairs = _centre_pairs(rows, number, similarity) if number < ROUNDS else _other_pairs(rows, similarity)
        pairs = stored(pairs.distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            drop_stored(pairs)
            continue
        stars = settled.select(F.col("node").alias("a"), F.col("component").alias("b"))
        settled = connected_components(stars.union(_verified(texts, pairs, shingle, similarity)))
        tried = stored(tried.union(pairs), tried)
        if number < ROUNDS:
            rows = stored(_open(rows, settled), rows)
    for done in (rows, texts, tried):
        drop_stored(done)
    return settled


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (a null one is the largest)."""
    found = stored(components(docs, shingle, similarity, seed))
    nodes = ids_and_texts(docs).select("doc_id", text_tag().alias("tag"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag"))
    own = nodes.join(found.hint("merge"), nodes["tag"] == found["node"], "left").groupBy(F.coalesce("component", "tag")).agg(first.alias("first"))
    repeated = nodes.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tag")
    return keep_rows(docs, own.select("first.doc_id", "first.tag"), found.select("node").union(found.select("component")).union(repeated))
