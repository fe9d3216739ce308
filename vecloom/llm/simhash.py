"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints: a bit is set if it is set in over half of the XXH64 values of a
document's word shingles. Documents link at RADIUS or fewer differing bits.

Candidates: each of the 64 bit positions gets a nonzero vector of RADIUS + 1 bits.
For each nonzero v of RADIUS + 1 bits, one table keeps the positions whose vector
has an odd overlap with v. Any RADIUS vectors have a common v that is orthogonal to
all of them, so two fingerprints that differ in at most RADIUS positions agree on
one of the 2 ** (RADIUS + 1) - 1 tables: no pair is missed.

Decision, for a radius of 2, without pairs: within a shared bucket two
fingerprints differ only in the free positions, and they are at most two apart
exactly if some value is at most one bit from both. So each candidate stands at
itself and at its one-bit neighbours in free positions; all that meet at a value
link to the smallest of them. Rows grow with fingerprints, not with pairs.

Joins carry merge hints: their smaller sides grow with the documents, so none may
become a broadcast. Equal fingerprints are one node from the start, so copies cost one row.

Defined results: a null, empty or white-space text has fingerprint zero and links
like any other; a null doc_id is the largest and gets its component's smallest
doc_id (null if all are null); repeated rows are one node; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import PARTS, blocks, ids_and_texts, keep_rows, stored, text_buffers, text_tag, tidy, with_group
from vecloom.llm.components import connected_components

BITS = 64
#: Words of a shingle, seed of its hash, and differing bits that still link.
SHINGLE, SEED, RADIUS = 3, 42, 2


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text, unsigned."""
    return int(_fingerprints([text], shingle, seed)[0])


def _fingerprints(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: only A-Z and ASCII white space
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        if len(words) <= shingle:
            spans = [(0, len(line))]
        else:
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        h = np.array([digest(line[a:b], seed) for a, b in spans], np.uint64)
        count = np.zeros(BITS, np.int64)
        for k in range(0, len(h), 1 << 15):
            part = h[k : k + (1 << 15)]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * count > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text tag and fp (signed 64 bits) of every row."""

    def run(batches):
        for block in blocks(batches):
            data, off = text_buffers(block.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("tag"), pa.array(_fingerprints(texts, shingle, seed).view(np.int64))], names=["doc_id", "tag", "fp"])

    return ids_and_texts(docs).withColumn("tag", text_tag()).mapInArrow(tidy(run), "doc_id long, tag long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The kept positions of each table, as signed 64-bit numbers."""
    span = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, span + 1):
        m = sum(1 << i for i in range(BITS) if (v & (i % span + 1)).bit_count() % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64) if bit == 63 else 1 << bit


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect all pairs at most two bits apart."""
    masks = covering_masks(2)
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)]))
    banded = nodes.select("fp", tables.alias("t")).select("fp", "t.band", "t.key")
    shared = banded.groupBy("band", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("band", "key")
    free_of = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("band") + 1)
    candidates = banded.join(shared.hint("merge"), ["band", "key"]).groupBy("fp").agg(F.bit_or(free_of).alias("free"))
    flips = F.filter(F.array(*[F.lit(_signed(i)) for i in range(BITS)]), lambda b: F.col("free").bitwiseAND(b) != 0)
    met = candidates.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("flip"))
    met = met.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    lowest = met.groupBy("at").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("at", "lo")
    return met.join(lowest.hint("merge"), "at").filter("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    labelled, _ = _labelled(docs, shingle, seed)
    return labelled.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (a null one is the largest)."""
    labelled, component = _labelled(docs, shingle, seed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag"))
    several = labelled.groupBy(component).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(component)
    doubtful = labelled.join(several.hint("merge"), component, "left_semi").select("tag").distinct()
    return keep_rows(docs, labelled.groupBy(component).agg(first.alias("first")).select("first.doc_id", "first.tag"), doubtful)


def _labelled(docs: DataFrame, shingle: int, seed: int) -> tuple[DataFrame, str]:
    prints = stored(fingerprints(docs, shingle, seed))
    dealt = prints.withColumn("part", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(PARTS)).cast("int"))
    nodes = dealt.groupBy("fp", "part").agg(F.min("doc_id").alias("least"))
    nodes = nodes.groupBy("fp").agg(F.min("least").alias("least"), F.collect_list("part").alias("parts"))
    found = connected_components(links(nodes.select("fp")))
    member = nodes.join(found.hint("merge"), nodes["fp"] == found["node"], "left").select("fp", "least", "parts", F.coalesce("component", "fp").alias("component"))
    # a component's smallest doc_id goes back to its fingerprints, and from there to each one's parts
    labels = with_group(stored(member), ["component"], {"low": F.min("least")}, {"component_id": F.min("low")}, "fp")
    labels = labels.select("fp", "component", "component_id", F.explode("parts").alias("part"))
    return dealt.join(labels.hint("merge"), ["fp", "part"]).drop("part"), "component"
