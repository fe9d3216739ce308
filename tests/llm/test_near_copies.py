"""Near copies of the pipeline's stage against all pairs of texts."""

import random

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from vecloom.llm import near_copies as N


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Unlike texts, and copies of them with a few words changed: most similarities lie between 0.7 and 1."""
    rng = random.Random(11)
    rows, i = [(None, "Alone and without an id, " * 3), (1, None), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one two three")], 100
    licence = " ".join(f"licence{k}" for k in range(40))
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 40, 150, 400]))]
        rows.append((i, " ".join(words)))
        for _ in range(rng.randrange(4)):
            i += 1
            copy = list(words)
            for _ in range(rng.randrange(1, max(2, len(words) // 35))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((i, " ".join(copy)))
        if rng.random() < 0.5:
            rows.append((i + 1, rows[-1][1] + " " + licence))
        i += 2
    return rows


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    seen = []
    for i in range(len(rows)):
        for j in range(i):
            s = similarity(sets[i], sets[j])
            if s >= 0.8:
                seen.append(s)
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    best = {}
    for p, (i, t) in zip(part, rows, strict=True):
        key = (i is None, i or 0)
        best[p] = min(best.get(p, (key, t)), (key, t), key=lambda x: x[0])
    return sorted((i if not missing else -1) for (missing, i), _ in best.values()), seen


def test_stage_equals_all_pairs(spark, tmp_path):
    rows = planted()
    want, seen = brute(rows)
    assert sum(0.8 <= s < 0.95 for s in seen) > 30 and len(want) < len(rows) - 40
    docs = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])).repartition(3)
    got = P.near(spark, docs, "").collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == want


def test_similarities_and_no_rows(none):
    rows = planted()
    left, right = [t for _, t in rows[:-1]], [t for _, t in rows[1:]]
    got = N.similarities(pa.array(left), pa.array(right))
    assert np.array_equal(got, [similarity(shingles(a), shingles(b)) for a, b in zip(left, right, strict=True)])
    assert N.drop_near_copies(none).count() == 0


def test_large_clusters_and_common_lines(spark):
    rng = random.Random(2)
    line = " ".join(f"common{k}" for k in range(30))
    base = [f"b{k}" for k in range(300)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(150)]
    rows += [(1000 + k, f"{line} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(20))) for k in range(150)]
    got = {r["doc_id"] for r in N.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0} | set(range(1000, 1150))


def test_group_of_partly_similar_texts(spark):
    """A group beyond COMMON texts: some of its pairs are similar, others stay in different components."""
    rng = random.Random(4)
    rows = []
    for group, size in ((0, 70), (1, 30)):
        base = [f"g{group}w{k}" for k in range(300)]
        for k in range(size):
            text = list(base)
            for at in rng.sample(range(300), rng.randrange(1, 9)):
                text[at] = f"new{rng.randrange(10**6)}"
            rows.append((1000 * group + k, " ".join(text)))
    want, seen = brute(rows)
    assert 10 < len(want) < len(rows) - 2 * N.COMMON and 100 < len(seen) < 2000, (len(want), len(seen))
    got = sorted(r["doc_id"] for r in N.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == want
