"""Substring, exact and near dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from vecloom.llm import exact_dedup as E
from vecloom.llm import simhash as H
from vecloom.llm import substring_dedup as S
from vecloom.llm.components import connected_components


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def brute_substring(texts, window=50):
    first, all_words = {}, []
    for i, t in texts:
        w = (t or "").encode().split()
        all_words.append((i, w))
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in all_words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[(i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


def test_substring_edge_cases(edge, texts):
    assert counted(S.substring_dedup(edge, digest=True)) == brute_substring(texts)


def test_substring_texts_and_runs(edge, texts):
    for r in S.substring_dedup(edge).collect():
        if r["removed_runs"]:
            a = r["removed_runs"]
            assert sum(e - s for s, e in zip(a[::2], a[1::2], strict=True)) == r["n_removed"]
        assert len(bytes(r["kept_text"]).split()) == r["n_words"] - r["n_removed"]


def test_cover_holds_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_substring_passages_at_every_alignment(spark):
    rng = random.Random(1)
    passage = [f"p{rng.randrange(1000)}" for _ in range(50)]
    texts = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(i)] + passage + ["end"])) for i in range(70)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert counted(S.substring_dedup(df, digest=True)) == brute_substring(texts)


def thue_morse(n):
    """A word of 2 ** n letters and its complement: equal under any polynomial hash modulo 2 ** 64 from n = 10 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_substring_words_that_collide(spark):
    shared = " ".join(f"s{k}" for k in range(49))
    x, y = thue_morse(10)
    texts = [(1, f"{shared} {x}"), (2, f"{shared} {y}"), (3, f"{shared} {x}")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = counted(S.substring_dedup(df, digest=True))
    assert got == brute_substring(texts) and sorted(r[2] for r in got) == [0, 0, 50]


def test_substring_under_a_hash_of_eight_bits(spark, edge, texts, monkeypatch):
    def weak(codes, at, length, strong=S.run_hashes):
        return strong(codes, at, length) & np.uint64(255)

    monkeypatch.setattr(S, "run_hashes", weak)
    assert counted(S.substring_dedup(edge, digest=True)) == brute_substring(texts)


def test_substring_needs_a_short_period(edge):
    with pytest.raises(ValueError):
        S.substring_dedup(edge, window=30)


def test_empty_tables(none):
    assert S.substring_dedup(none).count() == 0
    assert E.exact_dedup(none).count() == 0
    assert H.near_duplicates(none).count() == 0
    assert E.drop_copies(none).count() == 0
    assert H.drop_near_copies(none).count() == 0


def test_exact_matches_sql(edge):
    documents = edge.select("doc_id", "text").toArrow()
    assert documents.num_rows
    want = Counter(duckdb.sql(E.ORACLE).fetchall())
    assert counted(E.exact_dedup(edge)) == want


def test_exact_keeps_one_row_and_all_columns(edge, texts):
    kept = E.drop_copies(edge)
    assert kept.columns == edge.columns
    best = {}
    for i, t in texts:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    got = [(r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()]
    assert sorted(got) == sorted(best.items())


def test_huge_texts_are_hashed_in_windows():
    rng = np.random.default_rng(3)
    sizes = [0, 5000, 40_000, 10, 33_000, 16_384, 0]
    off = np.concatenate(([0], np.cumsum(sizes)))
    data = rng.integers(0, 256, off[-1], dtype=np.uint8)
    w = E.chunk_weights()
    assert np.array_equal(E.fingerprints(data, off, w, window=8192), E.fingerprints(data, off, w, window=1 << 20))


def test_only_repeated_texts_are_compared(spark):
    rows = [(i, "x" * i) for i in range(50)] + [(100, "x" * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    info = docs.withColumn("tag", E.text_tag()).mapInArrow(E._describe, "doc_id long, tag long, fp long, n_bytes long, text_sha256 string")
    repeated = info.groupBy("fp", "n_bytes").count().filter("count > 1").collect()
    assert [r["n_bytes"] for r in repeated] == [7]
    assert E.differing_groups(docs, info).count() == 0


def test_fingerprints_compose():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(5000))

    def print_of(b, size):
        v = int(E.fingerprints(np.frombuffer(b, np.uint8), np.array([0, len(b)]), E.chunk_weights(size))[0])
        return v >> 31, v & E.PRIME

    assert print_of(data, 7) == print_of(data, 1024)
    for cut in (0, 1, 1023, 1024, 4999, 5000):
        assert E.combine(print_of(data[:cut], 64), cut, print_of(data[cut:], 64)) == print_of(data, 64)


def test_exact_splits_colliding_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(E, "_describe", _colliding(E._describe))
    monkeypatch.setattr(E, "_tagged", _colliding(E._tagged))
    rows = [(1, "aaaa"), (2, "bbbb"), (3, "aaaa"), (4, "cc"), (5, "bbbb")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (5, 2, False), 5: (5, 2, True), 4: (4, 1, True)}


def _colliding(f):
    import pyarrow as pa

    def run(batches):
        for b in f(batches):
            yield b.set_column(b.schema.get_field_index("fp"), "fp", pa.array([7] * b.num_rows, pa.int64()))

    return run


def brute_simhash(texts):
    prints = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                up[top(a)] = top(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        least[top(k)].append(i)
    name = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return Counter((i, f"{prints[k]:016x}", name[top(k)]) for k, (i, _) in enumerate(texts))


def test_simhash_edge_cases(edge, texts):
    small = [(i, t) for i, t in texts]
    assert counted(H.near_duplicates(edge)) == brute_simhash(small)


def test_simhash_drops_all_but_one(edge, texts):
    groups = {c for _, _, c in brute_simhash(texts)}
    kept = H.drop_near_copies(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str) == sorted(groups, key=str)


def test_covering_masks_miss_no_pair():
    masks = [m & (2**64 - 1) for m in H.covering_masks()]
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(((1 << a) | (1 << b)) & m == 0 for m in masks)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1, 1, 6}
    for p in list(prints)[:20]:
        q = p
        for _ in range(6):  # chains of two-bit steps
            q ^= 1 << rng.randrange(64)
            q ^= 1 << rng.randrange(64)
            prints.add(q)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(H.links(df)).collect()}
    up = {p: p for p in signed}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert {p: got.get(p, p) for p in signed} == {p: top(p) for p in signed}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)]
    random.Random(3).shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(201))
    assert all(got[i] == 1000 for i in range(1001, 1400))
