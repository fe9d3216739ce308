"""BPE by merge replay and packing against the public libraries and brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vecloom.llm import byte_bpe as B
from vecloom.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", " ", "  ", "a  b", "\n\n's it's 'S 're're x'll  'd", "''s \"'s", "5's 10 20", "a  b 　 c", "'", " 's", "aaaa" * 300, "é'st ñ'mo", "tab\t\tx \n y\r\n", "\x1c\x1d x\x00",
    "日本語 テキスト 😀😀 'll", "ab" * 1000 + "c", "ΑΣ ΣΑ İ ǅ", "é Å", "<|endoftext|> x",
]


def odd_texts(n):
    rng = random.Random(1)
    alphabet = "ab 'strevmld\n\t  .,!5é 日😀9\x85ΣİḰ"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_the_library(reference):
    e = B.encoder(RANKS)
    texts = odd_texts(3000)
    for t, packed in zip(texts, e.encode(texts), strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == reference.encode_ordinary(t), t
        assert e.decode(ids) == t.encode()


def test_word_table_starts_over(reference, monkeypatch):
    monkeypatch.setattr(B, "WORD_TABLE", 20)
    e = B.Encoder(RANKS)
    for t in ("one two three four", "five six seven eight nine ten " * 3, "one two " + " ".join(f"w{i}" for i in range(50))):
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)


def test_earlier_rank_may_appear_later():
    # "ab" + "c" outranks what stands beside it only once both exist
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 301, b"cd": 299, b"xab": 298, b"abcd": 297}
    t = B.MergeTable(ranks)
    enc = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 12))) for _ in range(500)]
    for w, packed in zip(words, t.replay([w.encode() for w in words]), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == enc.encode_ordinary(w), w


def test_digests_of_edge_cases(edge, texts, reference):
    want = Counter()
    for i, t in texts:
        ids = reference.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in B.round_trip_digests(edge, RANKS).collect()) == want


def test_encode_and_decode_operators(edge, texts, reference):
    back = B.decode(B.encode(edge, RANKS, to="token ids"), RANKS, column="token ids")
    assert set(back.columns) == set(edge.columns) - {"text"} | {"bytes"}
    assert Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in back.collect()) == Counter((i, t or "") for i, t in texts)


def test_empty_tables(none):
    assert B.round_trip_digests(none, RANKS).count() == 0
    assert P.best_fit_packing(none, WORDS).count() == 0


def test_word_tokenizer_equals_the_library():
    t = tokenizers.Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    own = P.tokenizer(WORDS, P.classes(WORDS))
    texts = odd_texts(1500)
    for text, packed in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def checked(rows, texts, capacity):
    t = tokenizers.Tokenizer.from_file(WORDS)
    want = Counter()
    total = 0
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), total / capacity


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_edge_cases(edge, texts, capacity):
    n, least = checked(P.best_fit_packing(edge, WORDS, capacity=capacity).collect(), texts, capacity)
    assert n <= least * 1.1 + 2


def test_packing_returns_ids(edge):
    for r in P.best_fit_packing(edge, WORDS, with_ids=True).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_plans_are_whole_and_tight():
    rng = random.Random(6)
    for shape in ("short", "mixed", "one", "full"):
        hist = Counter()
        for _ in range(30_000):
            n = {"short": rng.randrange(1, 300), "mixed": int(min(4096, rng.lognormvariate(6.5, 1))) or 1, "one": 1500, "full": 4096}[shape]
            hist[n] += 1
        found = P.plan(hist)
        fill, count = defaultdict(int), Counter()
        ends = np.append(found["first"][1:], 0)
        for i in range(len(found["length"])):
            length, first = int(found["length"][i]), int(found["first"][i])
            last = int(ends[i]) if i + 1 < len(ends) and found["length"][i + 1] == length else hist[length]
            count[length] += last - first
            for k in range(last - first):
                s = int(found["sequence"][i]) + k
                assert fill[(s, int(found["offset"][i]))] == 0
                fill[(s, int(found["offset"][i]))] = length
        assert count == hist
        used = Counter()
        for (s, offset), length in sorted(fill.items()):
            assert offset == used[s]
            used[s] += length
        assert max(used.values()) <= 4096
        if shape in ("short", "mixed"):
            assert len(used) <= sum(k * v for k, v in hist.items()) / 4096 * 1.01 + 1


def test_nnls_fits():
    rng = np.random.default_rng(0)
    a = rng.random((12, 40))
    x = np.maximum(rng.normal(size=40), 0)
    got = P.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6
