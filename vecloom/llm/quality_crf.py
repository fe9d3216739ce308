"""Quality classifier: a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own shape and that of its neighbours
(the line before and after, and the chain's transitions). Forward-backward gives
each line's probability of being good; weighted by line length they add up to the
document's quality, from 0 to 1.

Training: labelled documents whose crc32(doc_id as text) modulo FOLDS is not 0; at
most SAMPLE of them, picked by a hash of the doc_id, of at most TRAIN_LINES lines
each (both bounds are parameters; scoring knows no bound). Their lines carry the
document's label. Only packed line features reach the driver. Labels, lang, source
and doc_id never enter a score.

Defined results: a null text is an empty one, which is one empty line and gets a
score like any other; a null doc_id is not held out; rows that repeat are scored
alike; documents labelled twice train by the lower label; without usable labels
every score is 0.5; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import blocks, ids_and_texts, text_buffers, tidy, word_hashes, word_spans

FOLDS, THRESHOLD = 5, 0.3
#: Bounds of the training sample: documents, and lines of each.
SAMPLE, TRAIN_LINES = 4000, 400
ROUNDS, RATE, RIDGE = 200, 0.1, 1e-3
#: Text bytes of a block of drop_bad: its lines' features take a multiple of them.
BLOCK = 1 << 19

#: Byte classes that lines are counted by.
_CLASSES = ("lower", "upper", "digit", "space", "stop", "bang", "bar", "symbol", "quote", "high")


def _byte_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"), np.int64)
    for name, members in (
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (9, 10, 11, 12, 13, 32)),
        ("stop", b".,;:-"), ("bang", b"!?"), ("bar", b"|"), ("quote", b"\"'()"), ("high", range(128, 256)),
    ):
        table[list(members)] = _CLASSES.index(name)
    return table


_TABLE = _byte_classes()
#: Own features of a line; with those of the lines before and after, and a constant.
OWN = 16
WIDTH = 3 * OWN + 1


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of a block of texts, their lengths in bytes, and each text's first line (n + 1)."""
    breaks = np.flatnonzero(data == 10)
    texts = len(off) - 1
    starts = np.sort(np.concatenate((off[:-1], breaks + 1)), kind="stable")
    per_text = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    first = np.concatenate(([0], np.cumsum(per_text)))
    # a text's own start sorts after a break that ends the text before it
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = off[1:]
    size = ends - starts
    n = len(starts)
    own = np.zeros((n, OWN))
    if not n:
        return np.zeros((0, WIDTH)), size, first
    line = np.repeat(np.arange(n), size)
    body = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(line))
    counts = np.bincount(line * len(_CLASSES) + _TABLE[data[body]], minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    c = dict(zip(_CLASSES, counts.T, strict=True))
    ws, we, _ = word_spans(data, off)
    owner = np.searchsorted(starts, ws, side="right") - 1
    words = np.bincount(owner, minlength=n).astype(float)
    per_word = np.maximum(words, 1)
    letters = np.maximum(c["lower"] + c["upper"] + c["high"], 1)
    codes = word_hashes(data, ws, we) if len(ws) else np.empty(0, np.uint64)
    for k, column in ((1, 10), (2, 11), (3, 12)):
        same = (codes[k:] == codes[:-k]) & (owner[k:] == owner[:-k])
        own[:, column] = np.bincount(owner[k:][same], minlength=n) / per_word
    own[:, 0] = c["upper"] / letters
    own[:, 1] = c["upper"] / letters > 0.5
    own[:, 2] = np.minimum(c["bang"] / per_word, 2)
    own[:, 3] = np.minimum(c["bar"] / per_word, 2)
    own[:, 4] = np.minimum(c["symbol"] / per_word, 2)
    own[:, 5] = np.minimum(c["digit"] / per_word, 2)
    own[:, 6] = np.minimum(c["stop"] / per_word, 2)
    own[:, 7] = np.minimum(letters / per_word, 20) / 10
    own[:, 8] = np.log1p(words) / 5
    own[:, 9] = words == 0
    # a line that stood in its text before
    text_of = np.repeat(np.arange(texts), per_text)
    prints = word_hashes(data, starts, ends) if len(data) else np.zeros(n, np.uint64)
    order = np.lexsort((np.arange(n), prints, text_of))
    again = np.zeros(n)
    again[order[1:]] = (prints[order[1:]] == prints[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    own[:, 13] = again * (words > 0)
    own[:, 14] = np.minimum(c["quote"] / per_word, 2)
    own[:, 15] = c["high"] / letters
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = text_of[1:] == text_of[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    return np.concatenate((own, before, after, np.ones((n, 1))), axis=1), size, first


class Chain:
    """Weights of the lines' features for `good`, and bonuses of staying bad and staying good."""

    def __init__(self, weights: np.ndarray | None = None, stay: np.ndarray | None = None):
        self.weights = np.zeros(WIDTH) if weights is None else weights
        self.stay = np.zeros(2) if stay is None else stay

    def marginals(self, features: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Each line's probability of good; with pairs also the expected stays (bad, good)."""
        logit = np.clip(features @ self.weights, -30, 30)
        good = 1 / (1 + np.exp(-logit))
        emit = np.stack((1 - good, good), axis=1)
        move = np.exp(np.array([[self.stay[0], 0.0], [0.0, self.stay[1]]]))
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        heads, sizes = first[:-1][order], length[order]
        longest = int(sizes[0]) if len(sizes) else 0
        running = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with a line t
        forward, backward = np.empty_like(emit), np.empty_like(emit)
        a = None
        for t in range(longest):
            at = heads[: running[t]] + t
            a = emit[at] if t == 0 else (a[: running[t]] @ move) * emit[at]
            a = a / a.sum(axis=1, keepdims=True)
            forward[at] = a
        b = np.empty((0, 2))
        for t in range(longest - 1, -1, -1):
            more = running[t] - len(b)
            if t + 1 < longest:
                at = heads[: running[t + 1]] + t + 1
                b = (emit[at] * b) @ move.T
                b = b / b.sum(axis=1, keepdims=True)
                more = running[t] - len(b)
            b = np.concatenate((b, np.ones((more, 2)))) if more else b
            backward[heads[: running[t]] + t] = b
        joint = forward * backward
        marginal = joint[:, 1] / joint.sum(axis=1)
        if not pairs:
            return marginal
        inner = np.ones(len(emit), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        xi = forward[at - 1][:, :, None] * move[None] * (emit[at] * backward[at])[:, None, :]
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        return marginal, np.array([xi[:, 0, 0].sum(), xi[:, 1, 1].sum()])

    def fit(self, features: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Chain:
        """Maximum likelihood of lines that all carry their text's label, with a ridge, by Adam."""
        length = np.diff(first)
        truth = np.repeat(label, length).astype(float)
        stays = np.array([(length - 1)[label == 0].sum(), (length - 1)[label == 1].sum()], float)
        # each text weighs alike, so that long ones don't drown the rest
        n = len(label)
        per_line = np.repeat(1 / np.sqrt(length), length)
        theta = np.zeros(WIDTH + 2)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            self.weights, self.stay = theta[:WIDTH], theta[WIDTH:]
            marginal, expected = self.marginals(features, first, pairs=True)
            gradient = np.concatenate((features.T @ ((truth - marginal) * per_line) / n, (stays - expected) / max(stays.sum(), 1))) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.stay = theta[:WIDTH], theta[WIDTH:]
        return self

    def quality(self, features: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        weight = np.maximum(size, 1).astype(float)
        return np.add.reduceat(self.marginals(features, first) * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def is_held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _packed(limit: int):
    def run(batches):
        for block in blocks(batches):
            data, off = text_buffers(block.column("text"))
            features, _, first = line_features(data, off)
            features = features.astype("<f4")
            out = [(q, features[a:b].tobytes()) for q, a, b in zip(block.column("quality").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True) if b - a <= limit]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["quality", "lines"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = TRAIN_LINES, folds: int = FOLDS) -> Chain:
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    ids = ids.filter(~is_held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = ids_and_texts(docs).join(F.broadcast(picked), "doc_id").select("quality", "text").mapInArrow(tidy(_packed(lines)), "quality int, lines binary")
    # a fixed order, so that the same rows give the same weights
    found = sorted((bytes(r["lines"]), r["quality"]) for r in rows.collect())
    label = np.array([q for _, q in found])
    if len(set(label.tolist())) < 2:
        return Chain()
    features = [np.frombuffer(x, "<f4").reshape(-1, WIDTH) for x, _ in found]
    return Chain().fit(np.concatenate(features).astype(float), np.concatenate(([0], np.cumsum([len(x) for x in features]))), label)


def _scored(weights: np.ndarray, stay: np.ndarray):
    def run(batches):
        chain = Chain(weights, stay)
        for block in blocks(batches):
            score = chain.quality(*line_features(*text_buffers(block.column("text"))))
            names = [n for n in block.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(block.column(n) for n in names), pa.array(np.clip(score, 0, 1))], names=[*names, "score"])

    return run


def score_documents(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = ids_and_texts(docs).mapInArrow(_scored(chain.weights, chain.stay), "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels))


def drop_bad(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns."""
    weights, stay = chain.weights, chain.stay

    def run(batches):
        chain = Chain(weights, stay)
        for block in blocks(batches, size=BLOCK):
            score = chain.quality(*line_features(*text_buffers(block.column("text"))))
            yield block.filter(pa.array(score >= threshold))

    return docs.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
