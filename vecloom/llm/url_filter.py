"""URL filters: explicit rules first, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (a parameter);
its weights are one array of BUCKETS numbers, whatever the input. Host, path and
rules are Catalyst expressions; only the model's score runs in Python, in blocks.

Defined results: a null url or one without :// has an empty host and path, fits no
rule and is judged by the model; null and repeated page_ids pass through; other
columns are ignored; no rows give no rows; a model without labelled rows allows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: Scores from here on are blocked.
THRESHOLD = 0.5

#: The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Words of the labelled hosts: of ordinary ones, and of ones to be blocked.
ORDINARY = (
    "archive bakery bank bicycle biology book bridge castle chemistry church city climate coffee concert cooking craft "
    "culture design docs energy engineering family farm film fish football forest forum garden geography guitar harbor "
    "health history hospital house journal kitchen language law letters library lyric market maths medicine mountain "
    "museum music nature news ocean painting park photo physics poetry radio railway recipes research river school "
    "science software sport station story student studio theatre travel university village weather wiki winter"
).split()
JUNK = (
    "adclick adult bet betting bets bingo blackjack bonus-spins casino cheap clickbait crack doorway escort fast-cash "
    "free-money gambling hacked jackpot keygen linkfarm lottery malware nude pharma phishing pills poker popunder porn "
    "prize replica roulette scam sex slots spam torrent viagra warez win-now xxx payday-loan verify-account"
).split()
_ZONES = ("example.net", "example.com", "example.org", "example", "example.edu", "example.co")
_PATHS = ("/", "/en/{n}", "/fr/{n}.html", "/index.html", "/de/{n}/", "/a/b/{n}", "/es/{n}?page=2", "/docs/page-{n}", "/en/{n}?utm_source=feed", "/{n}/view")


def labelled_table() -> tuple[tuple[str, int], ...]:
    """The labelled URL table of the query, three URLs for each word; 1 is to be blocked.

    Paths, zones and first names are dealt alike to both labels, so only the words tell them apart.
    """
    rows = []
    for label, words in ((0, ORDINARY), (1, JUNK)):
        for i, word in enumerate(words):
            other = words[(7 * i + 3) % len(words)]
            for k, host in enumerate((word, f"{word}-{other}", f"{('www', 'blog', 'm')[i % 3]}.{word}{i % 10}")):
                path = _PATHS[(3 * i + k) % len(_PATHS)].format(n=(7919 * (3 * i + k + 1)) % 9973)
                rows.append((f"http://{host}.{_ZONES[(i + k) % len(_ZONES)]}{path}", label))
    return tuple(rows)


LABELLED = labelled_table()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def features(host: str, path: str) -> np.ndarray:
    """Buckets of all character n-grams of host and path, which hash apart; sorted, without repeats."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(zlib.crc32(f"{mark}{part[i : i + n]}".encode()) % BUCKETS for i in range(len(part) - n + 1))
    return np.array(sorted(found), np.int64)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one url, as the expressions below have them."""
    rest = (url or "").partition("://")[2]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[cut:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:cut].translate(str.maketrans(_UPPER, _LOWER)), path[:end]


def train(rows: Iterable[tuple[str, int]], rounds: int = 300, rate: float = 4.0, ridge: float = 1e-3) -> np.ndarray:
    """Weights by full-batch gradient descent; the last one is the bias."""
    rows = list(rows)
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights - np.append(np.zeros(BUCKETS), 1.0)
    hot = [features(*split_url(u)) for u, _ in rows]
    label = np.array([y for _, y in rows], float)
    scale = np.array([1 / np.sqrt(max(len(h), 1)) for h in hot])
    for _ in range(rounds):
        z = np.array([weights[h].sum() * s for h, s in zip(hot, scale, strict=True)]) + weights[-1]
        error = 1 / (1 + np.exp(-z)) - label
        gradient = ridge * weights
        for h, s, e in zip(hot, scale, error, strict=True):
            gradient[h] += s * e / len(rows) * 4
        gradient[-1] += error.mean()
        weights = weights - rate * gradient
    return weights


def score(weights: np.ndarray, host: str, path: str) -> float:
    h = features(host, path)
    return float(1 / (1 + np.exp(-(weights[h].sum() / np.sqrt(max(len(h), 1)) + weights[-1]))))


def _scored(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            values = [score(weights, h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def filter_urls(pages: DataFrame, labelled: Iterable[tuple[str, int]] = LABELLED, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the model's, of blocking)."""
    url = F.coalesce("url", F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), locate('://', coalesce(url, '')) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))
    scored = parts.mapInArrow(_scored(train(labelled)), "page_id long, host string, path string, score double")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
