"""Secret scans: fixed patterns, and formats learned by grammar inference.

The base patterns (assign, access, hex) always count. Beside them, for each kind
of labelled credential a prefix tree of the examples is folded into a small
probabilistic automaton: states whose ending and next-character frequencies agree
within a Hoeffding bound, and whose successors do too, are merged. Each automaton
runs from every possible start within a candidate token: its first character, those
after one that is no letter or digit, and wherever the examples' common opening
stands. A part that no base span touches becomes a span of the likeliest kind if its
likelihood a character beats that of evenly drawn characters by MARGIN and its
length is one that the examples had. Of several lengths those that end before no
letter or digit come first, then the longest; of overlapping parts the first stays.

Automata are trained on the driver from the labelled table (a parameter) and have
a few dozen states, whatever the corpus.

Defined results: a null or empty text has no spans; null and repeated doc_ids
pass through; other columns are ignored; no rows give no rows. Spans count code
points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import os.path
import random
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.llm.common import blocks, ids_and_texts, tidy

BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What a candidate looks like; access and hex matches that count lie within one.
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_BREAK = re.compile(r"[+/_.=-]")
_WORDS = ("passw", "secret", "token", "api")
_SYMBOLS = 67  # characters that a token can hold

#: Confidence of the Hoeffding test, and nats a character above evenly drawn ones.
ALPHA, MARGIN = 0.05, 0.2
#: Different next characters from which on a state counts as open to others.
OPEN = 8

_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Credential formats of the labelled examples, as (kind, opening, alphabet, length of the rest).
FORMATS = (
    ("access_id", "ASIA", _DIGITS + _LARGE, 16),
    ("chat_token", "xoxb-", _DIGITS + _SMALL + _LARGE, 40),
    ("code_host_token", "ghp_", _DIGITS + _SMALL + _LARGE, 36),
    ("map_key", "AIza", _DIGITS + _SMALL + _LARGE + "-_", 35),
    ("package_token", "npm_", _DIGITS + _SMALL + _LARGE, 36),
    ("payment_key", "sk_live_", _DIGITS + _SMALL + _LARGE, 24),
)


def labelled_credentials(each: int = 150, seed: int = 7) -> list[tuple[str, str]]:
    """The labelled table of the query: (kind, credential), drawn from the formats above."""
    rng = random.Random(seed)
    return [(kind, opening + "".join(rng.choices(letters, k=n))) for kind, opening, letters, n in FORMATS for _ in range(each)]


class _State:
    __slots__ = ("ends", "n", "out")

    def __init__(self):
        self.n, self.ends = 0, 0
        self.out: dict[str, list] = {}  # character -> [state, times]


class Automaton:
    """Probabilistic automaton of one kind of credential."""

    def __init__(self, examples: Iterable[str], alpha: float = ALPHA):
        examples = list(examples)
        self.sizes = (min(map(len, examples)), max(map(len, examples)))
        self.opening = os.path.commonprefix(examples)
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        root = _State()
        for text in examples:
            state = root
            for c in text:
                state.n += 1
                edge = state.out.setdefault(c, [_State(), 0])
                edge[1] += 1
                state = edge[0]
            state.n += 1
            state.ends += 1
        settled = [root]
        while True:
            edges = [(edge, state) for state in settled for edge in state.out.values() if not any(edge[0] is s for s in settled)]
            if not edges:
                break
            edge, _ = max(edges, key=lambda e: e[0][0].n)
            # of the states that agree with it, the one with the most evidence
            same = max((s for s in settled if self._compatible(s, edge[0])), key=lambda s: s.n, default=None)
            if same is None:
                settled.append(edge[0])
            else:
                extra, edge[0] = edge[0], same
                self._fold(same, extra)
        number = {id(s): i for i, s in enumerate(settled)}
        self.steps = [{c: (number[id(t)], math.log(k / s.n)) for c, (t, k) in s.out.items()} for s in settled]
        # a character that the examples happen to lack in an open state takes its usual way, at half a sighting
        self.usual = [max(((k, number[id(t)], math.log(0.5 / s.n)) for t, k in s.out.values()), default=None) if len(s.out) >= OPEN else None for s in settled]
        self.final = [math.log(s.ends / s.n) if s.ends else math.log(1e-6) for s in settled]

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: _State, b: _State) -> bool:
        if self._differ(a.ends, a.n, b.ends, b.n):
            return False
        for c in a.out.keys() | b.out.keys():
            x, y = a.out.get(c), b.out.get(c)
            if self._differ(x[1] if x else 0, a.n, y[1] if y else 0, b.n):
                return False
            if x and y and not self._compatible(x[0], y[0]):
                return False
        return True

    def _fold(self, a: _State, b: _State) -> None:
        a.n += b.n
        a.ends += b.ends
        for c, (state, times) in b.out.items():
            if c in a.out:
                a.out[c][1] += times
                self._fold(a.out[c][0], state)
            else:
                a.out[c] = [state, times]

    def score(self, text: str) -> float:
        """Nats a character above evenly drawn characters; the worst if the length is not one of the examples'."""
        if not self.sizes[0] <= len(text) <= self.sizes[1]:
            return -math.inf
        state, total = 0, 0.0
        for c in text:
            step = self.steps[state].get(c)
            if step is None:
                if self.usual[state] is None:
                    return -math.inf
                step = self.usual[state][1:]
            state, p = step
            total += p
        return (total + self.final[state]) / len(text) + math.log(_SYMBOLS)

    def fit(self, text: str, margin: float) -> tuple[float, int] | None:
        """Score and length of the part from the text's first character that fits best; None if none does."""
        state, total, found = 0, 0.0, None
        for n, c in enumerate(text[: self.sizes[1]], 1):
            step = self.steps[state].get(c)
            if step is None:
                if self.usual[state] is None:
                    break
                step = self.usual[state][1:]
            state, p = step
            total += p
            if n >= self.sizes[0]:
                score = (total + self.final[state]) / n + math.log(_SYMBOLS)
                whole = not text[n : n + 1].isalnum()
                if score >= margin and (found is None or (whole, n) > found[:2]):
                    found = (whole, n, score)
        return found and (found[2], found[1])


@lru_cache(maxsize=4)
def automata(labelled: tuple[tuple[str, str], ...]) -> dict[str, Automaton]:
    return {kind: Automaton(t for k, t in labelled if k == kind) for kind in sorted({k for k, _ in labelled})}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for token in _TOKEN.finditer(text):
        part, at = token[0], token.start()
        found += [(at + m.start(), at + m.end(), "access") for m in _ACCESS.finditer(part) if len(m[0]) >= 20]
        found += [(at + m.start(), at + m.end(), "hex") for m in _HEX.finditer(part)]
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2]), s[1]))


def learned_spans(text: str, base: list[tuple[int, int, str]], grammars: dict[str, Automaton], margin: float = MARGIN) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the parts of candidates that fit a learned format and touch no base span."""
    found, most = [], max((g.sizes[1] for g in grammars.values()), default=0)
    for token in _TOKEN.finditer(text):
        part, at = token[0], token.start()
        starts = {0} | {m.end() for m in _BREAK.finditer(part)}
        for opening in {g.opening for g in grammars.values()} - {""}:
            i = part.find(opening)
            while i >= 0:
                starts.add(i)
                i = part.find(opening, i + 1)
        done = 0
        for i in sorted(starts):
            if i < done:
                continue
            rest = part[i : i + most + 1]
            fits = [(*fit, k) for k, g in grammars.items() if (fit := g.fit(rest, margin))]
            fits = [(score, k, n) for score, n, k in fits if not any(s < at + i + n and at + i < e for s, e, _ in base)]
            if fits:
                _, kind, n = max(fits)
                found.append((at + i, at + i + n, kind))
                done = i + n
    return found


def scan(text: str, grammars: dict[str, Automaton]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start (base ones first)."""
    base = base_spans(text)
    learned = learned_spans(text, base, grammars)
    return base, sorted(base + learned, key=lambda s: s[0]) if learned else base


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(docs: DataFrame, labelled: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    table = tuple(labelled_credentials() if labelled is None else labelled)

    def run(batches):
        grammars = automata(table)
        for block in blocks(batches):
            counts, shas, spans = ([], [], []), [], []
            for text in block.column("text").to_pylist():
                base, every = scan(text or "", grammars)
                for n, kind in zip(counts, BASE_KINDS, strict=True):
                    n.append(sum(k == kind for _, _, k in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by [kind]; spans that touch become one, named by the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, labelled: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """docs with secrets in `text` replaced by their kind; all rows and columns stay, n_chars is counted anew."""
    table = tuple(labelled_credentials() if labelled is None else labelled)
    names, kinds = docs.columns, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def run(batches):
        grammars = automata(table)
        for block in blocks(batches):
            texts, sizes = [], (block.column("n_chars").to_pylist() if "n_chars" in names else None)
            for i, text in enumerate(block.column("text").to_pylist()):
                spans = scan(text, grammars)[1] if text else []
                texts.append(redact(text, spans) if spans else text)
                if spans and sizes is not None:
                    sizes[i] = len(texts[i])
            new = {"text": pa.array(texts, pa.string())} | ({} if sizes is None else {"n_chars": pa.array(sizes, block.schema.field("n_chars").type)})
            yield pa.RecordBatch.from_arrays([new.get(n, block.column(n)) for n in names], names=names)

    return docs.mapInArrow(tidy(run), kinds)
