"""Pre-tokenisation of whole blocks of texts in numpy.

The split patterns of public byte-level BPE vocabularies cut a text into runs of
letters, numbers, other marks and white space, with English contractions apart.
Run boundaries of a block come from one class table over its code points.
"""

from __future__ import annotations

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def all_code_points() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def class_table(matches) -> np.ndarray:
    """Class of each code point; matches(pattern, text): all characters of text that the library's pattern matches."""
    table = np.zeros(0x110000, np.uint8)
    every = all_code_points()
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        table[np.frombuffer(matches(pattern, every).encode("utf-32-le"), np.uint32)] = kind
    return table


def _contractions(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, joined: np.ndarray, free: np.ndarray):
    """Runs that are the apostrophe of 's 't 're 've 'm 'll 'd, and how many letters of the next run follow it."""
    at = np.flatnonzero((kinds[:-1] == OTHER) & (ends[:-1] - starts[:-1] == 1) & (kinds[1:] == LETTER) & joined[1:] & free[:-1])
    at = at[codes[starts[at]] == ord("'")]
    one = codes[starts[at + 1]]
    two = np.where(ends[at + 1] - starts[at + 1] > 1, codes[np.minimum(starts[at + 1] + 1, len(codes) - 1)], 0)
    size = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    return at[size > 0], size[size > 0]


def split(texts: list[str], table: np.ndarray, spaced: bool) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts in order, and each text's first piece number (n + 1 of them).

    spaced: a space opens the piece that it precedes, white space forms pieces and
    numbers form runs. Otherwise white space is dropped and each number stands alone.
    """
    whole = "".join(texts)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    if not whole:
        return [], np.zeros(len(bounds), np.int64)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = table[codes]
    new = np.empty(len(codes), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    head = np.zeros(len(codes) + 1, bool)
    head[bounds] = True
    new |= head[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(codes))
    kinds = kind[starts]
    joined = ~head[starts]  # another run of the same text stands before
    space = kinds == SPACE
    opens = np.zeros(len(starts), bool)  # a space before it belongs to the piece
    if spaced:
        opens[1:] = space[:-1] & joined[1:] & (codes[ends[:-1] - 1] == 0x20)
    marks = np.zeros(len(codes) + 1, bool)
    marks[starts] = True
    if spaced:
        marks[starts[opens]] = False
        inner = space & ~head[ends]  # not at the end of its text: the last character stands apart
        marks[ends[inner] - 1] = True
    elif (kinds == NUMBER).any():
        marks[:-1] |= kind == NUMBER
    at, size = _contractions(codes, starts, ends, kinds, joined, ~opens)
    marks[starts[at + 1]] = False
    rest = starts[at + 1] + size
    marks[rest[rest < ends[at + 1]]] = True
    cuts = np.flatnonzero(marks[:-1])
    first = np.searchsorted(cuts, bounds)
    stops = np.append(cuts[1:], len(codes))
    if not spaced:
        keep = kind[cuts] != SPACE
        first = np.concatenate(([0], np.cumsum(keep)))[first]
        cuts, stops = cuts[keep], stops[keep]
    return [whole[a:b] for a, b in zip(cuts.tolist(), stops.tolist(), strict=True)], first
