"""64-bit hashes of all words of a batch of texts, by array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Blank, tab, line feed, VT, FF, CR become a byte that UTF-8 never has; A-Z become a-z.
GAP = 255
FOLD = bytes(GAP if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _tables[k] = np.multiply.accumulate(x)
    return _tables[0], _tables[1]


def _hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word starts, hashes) of folded bytes."""
    inside = a != GAP
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(a) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)))
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, text after text, and how many each text has.

    Words are split at white space only and A-Z lower-cased; the bytes are worked
    on in pieces that end between words, so memory does not follow the text.
    """
    whole = [t.encode("utf-8", "surrogatepass").translate(FOLD) for t in texts]
    data = np.frombuffer(bytes([GAP]).join(whole) + bytes([GAP]), np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + chunk, len(data))
        while end < len(data) and data[end - 1] != GAP:
            more = np.flatnonzero(data[end : end + chunk] == GAP)
            end = end + int(more[0]) + 1 if len(more) else min(end + chunk, len(data))
        s, h = _hashes(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    ends = np.cumsum([len(w) + 1 for w in whole])
    first = np.searchsorted(np.concatenate(starts), ends) if texts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.diff(first, prepend=0)


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; a shorter text is one shingle, one without words none."""
    k = np.uint64(0xD6E8FEB86659FD93)
    n = max(len(hashes) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled = rolled * k + hashes[i : i + n]
    rolled = mix(rolled)
    at = 0
    for c in counts.tolist():
        if c >= width:
            yield np.unique(rolled[at : at + c - width + 1])
        elif c:
            one = np.full(1, c, np.uint64)
            for h in hashes[at : at + c]:
                one = one * k + h
            yield mix(one)
        else:
            yield np.zeros(0, np.uint64)
        at += c
