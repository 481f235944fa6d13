"""Word shingle sets of texts as sorted 64-bit hashes, for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from artifactlink.llm.common import ASCII_LOWER

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of text that are hashed at a time; working memory is some 40 times as much, or follows one longer text.
BLOCK = 1 << 21


def word_places(texts: list[bytes], table: bytes = ASCII_LOWER) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one buffer (bytes through `table`), and its words `[^\\x20\\x09-\\x0D]+`: starts, ends, hashes; words of each text."""
    parts, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > BLOCK:
            parts.append(_places(texts[lo:i], table))
            lo, size = i, 0
        size += len(t) + 1
    parts.append(_places(texts[lo:], table))
    if len(parts) == 1:
        return parts[0]
    base = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
    moved = [np.concatenate([p[k] + at for p, at in zip(parts, base, strict=True)]) for k in (1, 2)]
    return b"".join(p[0] for p in parts), *moved, np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])


def _places(texts: list[bytes], table: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = b" ".join(texts).translate(table) + b" "
    a = np.frombuffer(raw, np.uint8)
    space = _SPACE[a]
    word = ~space
    starts = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], word[:-1]]))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers(_P, len(a)), out=total[1:])
    h = mix((total[ends] - total[starts]) * powers(_P_INVERSE, len(a))[starts])
    upto = np.cumsum([len(t) + 1 for t in texts])
    at = np.searchsorted(starts, upto)
    return raw, starts, ends, h, np.diff(np.concatenate([[0], at]))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, and the number of words of each text."""
    _, _, _, h, counts = word_places(texts)
    return h, counts


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles; fewer words make one shingle, none the empty set."""
    h, counts = word_hashes(texts)
    n = len(h)
    key = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        key += h[j : n - size + 1 + j] * np.uint64(pow(_P, j + 1, 1 << 64)) if len(key) else key
    key = mix(key)
    at = 0
    for c in counts.tolist():
        if c >= size:
            s = np.sort(key[at : at + c - size + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif c:
            short = np.uint64(c)
            for w in h[at : at + c]:
                short = np.uint64((int(short) * _P + int(w)) & (2**64 - 1))
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += c
