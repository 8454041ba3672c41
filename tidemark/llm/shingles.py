"""Word shingles of whole texts as sorted 64-bit hashes.

A word's hash is a polynomial of its bytes modulo 2**64. Prefix sums over the text give the hashes
of all its words at once, each divided by the power at which the word starts. Such polynomials have
equal values for some pairs of long words whatever the base (from 1,024 letters on), so words of
more than ``LONG_WORD`` bytes are hashed by BLAKE2b instead.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Texts are hashed in parts of about this many bytes; a longer word is hashed as a whole.
PART = 1 << 18
LONG_WORD = 255

_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``PART``."""
    if not _powers:
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(PART + 1, np.uint64(factor))
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX_1
    return x ^ (x >> np.uint64(32))


def _parts(raw: bytes):
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PART)
        if end < len(raw):
            cut = max(raw.rfind(space, at, end) for space in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
            end = cut + 1 if cut >= at else min([x for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r") if (x := raw.find(s, end)) >= 0], default=len(raw))
        yield raw[at:end]
        at = end


def _strong(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text between ASCII white space, in order."""
    found = []
    up, down = _tables()
    for part in _parts(raw):
        if len(part) > PART:
            # A part this long is one word and the white space after it.
            found.append(np.array([_strong(w) for w in part.split()], np.uint64))
            continue
        values = np.frombuffer(part, np.uint8)
        edge = np.ones(len(values) + 2, np.int8)
        edge[1:-1] = _SPACE[values]
        edge = np.diff(edge)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
        each = _mixed((sums[ends] - sums[starts]) * down[starts])
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            each[i] = _strong(part[starts[i] : ends[i]])
        found.append(each)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the ``words``-word shingles, A-Z lower-cased.

    A text with fewer words has its whole sequence as its one shingle, one without words none.
    """
    each = word_hashes((text or "").encode().lower())
    n = len(each)
    if not n:
        return np.zeros(0, np.int64)
    size = min(words, n)
    out = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        out = _mixed(out * _MIX_2 + each[i : n - size + 1 + i])
    return np.unique((out >> np.uint64(1)).astype(np.int64))
