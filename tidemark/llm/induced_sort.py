"""External induced sorting of the suffixes of one shard, with their common prefixes.

Induction scans the suffixes in order and hands each one's predecessor on: the tuple (first
character, arrival) is its priority. As priorities never fall below the one being read, a
first-in first-out queue for each character is a priority queue for these tuples. A tuple carries
its suffix and the length of the prefix it shares with the one before it in its queue: one more than
the least such length among the suffixes scanned since that one was handed on. The queues and
the ordered suffixes of both passes keep ``memory`` tuples in RAM and have the rest in anonymous
files of the task, in the order in which they are read again. RAM holds the text, a byte of marks
for each character, and the seeds.

Left-most S suffixes are the seeds. Their substrings are sorted by one round of induction and
named; where names repeat, the reduced string of names is ordered by refining ranks up to the
wanted depth, and the prefixes that neighbouring seeds share are compared; a second round of
induction from the ordered seeds orders all suffixes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples in RAM, a small part of those of a shard.
MEMORY = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MANY = np.uint8(255)


def _tuples(positions: np.ndarray, shared: np.ndarray) -> np.ndarray:
    return positions.astype(np.int64) << 8 | shared


class SpooledQueues:
    """One first-in first-out queue of tuples for each character, in a file beyond ``memory`` tuples."""

    def __init__(self, characters: int, memory: int = MEMORY):
        self.parts: list[list] = [[] for _ in range(characters)]
        self.memory, self.held, self.spooled = memory, 0, 0
        self.file = None

    def push(self, c: int, tuples: np.ndarray) -> None:
        if len(tuples):
            self.parts[c].append(tuples)
            self.held += len(tuples)
            while self.held > self.memory:
                self._spool()

    def _spool(self) -> None:
        """Moves the largest queue's tuples to the file, as one part."""
        in_memory = [sum(len(p) for p in parts if isinstance(p, np.ndarray)) for parts in self.parts]
        c = int(np.argmax(in_memory))
        self.file = self.file or tempfile.TemporaryFile()
        # A queue's parts in the file come before those in memory.
        kept = [p for p in self.parts[c] if not isinstance(p, np.ndarray)]
        at = self.file.seek(0, 2)
        for part in self.parts[c][len(kept) :]:
            self.file.write(part.tobytes())
        self.parts[c] = [*kept, (at, in_memory[c])]
        self.held -= in_memory[c]
        self.spooled += in_memory[c]

    def _read(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64)

    def drain(self, c: int) -> Iterator[np.ndarray]:
        """The tuples of a queue in blocks of at most ``memory``, also those that are pushed to it meanwhile."""
        while self.parts[c]:
            first = self.parts[c][0]
            if isinstance(first, tuple):
                at, n = self.parts[c].pop(0)
                for done in range(0, n, self.memory):
                    yield self._read(at + 8 * done, min(self.memory, n - done))
            else:
                pending, self.parts[c] = self.parts[c], []
                self.held -= sum(map(len, pending))
                yield np.concatenate(pending) if len(pending) > 1 else first

    def blocks(self, c: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """The tuples of a queue, which keeps them, in either direction."""
        for part in reversed(self.parts[c]) if backwards else list(self.parts[c]):
            if isinstance(part, tuple):
                at, n = part
                starts = range(0, n, self.memory)
                for done in reversed(starts) if backwards else starts:
                    block = self._read(at + 8 * done, min(self.memory, n - done))
                    yield block[::-1] if backwards else block
            else:
                yield part[::-1] if backwards else part

    def close(self) -> None:
        if self.file:
            self.file.close()


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the one after them."""
    n = len(text)
    change = np.sign(np.diff(text.astype(np.int16))).astype(np.int8)
    change = np.append(change, np.int8(-1))
    where = np.flatnonzero(change)
    return change[where[np.searchsorted(where, np.arange(n))]] > 0


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value of each range from ``low`` to ``high``, both included; ``_MANY`` for empty ones."""
    out = np.full(len(low), _MANY)
    size = high - low + 1
    level, span = values, 1
    while True:
        at = np.flatnonzero((size >= span) & (size < 2 * span))
        if len(at):
            out[at] = np.minimum(level[low[at]], level[high[at] - span + 1])
        if 2 * span > size.max(initial=0):
            return out
        level, span = np.minimum(level[:-span], level[span:]), 2 * span


class _Induction:
    """Hands the predecessors of scanned suffixes on, with the prefixes they share."""

    def __init__(self, text: np.ndarray, small: np.ndarray, wanted: bool, depth: int, characters: int, memory: int):
        self.text, self.small, self.wanted, self.depth = text, small, wanted, depth
        self.queues = SpooledQueues(characters, memory)
        self.least = np.zeros(characters, np.uint8)
        self.begun = np.zeros(characters, bool)

    def scan(self, positions: np.ndarray, shared: np.ndarray) -> None:
        """``shared`` tells what each suffix has in common with the one scanned before it."""
        if not len(positions):
            return
        at = np.flatnonzero(positions > 0)
        at = at[self.small[positions[at] - 1] == self.wanted]
        before = positions[at] - 1
        characters = self.text[before]
        order = np.argsort(characters, kind="stable")
        at, before, characters = at[order], before[order], characters[order]
        lowest = shared.min()
        if len(at):
            heads = np.append(True, characters[1:] != characters[:-1])
            low = np.where(heads, 0, np.append(0, at[:-1] + 1))
            found = _least(shared, low, at)
            first = np.flatnonzero(heads)
            c = characters[first]
            found[first] = np.minimum(found[first], self.least[c])
            found = np.minimum(found, self.depth - 1) + np.uint8(1)
            found[first[~self.begun[c]]] = 0
            ends = np.append(first[1:], len(at))
            tuples = _tuples(before, found)
            for one, a, b in zip(c.tolist(), first.tolist(), ends.tolist(), strict=True):
                self.queues.push(one, tuples[a:b])
            self.begun[c] = True
            self.least = np.minimum(self.least, lowest)
            last = at[ends - 1]
            self.least[c] = _least(shared, last + 1, np.full(len(last), len(shared) - 1))
        else:
            self.least = np.minimum(self.least, lowest)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many of the first ``length`` bytes the suffixes at ``a`` and at ``b`` have in common."""
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.full(len(a), length, np.int64)
    live = np.arange(len(a))
    for at in range(0, length, 8):
        same = words[a[live] + at] == words[b[live] + at]
        differs = ~same.all(axis=1)
        out[live[differs]] = at + np.argmin(same[differs], axis=1)
        live = live[~differs]
    return np.minimum(np.minimum(out, length), np.minimum(len(text) - a, len(text) - b)).astype(np.uint8)


def _shifted(blocks: Iterator[np.ndarray], first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions, and what each shares with the one before it, of tuples that tell it of the one after."""
    carry = first
    for block in blocks:
        shared = (block & 255).astype(np.uint8)
        yield block >> 8, np.append(np.uint8(carry), shared[:-1])
        carry = int(shared[-1])


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, shared: np.ndarray, depth: int, characters: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of all suffixes in order, with what each shares with the one before it, up to ``depth``.

    ``shared`` tells that of the seeds.
    """
    n = len(text)
    starts = np.searchsorted(text[seeds], np.arange(characters + 1))
    one = lambda x: np.array([x], np.int64)
    meet = lambda a, b: int(common_prefix(text, one(a), one(b), depth)[0]) if a >= 0 and b >= 0 else 0
    larger, smaller = SpooledQueues(characters, memory), SpooledQueues(characters, memory)

    ahead = _Induction(text, small, False, depth, characters, memory)
    ahead.queues.push(int(text[n - 1]), _tuples(one(n - 1), one(0)))
    ahead.begun[text[n - 1]] = True
    last_larger = np.full(characters, -1)
    for c in range(characters):
        for block in ahead.queues.drain(c):
            larger.push(c, block)
            positions = block >> 8
            last_larger[c] = positions[-1]
            ahead.scan(positions, (block & 255).astype(np.uint8))
        some = slice(starts[c], starts[c + 1])
        if starts[c] < starts[c + 1]:
            with_first = shared[some].copy()
            with_first[0] = meet(last_larger[c], seeds[starts[c]])
            ahead.scan(seeds[some], with_first)
    ahead.queues.close()

    back = _Induction(text, small, True, depth, characters, memory)
    boundary = np.zeros(characters, np.int64)
    for c in range(characters - 1, -1, -1):
        lowest = -1
        for block in back.queues.drain(c):
            smaller.push(c, block)
            positions = block >> 8
            lowest = positions[-1]
            back.scan(positions, (block & 255).astype(np.uint8))
        boundary[c] = meet(lowest, last_larger[c])
        for positions, common in _shifted(larger.blocks(c, backwards=True), boundary[c]):
            back.scan(positions, common)
    back.queues.close()
    for c in range(characters):
        for block in larger.blocks(c):
            yield block >> 8, (block & 255).astype(np.uint8)
        yield from _shifted(smaller.blocks(c, backwards=True), boundary[c])
    larger.close()
    smaller.close()


def _substring_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(text)
    up, down = np.full(n, _BASE), np.full(n, _UNBASE)
    up[0] = down[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * np.cumprod(up), out=sums[1:])
    return (sums[ends] - sums[starts]) * np.cumprod(down)[starts]


def _order_seeds(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, characters: int, depth: int, memory: int) -> np.ndarray:
    """Seeds (in text order) by their suffixes, as far as the first ``depth`` characters tell."""
    by_character = seeds[np.argsort(text[seeds], kind="stable")]
    number = np.full(len(text), -1, np.int32)
    number[seeds] = np.arange(len(seeds))
    none = np.zeros(len(seeds), np.uint8)
    at = np.concatenate([found[found >= 0] for block, _ in _induce(text, small, by_character, none, depth, characters, memory) for found in [number[block]]])
    ends = np.append(seeds[1:] + 1, len(text))
    hashes, lengths = _substring_hashes(text, seeds, ends)[at], (ends - seeds)[at]
    new = np.ones(len(at), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (lengths[1:] != lengths[:-1])
    rank = np.empty(len(seeds), np.int64)
    rank[at] = np.cumsum(new)
    # The reduced string: a name stands for at least two characters, so 2 * step of them are told apart.
    step, top = 1, int(new.sum())
    order = at
    while top < len(seeds) and 2 * step < depth:
        following = np.zeros(len(seeds), np.int64)
        following[:-step] = rank[step:]
        key = rank * (top + 1) + following
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(new)
        step, top = 2 * step, int(new.sum())
    return seeds[order]


def suffix_order(text: np.ndarray, characters: int, depth: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the starts of all suffixes of ``text`` (bytes), in the order of at least their first ``depth`` ones.

    With each start comes the length, up to ``depth``, of the prefix shared with the suffix before it.
    """
    if not len(text):
        return
    if depth > 254:
        raise ValueError("common prefixes are carried as bytes")
    small = suffix_types(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    shared = np.zeros(len(seeds), np.uint8)
    if len(seeds) > 1:
        seeds = _order_seeds(text, small, seeds, characters, depth, memory)
        shared[1:] = common_prefix(text, seeds[:-1], seeds[1:], depth)
    yield from _induce(text, small, seeds, shared, depth, characters, memory)
