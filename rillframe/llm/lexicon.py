"""Minimal acyclic transducer: frequent words -> token ids, in one shared-suffix automaton.

States with equal continuations are one state, whatever word leads to them, so an
output can't sit on a transition; instead every transition carries the number of
words that sort before its own under the same state.  The sum along a path is the
word's rank, which indexes the id lists.  The file is flat arrays, read by mmap.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

MAGIC = b"RFLX0001"
_FIELDS = ("keys", "target", "skip", "final", "at", "ids")
_TYPES = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint32)


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes for non-empty words with their ids."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...))

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
        return at

    path: list[list] = [[False, []]]  # one open state a byte of the last word
    last = b""
    for word in words:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        for i in range(len(last), same, -1):
            at = freeze(path.pop())
            path[-1][1][-1] = (last[i - 1], at)
        for byte in word[same:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        at = freeze(path.pop())
        path[-1][1][-1] = (last[i - 1], at)
    root = freeze(path.pop())
    below = [0] * len(states)
    keys, target, skip = [], [], []
    for s, (final, arcs) in enumerate(states):  # targets are frozen before their sources
        before = int(final)
        for byte, to in arcs:
            keys.append(s << 8 | byte)
            target.append(to)
            skip.append(before)
            before += below[to]
        below[s] = before
    lists = [entries[w] for w in words]
    arrays = (keys, target, skip, [f for f, _ in states], np.cumsum([0, *map(len, lists)]), [i for ids in lists for i in ids])
    parts = [np.asarray(a, t).tobytes() for a, t in zip(arrays, _TYPES)]
    head = MAGIC + struct.pack("<7q", root, *map(len, parts))
    pad = lambda b: b + bytes(-len(b) % 8)
    return pad(head) + b"".join(map(pad, parts))


class Lexicon:
    """Reader of a compiled lexicon in a memory map."""

    def __init__(self, blob: bytes) -> None:
        with tempfile.TemporaryFile(prefix="lexicon-") as f:  # unlinked: the map keeps it until the process ends
            f.write(blob)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:8] != MAGIC:
            raise ValueError("not a lexicon")
        self.root, *sizes = struct.unpack_from("<7q", self._map, 8)
        at = 64
        for name, kind, size in zip(_FIELDS, _TYPES, sizes):
            setattr(self, name, np.frombuffer(self._map, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8

    def __len__(self) -> int:
        return len(self.at) - 1

    def find(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 if it isn't in; all words step through the automaton together."""
        n = len(words)
        rank = np.zeros(n, np.int64)
        if not n or not len(self):
            return rank - 1
        lens = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(lens) - lens
        state = np.full(n, self.root, np.int64)
        live = np.arange(n)
        for step in range(int(lens.max())):
            live = live[lens[live] > step]
            key = state[live] << 8 | flat[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            rank[live] += self.skip[arc]
            state[live] = self.target[arc]
            if not len(live):
                break
        known = state >= 0
        known[known] = self.final[state[known]] > 0
        return np.where(known, rank, -1)

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.at[rank]:self.at[rank + 1]]
