"""Compressed radix (Patricia) trie over byte strings, with owners and subtree spill."""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator
from os.path import commonprefix

from xxhash import xxh64_intdigest


class Owner:
    """What a terminal node stores: smallest and largest identifier, the number of rows, and a payload.

    The payload is that of the owning row: of the largest identifier if ``last``, else of the
    smallest; a row with an identifier before one without, and the smaller payload of equals.
    """

    __slots__ = ("low", "high", "count", "payload")

    def __init__(self, low, high, count, payload=None):
        self.low, self.high, self.count, self.payload = low, high, count, payload

    def add(self, low, high, count, payload=None, last: bool = False) -> None:
        if payload is not None:
            mine, other = (self.high, high) if last else (self.low, low)
            if mine == other:
                if payload < self.payload:
                    self.payload = payload
            elif mine is None or (other is not None and (other > mine if last else other < mine)):
                self.payload = payload
        if low is not None and (self.low is None or low < self.low):
            self.low = low
        if high is not None and (self.high is None or high > self.high):
            self.high = high
        self.count += count


class Node:
    __slots__ = ("edge", "kids", "owner", "spilled")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.kids, self.owner, self.spilled = edge, None, None, None


def _shared(a: bytes, at: int, edge: bytes) -> int:
    """Length of the common prefix of a[at:] and edge."""
    if a.startswith(edge, at):
        return len(edge)
    return len(commonprefix((a[at:at + len(edge)], edge)))


class PatriciaTrie:
    """Inserts whole byte strings; equal strings meet in one terminal node.

    When the stored edges exceed ``limit_bytes`` the largest subtree of the root
    is written to an unlinked temporary file, string by string, and later strings
    for it go straight to that file.  ``owners()`` deals each spilled subtree by the
    hash of its strings into files of about the limit and reads them back into tries of
    their own, one at a time, so memory stays near the limit.  The files are a task's
    scratch: a task that is run again writes its own.
    """

    def __init__(self, limit_bytes: int = 96 << 20, depth: int = 0, last: bool = False) -> None:
        self.root, self.limit, self.held, self.depth, self.last = Node(b""), limit_bytes, 0, depth, last
        self.by_kid: dict[int, int] = {}
        self.owed = 0

    def insert(self, key: bytes, low, high, count: int, payload: bytes | None = None) -> None:
        node, at, n = self.root, 0, len(key)
        extra = len(payload) if payload is not None else 0
        while True:
            if node.spilled is not None:
                _put(node.spilled, key, low, high, count, payload)
                return
            if at == n:
                if node.owner is None:
                    node.owner = Owner(low, high, count, payload)
                    self.owed += extra
                else:
                    node.owner.add(low, high, count, payload, self.last)
                return
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                kid = Node(key[at:])
                kid.owner = Owner(low, high, count, payload)
                if node.kids is None:
                    node.kids = {}
                node.kids[key[at]] = kid
                self._grew(key[0], n - at + 300 + extra)
                return
            same = _shared(key, at, kid.edge)
            if same < len(kid.edge):  # split the edge
                mid = Node(kid.edge[:same])
                kid.edge = kid.edge[same:]
                mid.kids = {kid.edge[0]: kid}
                node.kids[key[at]] = mid
                self.owed += 300  # charged with the next leaf: a spill here would cut the path being walked
                kid = mid
            node, at = kid, at + same

    def _grew(self, first: int, size: int) -> None:
        size, self.owed = size + self.owed, 0
        self.held += size
        self.by_kid[first] = self.by_kid.get(first, 0) + size
        while self.held > self.limit and self.by_kid:
            largest = max(self.by_kid, key=self.by_kid.get)
            self._spill(largest)

    def _spill(self, first: int) -> None:
        """Write the subtree below the root that starts with this byte and free it."""
        kid = self.root.kids[first]
        out = tempfile.TemporaryFile(prefix="subtree-")  # unlinked: it goes with the process
        for key, owner in _walk(kid, b""):
            _put(out, key, owner.low, owner.high, owner.count, owner.payload)
        kid.kids, kid.owner, kid.edge, kid.spilled = None, None, bytes([first]), out
        self.held -= self.by_kid.pop(first)

    def owners(self) -> Iterator[tuple[bytes, Owner]]:
        """Every distinct string with its owner; spilled subtrees come last, one at a time."""
        late = []
        for key, owner in _walk(self.root, b"", late):
            yield key, owner
        self.root = Node(b"")
        for out in late:
            # the strings of one subtree share their first byte: the next level deals them by the hash of the whole string
            size = out.seek(0, os.SEEK_END)
            out.seek(0)
            fan = 1 + size // max(1, self.limit // 8)  # a short string costs several times its bytes as a node
            parts = {0: out}
            if fan > 1:
                parts = {}
                for row in _get(out):
                    part = xxh64_intdigest(row[0], self.depth) % fan
                    if part not in parts:
                        parts[part] = tempfile.TemporaryFile(prefix="subtree-")
                    _put(parts[part], *row)
                out.close()
            for part in parts.values():
                part.seek(0)
                # rows of one string are one entry, so only a few very long strings can be over the limit here
                trie = PatriciaTrie(1 << 62, self.depth + 1, self.last)
                for row in _get(part):
                    trie.insert(*row)
                part.close()
                yield from trie.owners()


def _walk(node: Node, prefix: bytes, late: list | None = None) -> Iterator[tuple[bytes, Owner]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        prefix += node.edge
        if node.spilled is not None:
            late.append(node.spilled)
            continue
        if node.owner is not None:
            yield prefix, node.owner
        if node.kids:
            stack += [(k, prefix) for k in node.kids.values()]


_HEAD = struct.Struct("<IBqqqi")


def _put(out, key: bytes, low, high, count, payload=None) -> None:
    out.write(_HEAD.pack(len(key), low is not None, low or 0, high or 0, count, -1 if payload is None else len(payload)))
    out.write(key)
    out.write(payload or b"")


def _get(src) -> Iterator[tuple]:
    while head := src.read(_HEAD.size):
        n, known, low, high, count, m = _HEAD.unpack(head)
        yield src.read(n), (low if known else None), (high if known else None), count, (src.read(m) if m >= 0 else None)
