"""A minimal acyclic transducer: sorted words in, a shared-suffix automaton with summed outputs, one flat buffer out.

The outputs along a word's path add up to its position among the words, under which its ids are stored. The buffer is
meant to be memory-mapped; a lookup touches only the transitions on its path.
"""

from __future__ import annotations

import mmap
import os
import struct
from array import array

MAGIC = b"LEX1"
ENTRY = 4


def compile_words(entries: list[tuple[bytes, bytes]]) -> bytes:
    """entries: (word, packed ids) in any order, words distinct. Built word by word, each finished state being
    replaced by an equal one if there is one (so that suffixes are shared)."""
    entries = sorted(entries)
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    sizes: list[int] = []  # words accepted from a state

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        found = registry.get(key)
        if found is None:
            found = registry[key] = len(states)
            states.append(key)
            sizes.append(key[0] + sum(sizes[t] for _, t in key[1]))
        return found

    path: list[list] = [[False, []]]  # open states along the last word: [final, [(byte, state)]]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            done = frozen(path.pop())
            path[-1][1].append((last[len(path) - 1], done))

    for word, _ in entries:
        common = len(os.path.commonprefix([word, last]))
        close(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    close(0)
    root = frozen(path[0])
    first, labels, targets, skips, finals = array("I"), bytearray(), array("I"), array("I"), bytearray()
    for final, arcs in states:
        first.append(len(labels))
        finals.append(final)
        seen = int(final)
        for byte, target in arcs:
            labels.append(byte)
            targets.append(target)
            skips.append(seen)
            seen += sizes[target]
    first.append(len(labels))
    starts, ids = array("I", [0]), bytearray()
    for _, packed in entries:
        ids += packed
        starts.append(len(ids))
    parts = [bytes(x) for x in (finals, labels)] + [x.tobytes() for x in (first, targets, skips, starts)] + [bytes(ids)]
    padded = [p + b"\0" * (-len(p) % 4) for p in parts]
    head = struct.pack("<4sI7I", MAGIC, root, *map(len, parts))
    return head + b"".join(padded)


class Lexicon:
    """Read side of compile_words, over a memory map of the buffer."""

    def __init__(self, buffer: bytes):
        fd = os.memfd_create("lexicon")
        try:
            os.write(fd, buffer)
            self.map = mmap.mmap(fd, len(buffer), access=mmap.ACCESS_READ)
        finally:
            os.close(fd)
        magic, self.root, *sizes = struct.unpack_from("<4sI7I", self.map)
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        at, views, whole = 36, [], memoryview(self.map)
        for k, n in enumerate(sizes):
            part = whole[at : at + n]
            views.append(part.cast("I") if k in (2, 3, 4, 5) else part)
            if k == 1:
                self.labels_at = at
            at += n + -n % 4
        self.finals, _, self.first, self.targets, self.skips, self.starts, self.ids = views
        self.entry = self._entries(ENTRY)

    def _entries(self, depth: int) -> dict[bytes, tuple[int, int]]:
        """State and output after each prefix of `depth` bytes: most words that are not held end here."""
        level = {b"": (self.root, 0)}
        for _ in range(depth):
            level = {
                p + bytes([self.map[self.labels_at + arc]]): (self.targets[arc], out + self.skips[arc])
                for p, (state, out) in level.items()
                for arc in range(self.first[state], self.first[state + 1])
            }
        return level

    def get(self, word: bytes) -> bytes | None:
        """Packed ids of a word, None for one that is not held."""
        state, index, first, base, find = self.root, 0, self.first, self.labels_at, self.map.find
        if len(word) > ENTRY:
            at = self.entry.get(word[:ENTRY])
            if at is None:
                return None
            state, index = at
        for k in range(ENTRY if len(word) > ENTRY else 0, len(word)):
            arc = find(word[k : k + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            index += self.skips[arc]
            state = self.targets[arc]
        if not self.finals[state]:
            return None
        return bytes(self.ids[self.starts[index] : self.starts[index + 1]])
