"""A compressed trie over whole byte strings."""

from __future__ import annotations

from collections.abc import Iterator


class Trie:
    """Byte strings, each with the least of the ids it was put in with.

    An edge holds all bytes up to the next fork, so that a string costs its own bytes once and one
    step per fork on its way. ``size`` is the sum of the bytes on all edges.
    """

    def __init__(self) -> None:
        # A node is [edges by their first byte, number of the string that ends here or -1]; an edge is (bytes, node).
        self._root: list = [{}, -1]
        self.least: list[int | None] = []
        self.size = 0

    def put(self, text: bytes, key: int | None) -> int:
        """Puts the string in and returns its number; equal strings have one number. A null id counts for nothing."""
        node, at = self._root, 0
        while at < len(text):
            edge = node[0].get(text[at])
            if edge is None:
                end = [{}, -1]
                node[0][text[at]] = (text[at:], end)
                self.size += len(text) - at
                node, at = end, len(text)
                break
            label, below = edge
            if not text.startswith(label, at):
                shared = _shared(label, text, at)
                below = [{label[shared]: (label[shared:], below)}, -1]
                node[0][text[at]] = (label[:shared], below)
                label = label[:shared]
            node, at = below, at + len(label)
        if node[1] < 0:
            node[1] = len(self.least)
            self.least.append(key)
        elif key is not None:
            known = self.least[node[1]]
            self.least[node[1]] = key if known is None else min(known, key)
        return node[1]

    def __iter__(self) -> Iterator[tuple[bytes, int | None]]:
        """The strings in byte order with their least ids."""
        stack = [(b"", self._root)]
        while stack:
            before, (edges, number) = stack.pop()
            if number >= 0:
                yield before, self.least[number]
            stack += [(before + edges[first][0], edges[first][1]) for first in sorted(edges, reverse=True)]


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of the label the text has at a place, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low
