"""Deep-shallow sorting of byte strings, and what repeats around an anchor.

Strings are sorted by multikey quicksort on eight bytes at a time down to a shallow depth. Groups
that still agree there share a long prefix, which more digits would read again and again; they go
into a blind trie, which holds only where strings branch: a search follows branching bytes without
looking between them, and one comparison with the leaf it ends in tells the common prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

DIGIT = 8
SHALLOW = 32
#: Up to so many contexts, an anchor's contexts are compared along the sorted order one by one.
FEW = 24


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differs.bit_length() + 7) // 8


def _byte(string: bytes, at: int) -> int:
    """Byte of a string, below all bytes where it has ended."""
    return string[at] if at < len(string) else -1


class BlindTrie:
    """Branching depths only. A node is (depth, children by byte); a leaf lists equal strings."""

    def __init__(self, strings: Sequence[bytes]) -> None:
        self.strings, self.root = strings, None

    def add(self, number: int) -> None:
        string = self.strings[number]
        if self.root is None:
            self.root = [number]
            return
        path, node = [], self.root
        while isinstance(node, tuple):
            path.append(node)
            depth, children = node
            node = children.get(_byte(string, depth)) or next(iter(children.values()))
        other = self.strings[node[0]]
        shared = common_prefix(string, other)
        if shared == len(string) == len(other):
            node.append(number)
            return
        above = None
        for place in (*path, node):
            if isinstance(place, tuple) and place[0] < shared:
                above = place
                continue
            if isinstance(place, tuple) and place[0] == shared:
                place[1][_byte(string, shared)] = [number]
            else:
                split = (shared, {_byte(string, shared): [number],
                                  _byte(other, shared): place})
                if above is None:
                    self.root = split
                else:
                    above[1][_byte(string, above[0])] = split
            return

    def order(self) -> list[int]:
        found, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                found += node
            else:
                stack += [node[1][byte] for byte in sorted(node[1], reverse=True)]
        return found


def deep_shallow_sort(strings: Sequence[bytes], shallow: int = SHALLOW) -> list[int]:
    """Numbers of the strings in lexicographic order."""
    found: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            found += group
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for number in group:
                trie.add(number)
            found += trie.order()
        else:
            digits = [strings[i][depth:depth + DIGIT] for i in group]
            pivot = digits[len(digits) // 2]
            below, same, above = [], [], []
            for i, digit in zip(group, digits):
                (same if digit == pivot else below if digit < pivot else above).append(i)
            stack += [(above, depth), (same, depth + DIGIT), (below, depth)]
    return found


def neighbours(strings: Sequence[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order, and the common prefix of each string with the one before it."""
    order = deep_shallow_sort(strings)
    return order, [0, *[common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]]


def repeated_offsets(lefts: Sequence[bytes], rights: Sequence[bytes], counts: Sequence[int],
                     length: int, most_left: int) -> list[tuple[int, int] | None]:
    """Least and greatest offset at which a repeated string of `length` bytes holds the anchor.

    `lefts` and `rights` are distinct contexts before (read backwards) and from the anchor; at
    offset d, the string is the last d bytes before it and the first length - d from it. It repeats
    if a context occurs twice or two share d bytes before and length - d bytes from the anchor.
    """
    n = len(lefts)
    least, greatest = [length] * n, [-1] * n

    def add(i: int, low: int, high: int) -> None:
        if low <= high:
            least[i], greatest[i] = min(least[i], low), max(greatest[i], high)

    for i in range(n):
        if counts[i] > 1:
            add(i, max(0, length - len(rights[i])), min(most_left, len(lefts[i])))
    if n > 1 and n <= FEW:
        order, shared = neighbours(rights)
        for a in range(n):
            right = length
            for b in range(a + 1, n):
                right = min(right, shared[b])
                if right < length - most_left:
                    break
                i, j = order[a], order[b]
                left = min(most_left, common_prefix(lefts[i], lefts[j]))
                add(i, max(0, length - right), left)
                add(j, max(0, length - right), left)
    elif n > 1:
        _by_class(lefts, rights, length, most_left, add)
    return [(a, b) if b >= 0 else None for a, b in zip(least, greatest)]


def _by_class(lefts, rights, length: int, most_left: int, add) -> None:
    """The same for many contexts: at each offset, those in one class on both sides repeat."""
    n = len(lefts)
    right_order, right_shared = map(np.array, neighbours(rights))
    left_order, left_shared = map(np.array, neighbours(lefts))
    left_size, right_size = (np.array([len(x) for x in side]) for side in (lefts, rights))
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    least, greatest = np.full(n, length), np.full(n, -1)
    state, twice = None, None
    for d in range(most_left + 1):
        cut_right, cut_left = right_shared < length - d, left_shared < d
        long = (left_size >= d) & (right_size >= length - d)
        now = cut_right.tobytes() + cut_left.tobytes() + long.tobytes()
        if now != state:
            state = now
            right_class[right_order] = np.cumsum(cut_right)
            left_class[left_order] = np.cumsum(cut_left)
            _, at, times = np.unique(left_class * (n + 1) + right_class, return_inverse=True,
                                     return_counts=True)
            twice = np.flatnonzero(long & (times[at] > 1))
        least[twice] = np.minimum(least[twice], d)
        greatest[twice] = d
    for i in np.flatnonzero(greatest >= 0):
        add(int(i), int(least[i]), int(greatest[i]))
