"""Deep-shallow suffix sorting of short suffixes.

Suffixes are ordered by multikey quicksort on words of eight bytes down to a shallow depth. Groups that still agree there go into
a blind trie each, which looks at branching bytes only on the way down, compares once with the leaf it ends at, and gives
the order and the common prefixes of the group.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the rows of ``words`` (big-endian words of each suffix), and the ranges of it in which all words agree."""
    order = np.arange(len(words))
    depths = words.shape[1]
    equal: list[tuple[int, int]] = []
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low == 1:
            continue
        if depth == depths:
            equal.append((low, high))
            continue
        part = order[low:high]
        key = words[part, depth]
        if high - low > 2:
            pivot = np.partition(key[[0, len(key) // 2, -1]], 1)[1]
        else:
            pivot = key.min()
        less, more = key < pivot, key > pivot
        a, b = low + int(less.sum()), high - int(more.sum())
        if a == low and b == high:
            stack.append((low, high, depth + 1))
            continue
        order[low:high] = np.concatenate([part[less], part[~less & ~more], part[more]])
        for begin, end, next_depth in ((low, a, depth), (a, b, depth + 1), (b, high, depth)):
            if begin < end:
                stack.append((begin, end, next_depth))
    return order, sorted(equal)


class BlindTrie:
    """Strings of at most ``width`` bytes in order, by their branching bytes. Ends sort before bytes."""

    def __init__(self, width: int):
        self.width, self.texts, self.numbers = width, [], []
        self.root: list | None = None  # a leaf is [None, places]; a branch is [depth, {byte or -1: child}]

    def _common(self, a: int, b: int) -> int:
        differ = (self.numbers[a] ^ self.numbers[b]).bit_length()
        return min(self.width - (differ + 7) // 8, len(self.texts[a]), len(self.texts[b]))

    def add(self, text: bytes) -> None:
        place = len(self.texts)
        self.texts.append(text)
        self.numbers.append(int.from_bytes(text.ljust(self.width, b"\0"), "big"))
        if self.root is None:
            self.root = [None, [place]]
            return
        node = self.root
        while node[0] is not None:  # blind: a byte without a branch takes any
            branches = node[1]
            node = branches.get(text[node[0]] if node[0] < len(text) else -1) or next(iter(branches.values()))
        other = node[1][0]
        common = self._common(place, other)
        if common == len(text) == len(self.texts[other]):
            node[1].append(place)
            return
        mine = text[common] if common < len(text) else -1
        parent, edge, node = None, None, self.root
        while node[0] is not None and node[0] < common:
            parent, edge = node, text[node[0]]
            node = parent[1][edge]
        if node[0] == common:
            node[1][mine] = [None, [place]]
            return
        known = self.texts[other]
        branch = [common, {(known[common] if common < len(known) else -1): node, mine: [None, [place]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][edge] = branch

    def sorted(self) -> tuple[list[int], list[int]]:
        """Places in order, and the common prefix of each with the one before it (0 for the first)."""
        order: list[int] = []
        common: list[int] = []
        stack = [(self.root, 0)] if self.root else []
        while stack:
            node, shared = stack.pop()
            if node[0] is None:
                order += node[1]
                common += [shared, *[len(self.texts[node[1][0]])] * (len(node[1]) - 1)]
            else:
                edges = sorted(node[1], reverse=True)
                stack += [(node[1][e], shared if e == edges[-1] else node[0]) for e in edges]
        return order, common


def blind_order(texts: list[bytes], width: int) -> tuple[list[int], list[int]]:
    trie = BlindTrie(width)
    for text in texts:
        trie.add(text)
    return trie.sorted()


def as_words(texts: list[bytes], depth: int) -> np.ndarray:
    """The first ``depth`` bytes (a multiple of eight) of each text as big-endian words; short texts end in zeros."""
    raw = b"".join([t[:depth].ljust(depth, b"\0") for t in texts])
    return np.frombuffer(raw, ">u8").reshape(len(texts), depth // WORD).astype(np.uint64)
