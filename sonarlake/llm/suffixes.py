"""Deep-shallow sorting of strings in a text, for one task's worth of text.

A multikey sort orders strings by eight bytes at a time down to a shallow depth: parts that agree so far are sorted by
their next eight bytes, all parts of a depth in one numpy sort. Strings that still agree
share a long prefix; those groups go into a blind trie each, which keeps branching depths only: a string walks
down blindly, is compared once with the leaf it meets, and branches off where the two first differ. Strings that
agree throughout end in one leaf, so equal strings are found as neighbours in the sorted order and nowhere else.

Defined cases: a string that begins another comes before it; equal strings keep the order of their places; no
strings give no groups; strings may be of any length from SHALLOW bytes on.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the multikey sort compares.
SHALLOW = 24
#: What stands after the end of a string.
_END = -1


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 64
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    while step > 1:  # the first difference is within step bytes from low
        step //= 2
        if a[low : low + step] == b[low : low + step]:
            low += step
    return low


class BlindTrie:
    """Strings in order, equal ones together."""

    def __init__(self):
        self.root = None

    def insert(self, s: bytes, value) -> None:
        node = self.root
        if node is None:
            self.root = [s, [value]]
            return
        n = len(s)
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(s[depth] if depth < n else _END) or next(iter(children.values()))
        leaf = node[0]
        if leaf == s:
            node[1].append(value)
            return
        at = common_prefix(leaf, s)
        old = leaf[at] if at < len(leaf) else _END
        own = s[at] if at < n else _END
        node, parent = self.root, None
        while isinstance(node, tuple) and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        new = [s, [value]]
        if isinstance(node, tuple) and node[0] == at:
            node[1][own] = new
            return
        split = (at, {old: node, own: new})
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]]] = split

    def leaves(self):
        """The lists of equal strings, in order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def _shallow_order(text: np.ndarray, places: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the places in the order of their first ``shallow`` bytes, and where in it a part that agrees in them begins.

    Eight bytes at a time: a part whose bytes so far agree is sorted by its next word, and all parts of a depth at once. What
    stands alone has its place and is not looked at again.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray(len(text) + 1, ">u8", padded, strides=(1,))  # the word at each place
    order, new = np.arange(len(places)), np.zeros(len(places), bool)
    new[:1] = True
    for depth in range(0, shallow, 8):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        # The last word may begin in bytes that agree.
        key = words[places[order[tied]] + max(0, min(depth, shallow - 8))].astype(np.uint64)
        if shallow < 8:
            key >>= np.uint64(8 * (8 - shallow))
        sub = np.lexsort((key, np.cumsum(new)[tied])) if depth else np.argsort(key, kind="stable")
        order[tied], key = order[tied[sub]], key[sub]
        new[tied[1:]] |= key[1:] != key[:-1]
    return order, np.flatnonzero(new)


def shallow_groups(text: np.ndarray, places: np.ndarray, shallow: int = SHALLOW):
    """Yields the numbers of the places in the order of their text, as lists that agree in their first ``shallow`` bytes."""
    order, first = _shallow_order(text, places, shallow)
    for part in np.split(order, first[1:]):
        yield part.tolist()


def equal_strings(text: np.ndarray, places: np.ndarray, sizes: np.ndarray | int, shallow: int = SHALLOW):
    """Yields, in the order of their text, the groups of at least two places (by number) whose strings agree.

    sizes: the bytes of each string from its place on, or of all of them.
    """
    whole = text.tobytes()
    at, ends = places.tolist(), (places + sizes).tolist()
    order, first = _shallow_order(text, places, min(shallow, int(np.min(sizes)) if len(places) else 0))
    size = np.diff(first, append=len(order))
    first, order = first[size > 1], order.tolist()
    for a, b in zip(first.tolist(), (first + size[size > 1]).tolist(), strict=True):
        part = order[a:b]
        strings = [whole[at[k] : ends[k]] for k in part]
        if strings.count(strings[0]) == len(part):  # the trie has one leaf, which all were compared with
            yield part
        elif len(part) > 2:  # two that differ are two leaves
            trie = BlindTrie()
            for s, k in zip(strings, part, strict=True):
                trie.insert(s, k)
            for leaf in trie.leaves():
                if len(leaf) > 1:
                    yield leaf
