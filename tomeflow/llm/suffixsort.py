"""Deep-shallow sorting of suffixes, many groups at a time.

Shallow: a multikey quicksort over characters of 8 bytes, all groups of ties advancing together, to SHALLOW
bytes. Deep: each group that still ties has a long common prefix and is ordered by a blind trie, whose nodes
hold only where strings branch, so that a string is compared once however long the prefix is.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


class BlindTrie:
    """Strings of one length in order, with equal strings together.

    A node is (depth, {byte: node}); a leaf is a list of the indexes of equal strings.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | tuple | None = None

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        """Length of the common prefix of strings of one length."""
        if a == b:
            return len(a)
        x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        return len(a) - (x.bit_length() + 7) // 8

    @staticmethod
    def leaf(node: list | tuple) -> bool:
        return isinstance(node, list)

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        s = self.strings[i]
        # Descend blindly by branching bytes to any leaf, then compare once.
        node = self.root
        while not self.leaf(node):
            nxt = node[1].get(s[node[0]])
            node = nxt if nxt is not None else next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = self.common(s, other)
        if depth == len(s):
            node.append(i)
            return
        # Insert where the path passes that depth.
        above, node = None, self.root
        while not self.leaf(node) and node[0] < depth:
            above = node
            node = node[1][s[node[0]]]
        if not self.leaf(node) and node[0] == depth:
            node[1][s[depth]] = [i]
            return
        split = (depth, {other[depth]: node, s[depth]: [i]})
        if above is None:
            self.root = split
        else:
            above[1][s[above[0]]] = split

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if self.leaf(node):
                out.extend(node)
            else:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        return out


def deep_shallow(groups: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows (bytes, equal lengths) sorted within their groups, groups in a row.

    lcp[j] is the length of the prefix that row order[j] shares with the one before, -1 where a group begins.
    """
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    first = np.concatenate([[True], groups[order][1:] != groups[order][:-1]])
    starts = first.copy()
    for level in range(min(SHALLOW // 8, words.shape[1])):
        tie_id = np.cumsum(starts) - 1
        size = np.bincount(tie_id)
        open_ = np.flatnonzero(size[tie_id] > 1)  # places whose ties go on
        if not len(open_):
            break
        w = words[order[open_], level]
        sub = np.lexsort((w, tie_id[open_]))
        order[open_] = order[open_][sub]
        w, t = w[sub], tie_id[open_]
        starts[open_[1:]] |= (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    begin = np.flatnonzero(starts)
    end = np.concatenate([begin[1:], [n]])
    for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        members = order[a:b]
        tail = rows[members][:, SHALLOW:] if width > SHALLOW else rows[members][:, :0]
        if tail.shape[1] and (tail != tail[0]).any():
            trie = BlindTrie([r.tobytes() for r in tail])
            for i in range(len(members)):
                trie.insert(i)
            order[a:b] = members[trie.order()]
    sorted_rows = rows[order]
    lcp = np.full(n, -1, np.int64)
    differ = sorted_rows[1:] != sorted_rows[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    lcp[first] = -1
    return order, lcp
