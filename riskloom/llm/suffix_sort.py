"""Deep-shallow sorting of byte strings of equal width, with common prefixes.

Shallow: multikey sorting, eight bytes a pass, down to ``SHALLOW`` bytes, only
among rows that are still equal.  Deep: what is left are groups with long
common prefixes.  Equal strings are taken together first, and each group goes
into a blind trie, which looks at no byte but where its strings branch; walking
the trie gives the order and, at the branches, the common prefixes.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


class BlindTrie:
    """Distinct strings of equal width; inner nodes hold only the depth at
    which their children differ."""

    def __init__(self, width: int):
        self.width = width
        self.depth: list[int] = []          # inner nodes
        self.next: list[dict] = []          # first byte after depth -> child
        self.root = None                    # inner node >= 0, leaf ~row

    def add(self, row: int, text: bytes, strings) -> None:
        if self.root is None:
            self.root = ~row
            return
        at, path = self.root, []
        while at >= 0:                      # blind walk: only branching bytes
            path.append(at)
            child = self.next[at].get(text[self.depth[at]])
            at = next(iter(self.next[at].values())) if child is None else child
        other = strings[~at]
        d = next(k for k in range(self.width) if text[k] != other[k])
        above = None
        for node in path:                   # where the real branch is
            if self.depth[node] >= d:
                break
            above = node
        below = self.root if above is None else self.next[above][text[self.depth[above]]]
        if below >= 0 and self.depth[below] == d:
            self.next[below][text[d]] = ~row
            return
        self.depth.append(d)
        self.next.append({other[d]: below, text[d]: ~row})
        new = len(self.depth) - 1
        if above is None:
            self.root = new
        else:
            self.next[above][text[self.depth[above]]] = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """Rows in order, and the common prefix of each with the one before
        (the depth of the branch between them; 0 for the first)."""
        rows, lcp, stack = [], [], [(self.root, 0)]
        while stack:
            at, common = stack.pop()
            if at < 0:
                rows.append(~at)
                lcp.append(common)
                continue
            d = self.depth[at]
            kids = [self.next[at][c] for c in sorted(self.next[at])]
            stack += [(k, common if i == 0 else d) for i, k in reversed(list(enumerate(kids)))]
        return rows, lcp


def deep_shallow(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix and, in that order, each row's
    common prefix with the row before it (0 for the first)."""
    n, width = m.shape
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = m
    words = padded.view(">u8").astype(np.uint64)
    whole = np.ascontiguousarray(m).view(f"V{width}").ravel()
    # shallow: passes of eight bytes inside groups that are still equal
    order = np.argsort(words[:, 0], kind="stable")
    group = np.concatenate([[0], np.cumsum(words[order[1:], 0] != words[order[:-1], 0])])
    for k in range(1, min(SHALLOW // 8, words.shape[1])):
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        rows, g = order[tied], group[tied]
        order[tied] = rows[np.lexsort((words[rows, k], g))]
        new = np.concatenate([[False], (group[1:] != group[:-1]) | (words[order[1:], k] != words[order[:-1], k])])
        group = np.cumsum(new)
    # deep: equal strings together, then a blind trie for each group left
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(tied) and width > SHALLOW:
        rows, g = order[tied], group[tied]
        _, first, same = np.unique(whole[rows], return_index=True, return_inverse=True)
        place = first[same]                               # a row of equal text stands for all
        cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        rank = np.zeros(len(rows), np.int64)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            kinds = np.unique(place[s:e])
            if len(kinds) == 1:
                continue
            strings = {int(i): m[rows[i]].tobytes() for i in kinds}
            trie = BlindTrie(width)
            for i, text in strings.items():
                trie.add(i, text, strings)
            for r, i in enumerate(trie.ordered()[0]):
                rank[i] = r
        order[tied] = rows[np.lexsort((rank[place], g))]
    # common prefixes with the row before, on eight bytes at a time
    a, b = words[order[1:]], words[order[:-1]]
    differ = a != b
    any_ = differ.any(axis=1)
    k = differ.argmax(axis=1)
    at = np.arange(n - 1)
    x = a[at, k] ^ b[at, k]
    lead = np.zeros(n - 1, np.int64)
    for shift in range(7, 0, -1):                         # leading equal bytes of the word
        lead += (x >> np.uint64(8 * shift)) == 0
    lcp = np.where(any_, np.minimum(k * 8 + lead, width), width)
    return order, np.concatenate([[0], lcp])
