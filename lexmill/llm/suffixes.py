"""Suffixes compared by hashes: common extensions by binary search over prefix hashes, and a merge sort of many groups at once."""

from __future__ import annotations

import numpy as np

from lexmill.llm import grams


class Text:
    """A text of bytes with prefix polynomial hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.prefix = data, grams.prefix_hash(data)
        self.down = grams._powers(len(self.prefix))[1]

    def hash(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.prefix[at + length] - self.prefix[at]) * self.down[at]

    def common(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes at x and y, at most ``limit``: a binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.asarray(limit, np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hash(x, mid) == self.hash(y, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, depth: int, or_equal: np.ndarray) -> np.ndarray:
        """Is the suffix at x before that at y, by their first ``depth`` bytes? Logarithmic in depth."""
        n = self.common(x, y, np.full(len(x), depth, np.int64))
        inside = np.minimum(n, depth - 1)
        return np.where(n == depth, or_equal, self.data[x + inside] < self.data[y + inside])

    def sort(self, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
        """Order that sorts the suffixes at ``at`` within groups (neighbours with equal ``group``): a bottom-up merge sort of all groups at once. Stable."""
        n = len(at)
        order = np.arange(n)
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else order
        sizes = np.diff(np.concatenate([begins, [n]]))
        begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        inner = order - begin
        width = 1
        while n and width < sizes.max():
            run = inner // width
            mate = np.where(run % 2 == 0, run + 1, run - 1) * width  # where the other run begins
            todo = np.flatnonzero(mate < size)
            low = np.minimum(mate[todo], size[todo])
            high = np.minimum(low + width, size[todo])
            first, left = low.copy(), run[todo] % 2 == 0
            own = at[order[todo]]
            while (open_ := low < high).any():
                o = np.flatnonzero(open_)
                mid = (low[o] + high[o]) >> 1
                other = at[order[begin[todo[o]] + mid]]
                # An element of the left run stands before its equals in the right one.
                before = self.less(other, own[o], depth, ~left[o])
                low[o] = np.where(before, mid + 1, low[o])
                high[o] = np.where(before, high[o], mid)
            start = np.minimum(run[todo] * width, mate[todo])
            place = begin[todo] + start + (inner[todo] - run[todo] * width) + (low - first)
            new = order.copy()
            new[place] = order[todo]
            order = new
            width *= 2
        return order

    def verified(self, at: np.ndarray, group: np.ndarray, depth: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, checked on the bytes, and which suffixes have the same first ``depth`` bytes as the one before them in their group.

        Groups where a collision of hashes has left a suffix out of its place are sorted anew by their bytes.
        """
        look = np.arange(depth)
        same, bad = np.zeros(len(at), bool), np.zeros(len(at), bool)

        def check(rows: np.ndarray) -> None:
            for s in range(0, len(rows), 20_000):
                r = rows[s : s + 20_000]
                x, y = (self.data[at[order[z]][:, None] + look] for z in (r - 1, r))
                differ = x != y
                place = differ.argmax(1)
                some = differ.any(1)
                same[r] = ~some
                i = np.arange(len(r))
                bad[r] = some & (x[i, place] > y[i, place])

        inner = np.flatnonzero(group[1:] == group[:-1]) + 1
        check(inner)
        if bad.any():
            wrong = np.isin(group, group[bad])
            own = np.flatnonzero(wrong)
            rows = self.data[at[own][:, None] + look]
            new = np.lexsort((own, *rows.T[::-1], group[own]))
            order = order.copy()
            order[own] = own[new]
            bad[:] = False
            check(inner[wrong[inner]])
        return order, same
