"""Content-chosen anchors of byte windows (winnowing), for many texts at once."""

from __future__ import annotations

import numpy as np

from lexmill.llm import grams


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbours, the leftmost of equal ones, by doubling."""
    at, have = np.arange(len(h), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        right = h[step:] < h[:-step]
        at = np.where(right, at[step:], at[:-step])
        h = np.where(right, h[step:], h[:-step])
        have += step
    return at


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int, prefix: np.ndarray | None = None):
    """Runs of windows of ``length`` bytes that choose the same anchor: the ``gram`` bytes of least hash inside, leftmost of equal ones.

    Returns arrays (text, anchor position, first window, last window, anchor hash); equal windows have equal anchors at
    equal places, wherever they lie. Windows never cross the end of a text.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - gram + 1
    wide = length - gram + 1
    if n < wide:
        return none, none, none, none, none.astype(np.uint64)
    prefix = grams.prefix_hash(data) if prefix is None else prefix
    _, down = grams._powers(len(prefix))
    h = grams.mixed((prefix[gram:] - prefix[: len(prefix) - gram]) * down[:n])
    at = window_argmin(h, wide)
    count = len(at)
    doc = np.repeat(np.arange(len(ends)), ends - starts)[:count]
    inside = np.arange(count) + length <= ends[np.minimum(doc, len(ends) - 1)]
    s = np.flatnonzero(inside)
    if not len(s):
        return none, none, none, none, none.astype(np.uint64)
    a, d = at[s], doc[s]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (d[1:] != d[:-1])) + 1
    begin = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(s)]]) - 1
    return d[begin], a[begin], s[begin], s[end], h[a[begin]]
