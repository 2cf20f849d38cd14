"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

from lexmill.llm import grams

WIDTH = 5
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(WIDTH)]


def sets(texts: list[str | None], width: int = WIDTH, seed: int = 1) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending: every ``width`` words in a row, or all words of a shorter text as one; empty without words.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D. Two seeds give independent hashes.
    """
    raw = [(t or "").encode().lower() for t in texts]
    data, starts, ends = grams.laid(raw)
    begins, stops = grams.words(data, starts, ends)
    if not len(begins):
        return [np.zeros(0, np.uint64)] * len(texts)
    w = grams.word_hash(data, begins, stops, seed)
    first, last = np.searchsorted(begins, starts).tolist(), np.searchsorted(begins, ends).tolist()
    n = max(0, len(w) - width + 1)
    run = np.zeros(n, np.uint64)
    for i in range(width):
        run += w[i : i + n] * _STEP[i]
    run = grams.mixed(run)
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= width:
            s = np.sort(run[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            short = np.uint64((b - a) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            for i in range(b - a):
                short = np.uint64((int(short) + int(w[a + i]) * int(_STEP[i])) & (2**64 - 1))
            out.append(grams.mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a set: equal sets have equal keys."""
    both = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s), np.uint64(len(s))], np.uint64)
    h = grams.mixed(both)
    return int(grams.mixed(h[:1] + (h[1:2] << np.uint64(1)) + h[2:] * np.uint64(3)).view(np.int64)[0])
