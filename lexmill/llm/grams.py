"""Hashed word and character n-gram features of many texts at once, as numpy arrays.

Texts are laid end to end as bytes. A gram's bucket comes from its bytes alone; sums over a text are differences of
prefix sums, so scoring never builds a feature table.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0x5851F42D4C957F2D)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and where each text begins and ends."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64) if texts else ends, ends


def gram_buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes (8 at most) that begin at each position."""
    count = max(0, len(data) - n + 1)
    h = data[:count].astype(np.uint64)
    for i in range(1, n):
        h <<= np.uint64(8)
        h |= data[i : i + count]
    h += np.uint64(n << 56)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    h >>= np.uint64(64 - bits)
    return h.astype(np.int64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; a word never crosses the end of its text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner] = ink[inner]
    begins = np.flatnonzero(first)
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[inner - 1] = ink[inner - 1]
    return begins, np.flatnonzero(last) + 1


_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_BYTES = (np.random.default_rng(20_011).integers(0, 1 << 63, 256, np.uint64) << np.uint64(1)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = powers(_WORD_BASE, n), powers(_INVERSE, n)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum of byte values times base powers over i..j, modulo 2**64."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span from a prefix hash: equal spans give equal values wherever they lie."""
    _, down = _powers(len(prefix))
    return mixed((prefix[ends] - prefix[begins]) * down[begins] + (ends - begins).astype(np.uint64))


_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Words up to so many bytes are hashed together, eight bytes a step; a longer one by itself.
_TOGETHER = 64


def word_hash(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span under a seed. Every eight bytes pass a nonlinear mix, so no arithmetic between bytes' powers can cancel out, as it can in a polynomial modulo 2**64."""
    import xxhash

    n = ends - begins
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mixed(n.astype(np.uint64) + np.uint64(seed * int(_MIX) % (1 << 64)))
    at = np.flatnonzero(n <= _TOGETHER)
    for k in range(0, _TOGETHER, 8):
        at = at[n[at] > k]
        if not len(at):
            break
        h[at] = mixed((h[at] ^ (eight[begins[at] + k] & _TAIL[np.minimum(n[at] - k, 8)])) + _WORD_BASE)
    for i in np.flatnonzero(n > _TOGETHER).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begins[i] : ends[i]], seed)
    return h


def size(grams: tuple[int, ...], bits: int) -> int:
    """How many buckets :func:`features` uses."""
    return ((len(grams) + 1) << bits) + 2


def features(texts: list[bytes], grams: tuple[int, ...], bits: int, pairs: bool = False):
    """Yields (buckets, begin, end of each text's part of them) for each kind of feature; a kind's buckets lie in a range of their own.

    The kinds are byte n-grams, words, and with ``pairs`` those of neighbouring words, told apart only by whether both are the same word.
    """
    data, starts, ends = laid(texts)
    for k, n in enumerate(grams):
        b = gram_buckets(data, n, bits) + (k << bits)
        stop = np.minimum(np.maximum(ends - n + 1, starts), len(b))
        yield b, np.minimum(starts, len(b)), stop
    begins, stops = words(data, starts, ends)
    h = span_hash(prefix_hash(data), begins, stops) if len(begins) else np.zeros(0, np.uint64)
    first, stop = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
    yield (h >> np.uint64(64 - bits)).astype(np.int64) + (len(grams) << bits), first, stop
    if not pairs:
        return
    pair = np.full(len(h), size(grams, bits) - 2, np.int64)
    pair[1:] += h[1:] == h[:-1]
    yield pair, np.minimum(first + 1, stop), stop


def mean_score(texts: list[bytes], weights: np.ndarray, grams: tuple[int, ...], bits: int, pairs: bool = False) -> np.ndarray:
    """For each text, the mean of its features' weights: (texts, columns of weights); zero without features."""
    total, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for b, first, stop in features(texts, grams, bits, pairs):
        count += stop - first
        for c in range(weights.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(weights[b, c], dtype=np.float64)])
            total[:, c] += sums[stop] - sums[first]
    return total / np.maximum(count, 1)[:, None]


def rows(texts: list[bytes], grams: tuple[int, ...], bits: int, pairs: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct features and their shares; for training."""
    kinds = list(features(texts, grams, bits, pairs))
    out = []
    for i in range(len(texts)):
        own = np.concatenate([b[first[i] : stop[i]] for b, first, stop in kinds])
        f, n = np.unique(own, return_counts=True)
        out.append((f, (n / max(1, len(own))).astype(np.float32)))
    return out
