"""Subword (byte-pair) model: learned from word counts, applied to distinct words."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.sources import scratch

#: Merges after which words that are whole are let go of.
_RENEW = 200

#: Pairs that are kept in order, of the most frequent ones.
_HEAP = 1 << 14


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(T.matches(text, r"\w+|[^\w\s]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def learn(counts: list[tuple[str, int]], vocabulary: int) -> list[tuple[str, str]]:
    """Merges in order; the most frequent pair first, ties to the smaller pair. Pair counts are kept up to date, not counted anew."""
    words = [(list(w), n) for w, n in counts]
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, (w, n) in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            pairs[p] += n
            where[p].add(i)
    size = len({c for w, _ in words for c in w}) + 1
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    merges = []
    while size + len(merges) < vocabulary and heap:
        n, best = heapq.heappop(heap)
        if pairs.get(best, 0) != -n or n == 0:
            continue
        merges.append(best)
        changed = set()
        for i in where.pop(best):
            w, k = words[i]
            for p in zip(w, w[1:], strict=False):
                pairs[p] -= k
                changed.add(p)
            new, j = [], 0
            while j < len(w):
                if j + 1 < len(w) and (w[j], w[j + 1]) == best:
                    new.append(w[j] + w[j + 1])
                    j += 2
                else:
                    new.append(w[j])
                    j += 1
            words[i] = (new, k)
            for p in zip(new, new[1:], strict=False):
                pairs[p] += k
                where[p].add(i)
                changed.add(p)
        pairs.pop(best, None)
        for p in changed:
            if pairs.get(p, 0) > 0:
                heapq.heappush(heap, (-pairs[p], p))
    return merges


def _laid(words: pa.Array | pa.ChunkedArray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Symbols of all words, a 0 after each word; where words begin; the alphabet (symbol i is its i-1st character). Slice by slice, as only the result need fit."""

    def slices():
        for at in range(0, len(words), 100_000):  # no word has a line's end in it
            yield np.frombuffer(("\n".join(words.slice(at, 100_000).to_pylist()) + "\n").encode("utf-32-le"), np.uint32)

    seen, n = np.zeros(0x110000, bool), 0
    for x in slices():
        seen[x] = True
        n += len(x)
    seen[10] = False
    chars = np.flatnonzero(seen)
    kind = np.int16 if max(len(chars) + 1, vocabulary) + 1 < 1 << 15 else np.int32
    code = np.zeros(0x110000, kind)
    code[chars] = np.arange(1, len(chars) + 1)
    sym, begins, at = np.zeros(n, kind), [np.zeros(0, np.int64)], 0
    for x in slices():
        sym[at : at + len(x)] = code[x]
        begins.append(at + np.concatenate([[0], np.flatnonzero(x == 10)[:-1] + 1]))
        at += len(x)
    return sym, np.concatenate(begins), [chr(c) for c in chars]


def learn_all(words: pa.Array | pa.ChunkedArray, counts: np.ndarray, vocabulary: int) -> tuple[list[tuple[str, str]], int]:
    """Merges as :func:`learn` has them, and the size of the alphabet; words lie in one array, so that millions fit a task."""
    sym, begins, names = _laid(words, vocabulary)
    base, counts = len(names), np.asarray(counts, np.int64)
    names = ["", *names]
    most = max(base + 1, vocabulary) + 1
    pairs: dict[int, int] = {}

    def count(a, b, n):
        """Codes of pairs and their sums of n."""
        code, at = np.unique(a.astype(np.int64) * most + b, return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, at, n)
        return code, total

    for at in range(0, len(begins), 100_000):
        some = begins[at : at + 100_000]
        x = sym[some[0] : begins[at + 100_000] if at + 100_000 < len(begins) else len(sym)]
        here = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
        of = np.searchsorted(some - some[0], here, "right") - 1
        for c, n in zip(*(v.tolist() for v in count(x[here], x[here + 1], counts[at : at + 100_000][of])), strict=True):
            pairs[c] = pairs.get(c, 0) + n
    named = lambda c: (names[c // most], names[c % most])
    heap, least, full = [], 0, 0

    def filled():
        """The most frequent pairs, and the least count among them: rarer ones wait until these are used up."""
        n = np.fromiter(pairs.values(), np.int64, len(pairs))
        low = int(np.partition(n, -_HEAP)[-_HEAP]) if len(n) > _HEAP else 0
        made = [(-k, named(c), c) for c, k in pairs.items() if k >= low]
        heapq.heapify(made)
        return made, low

    merges: list[tuple[str, str]] = []
    # Two pairs may spell the same string; it is one symbol to learn() and so it is here.
    ids = {s: i for i, s in enumerate(names)}
    while base + 1 + len(merges) < vocabulary and pairs:
        if not heap or len(heap) > full:
            heap, least = filled()
            full = 4 * max(_HEAP, len(heap))
        n, best, c = heapq.heappop(heap)
        if pairs.get(c, 0) != -n or n == 0:
            continue
        if len(merges) % _RENEW == _RENEW - 1:
            size = np.diff(np.append(begins, len(sym)))
            two = np.flatnonzero(sym[np.minimum(begins + 1, len(sym) - 1)] != 0)
            keep = np.zeros(len(sym), bool)
            keep[sym != 0] = True
            open_ = np.zeros(len(begins), bool)
            open_[two] = True
            keep &= np.repeat(open_, size)
            length = np.add.reduceat(keep, begins, dtype=np.int64)[two] if len(two) else np.zeros(0, np.int64)
            begins = np.concatenate([[0], np.cumsum(length + 1)])
            fresh = np.zeros(begins[-1], sym.dtype)
            place = np.ones(len(fresh), bool)
            place[begins[1:] - 1] = False
            fresh[place] = sym[keep]
            sym, begins, counts = fresh, begins[:-1], counts[two]
            del keep, place, size
        merges.append(best)
        a, b = c // most, c % most
        joined = ids.setdefault(best[0] + best[1], len(names))
        if joined == len(names):
            names.append(best[0] + best[1])
        here = np.flatnonzero(sym[:-1] == a)
        here = here[sym[here + 1] == b]
        own = np.unique(np.searchsorted(begins, here, "right") - 1)
        end = np.append(begins[1:], len(sym))[own] if len(own) < 1000 else np.append(begins, len(sym))[own + 1]
        size = end - begins[own]
        first = np.cumsum(size) - size
        at = np.repeat(begins[own] - first, size) + np.arange(size.sum())
        x, k = sym[at].astype(np.int64), np.repeat(counts[own], size)
        hit = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
        if a == b:  # of a run every other one, from the left
            run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
        y = x.copy()
        y[hit] = joined
        y[hit + 1] = 0
        # Symbols of each word move to its beginning.
        there = np.flatnonzero(y)
        of = np.repeat(np.arange(len(own)), size)[there]
        many = np.bincount(of, minlength=len(own))
        z = np.zeros(len(y), np.int64)
        z[first[of] + np.arange(len(there)) - (np.cumsum(many) - many)[of]] = y[there]
        sym[at] = z
        old, new = (np.flatnonzero((v[:-1] != 0) & (v[1:] != 0)) for v in (x, z))
        codes, sums = count(np.concatenate([x[old], z[new]]), np.concatenate([x[old + 1], z[new + 1]]), np.concatenate([-k[old], k[new]]))
        for p, d in zip(codes.tolist(), sums.tolist(), strict=True):
            if d:
                pairs[p] = pairs.get(p, 0) + d
                if pairs[p] >= max(1, least):
                    heapq.heappush(heap, (-pairs[p], named(p), p))
                elif pairs[p] <= 0:
                    del pairs[p]
    return merges, base


def train(docs: DataFrame, vocabulary: int = 1000, text: str = "text") -> list[tuple[str, str]]:
    return _train(word_counts(docs, text), vocabulary)[0]


def _train(counts: DataFrame, vocabulary: int) -> tuple[list[tuple[str, str]], int]:
    """Learns from all distinct words in a task: they lie packed in an executor, and only the merges come to the driver."""

    def run(batches):
        parts = list(batches)
        words = pa.chunked_array([p.column(0) for p in parts], pa.string())
        n = pa.chunked_array([p.column(1) for p in parts], pa.int64()).to_numpy()
        del parts
        merges, base = learn_all(words, n, vocabulary)
        yield pa.RecordBatch.from_pydict({"a": [None, *(a for a, _ in merges)], "b": [None, *(b for _, b in merges)], "base": [base] * (len(merges) + 1)}, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("base", pa.int64())]))

    rows = counts.select("word", "n").repartition(1).mapInArrow(run, "a string, b string, base long").toArrow().to_pylist()
    return [(r["a"], r["b"]) for r in rows if r["a"] is not None], max((r["base"] for r in rows), default=0)


def split_word(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    w = list(word)
    while len(w) > 1:
        at = min(range(len(w) - 1), key=lambda i: rank.get((w[i], w[i + 1]), len(rank)))
        best = (w[at], w[at + 1])
        if best not in rank:
            break
        new, j = [], 0
        while j < len(w):
            if j + 1 < len(w) and (w[j], w[j + 1]) == best:
                new.append(w[j] + w[j + 1])
                j += 2
            else:
                new.append(w[j])
                j += 1
        w = new
    return w


def split_sizes(word: str, rank: dict[tuple[str, str], int], limits: list[int]) -> list[int]:
    """Number of pieces with the first so many merges, for each limit: a merge makes only pairs of later ones, so one pass goes through all."""
    w, none = list(word), len(rank)
    ranks = [rank.get(p, none) for p in zip(w, w[1:], strict=False)]
    found = {}
    while True:
        low = min(ranks, default=none)
        for m in limits:
            if m <= low and m not in found:
                found[m] = len(w)
        if low == none:
            return [found.get(m, len(w)) for m in limits]
        best = (w[at := ranks.index(low)], w[at + 1])
        new, j = [], 0
        while j < len(w):
            if j + 1 < len(w) and w[j] == best[0] and w[j + 1] == best[1]:
                new.append(best[0] + best[1])
                j += 2
            else:
                new.append(w[j])
                j += 1
        w = new
        ranks = [rank.get(p, none) for p in zip(w, w[1:], strict=False)]


def pieces(words: DataFrame, merges: list[tuple[str, str]], word: str = "word") -> DataFrame:
    """word, pieces of each distinct word."""
    rank = {p: i for i, p in enumerate(merges)}

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda w: split_word(w, rank))

    return words.select(F.col(word).alias("word")).distinct().withColumn("pieces", cut("word"))


def sweep(docs: DataFrame, sizes=(500, 1000, 2000, 4000, 8000), text: str = "text") -> DataFrame:
    """For each vocabulary size: merges, pieces over all words, pieces a word, words kept whole. A smaller model is a beginning of a larger one."""
    path = scratch.new_path(docs.sparkSession, "words")
    word_counts(docs, text).write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    merges, base = _train(counts, max(sizes))
    own = [min(len(merges), max(0, v - base - 1)) for v in sizes]
    rank = {p: i for i, p in enumerate(merges)}

    @F.pandas_udf("array<int>")
    def n_pieces(s: pd.Series) -> pd.Series:
        return s.map(lambda w: split_sizes(w, rank, own))

    rows = counts.select("n", n_pieces("word").alias("k"))
    each = [F.struct(F.lit(v).alias("vocabulary"), F.lit(m).alias("merges"), F.sum(F.col("k")[i] * F.col("n")).alias("pieces"), F.sum("n").alias("n"), F.sum(F.when(F.col("k")[i] == 1, F.col("n")).otherwise(0)).alias("whole")) for i, (v, m) in enumerate(zip(sizes, own, strict=True))]
    made = rows.agg(F.array(*each).alias("x")).select(F.inline("x"))
    return made.select("vocabulary", "merges", "pieces", (F.col("pieces") / F.col("n")).alias("pieces_per_word"), (100 * F.col("whole") / F.col("n")).alias("whole_pct"))
