"""Exact top-k search by inner product with KD-trees per shard.

The table's rows are dealt into groups of bounded size; a task holds one group as shards, and a shard is a KD-tree: median
splits along the widest side, each node with the tight box of its vectors. Queries are rows too: dealt to the groups in
the same shuffle, they come after a group's vectors and stream past its trees, which are built once. A query walks each
tree best-first by the largest inner product that a node's box allows, and stops when that is below its k-th score so
far; that score goes on from shard to shard. Before it goes to all groups, a query is searched in one, and the k-th score
found there bounds it everywhere (:func:`search`).

Defined cases: vectors that are null or hold null or non-finite components, or have another length than a query, take no
part; a null id takes no part; ties go to the smaller id; rows that repeat an id are candidates of their own, but a query
never meets a row of its own id, and of rows of ``queries`` that repeat an id only the least vector is asked; components and scores
beyond 64 bits count as the nearest 64-bit integer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import stored, trimmed

#: Rows in a shard, vectors in a leaf, most rows in a group, fewest in a group of a small table.
SHARD, LEAF, GROUP, SMALL = 16_384, 512, 131_072, 2_048
#: Doubles hold integers up to here exactly.
_EXACT = float(1 << 53)


class Tree:
    """KD-tree over integer vectors held as doubles: exact where no inner product can pass 2**53, else in Python's integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.kids, self.span = [], [], [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), None, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            at = order[a:b]
            lo, hi = vectors[at].min(0), vectors[at].max(0)
            me = len(self.low)
            self.low.append(lo)
            self.high.append(hi)
            self.kids.append([])
            self.span.append((a, b))
            if parent is not None:
                self.kids[parent].append(me)
            axis = int(np.argmax(hi - lo))
            if b - a > leaf and hi[axis] > lo[axis]:
                mid = (b - a) // 2
                order[a:b] = at[np.argpartition(vectors[at, axis], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.peak = float(np.abs(self.vectors).max()) if len(ids) else 0.0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows each query, with what doubles may be off where they aren't exact."""
        bound = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        wide = np.abs(queries).sum(1) * self.peak >= _EXACT
        bound[wide] += np.abs(queries[wide]).sum(1)[:, None] * self.peak * 1e-12
        return bound

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, best: list[tuple[int, int]], k: int, least: int = -(1 << 63)) -> list[tuple[int, int]]:
        """Takes and returns the best (score, -id) so far, ascending; scores below ``least`` are of no interest."""
        exact = np.abs(query).sum() * self.peak < _EXACT
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            low = max(least, best[0][0]) if len(best) == k else least
            if -b < low:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= low:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            s, e = self.span[node]
            scores = self.vectors[s:e] @ query if exact else np.array([_long(sum(int(x) * int(y) for x, y in zip(v, query, strict=True))) for v in self.vectors[s:e]], object)
            near = np.flatnonzero((scores >= low) & (self.ids[s:e] != own))
            if len(near) > 4 * k and exact:
                cut = np.partition(scores[near], len(near) - k)[len(near) - k]
                near = near[scores[near] >= cut]
            best = sorted([*best, *((int(scores[i]), -int(self.ids[s + i])) for i in near)])[-k:]
        return best


def _long(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def vectors_of(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and ``_v``: floor(256 * x) of each component as double; only vectors that take part."""
    v = F.col(vector)
    good = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(good).select(key, F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("_v"))


def search(table: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``table`` for each row of ``queries`` (both with key and vector)."""
    rows, asked = vectors_of(table, key, vector), vectors_of(queries, key, vector).groupBy(key).agg(F.min("_v").alias("_v"))
    n, tasks = rows.count(), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n // GROUP), min(tasks, -(-n // SMALL)))
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(groups)).cast("int")
    # Equal rows are dealt apart by their places in the table.
    dealt = rows.select(place(key, F.monotonically_increasing_id()).alias("group"), F.lit(0).alias("kind"), F.col(key).cast("bigint").alias("id"), "_v", F.lit(None).cast("bigint").alias("least"))
    asked = asked.select(F.col(key).cast("bigint").alias("id"), "_v")
    first = asked.select(place("id").alias("group"), F.lit(1).alias("kind"), "id", "_v", F.lit(None).cast("bigint").alias("least"))
    found = stored(_met(dealt.unionByName(first), k), "first")
    if groups == 1:
        return _best(found, k)
    least = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g != place("id")))
    rest = asked.join(least, "id", "left").select(other.alias("group"), F.lit(1).alias("kind"), "id", "_v", "least")
    return _best(found.unionByName(_met(dealt.unionByName(rest), k)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; a task's own come first, so a query never gathers more than k from each."""
    one = F.struct(F.col("score").alias("score"), (-F.col("vec_id")).alias("less"))
    top = found.groupBy("query_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(one))), 1, k).alias("best"))
    return top.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), (-F.col("b.less")).alias("vec_id"), "b.score")


def _met(rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of its group for each row of kind 1, none below its ``least``. rows: group, kind (0: vectors), id, _v, least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees, held = None, {}, {}

        def plant(width: int) -> None:
            keys, flat = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
            trees.setdefault(width, []).append(Tree(keys, flat.reshape(-1, width)) if width else keys)

        def ask(keys: np.ndarray, vectors: np.ndarray, least: list, width: int):
            best: list[list[tuple[int, int]]] = [[] for _ in keys]
            for tree in trees.get(width, ()):
                if not width:  # empty vectors: every score is 0
                    best = [sorted([*b, *((0, -int(x)) for x in tree if x != i and (low is None or low <= 0))])[-k:] for i, b, low in zip(keys, best, least, strict=True)]
                    continue
                for at in range(0, len(keys), 256):
                    bounds = tree.bounds(vectors[at : at + 256])
                    for j in range(at, min(at + 256, len(keys))):
                        best[j] = tree.search(vectors[j], int(keys[j]), bounds[j - at], best[j], k, -(1 << 63) if least[j] is None else least[j])
            return [(int(q), -less, score) for q, b in zip(keys, best, strict=True) for score, less in b]

        for batch in batches:
            places, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((places[1:] != places[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
                if e == a:
                    continue
                if places[a] != group:
                    group, trees, held = places[a], {}, {}
                part = batch.slice(a, e - a)
                keys, lists, least = part.column(2).to_numpy(), part.column(3), part.column(4).to_pylist()
                offsets = lists.offsets.to_numpy()
                sizes, begins = np.diff(offsets), offsets[:-1] - offsets[0]
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                for width in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == width)
                    values = flat[(begins[own][:, None] + np.arange(width)).reshape(-1)]
                    if kinds[a] == 0:
                        held.setdefault(width, []).append((keys[own], values))
                        if sum(len(x) for x, _ in held[width]) >= SHARD:
                            plant(width)
                        continue
                    if width in held:
                        plant(width)
                    out = ask(keys[own], values.reshape(-1, width) if width else values, [least[i] for i in own], width)
                    cols = zip(*out, strict=True) if out else ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    met = rows.repartition("group").sortWithinPartitions("group", "kind")
    return met.mapInArrow(trimmed(run), "query_id bigint, vec_id bigint, score bigint")
