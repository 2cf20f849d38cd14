"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles. In one global order of shingles (rare ones first) the first
``n - ceil(t * n) + l`` of a set are its l-prefix: two sets that reach the threshold share at least l tokens of their
l-prefixes. Each document chooses its own l: the higher the estimated cost of its candidates, the longer its prefix, and a
pair needs as many shared prefix tokens as the smaller of both l before it is verified. (l counts distinct prefix tokens
shared, so a wrong estimate costs time and never a link.) Of those l tokens each has enough of both sets behind it for the
overlap that the threshold asks; tokens where that fails don't count.

1. :func:`levels` counts shingles over all documents. Those of several documents raise their slot of a table of fixed size
   to the logarithm of their count; the table is the order, and the estimate of costs.
2. :func:`candidates` sends prefix tokens in packed blocks to the task of their hash. A token of a few classes gives pairs
   there and then. A *hot* token's entries are written: hot by number in its task, or by estimate before it is dealt out,
   in which case its classes are dealt over many tasks.
3. :func:`balls` takes large groups of near copies out of the pairs. A class that meets hot tokens is compared with one
   other, its pivot (what most of its hot tokens name as theirs), and is in the pivot's ball if their difference is small
   enough for it to be linked with something that is linked with the pivot. With d the size of the symmetric difference, a
   class has slack ``u = n - 7 d``. Two classes of a ball with ``u + u' >= 0`` are linked by the triangle inequality, so
   sums over a histogram of u count such links. Others that share enough prefix tokens are verified by their differences
   to the pivot, in blocks (:func:`ball_links`).
4. :func:`across`: a hot token's classes of different balls (or none) meet in pairs of blocks, filtered by size, places,
   ball and the triangle inequality.
5. Pairs that share enough prefix tokens are verified on their sets by a second, independent hash (:func:`compare`).
6. Components over links and balls are the result.

Equal sets are one class from the start (key: 64 bits of the whole set), so copies never meet as pairs.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; rows of a null
doc_id take part and have doc_id null, a component that only holds such rows has component_id null; rows that repeat a
doc_id with other texts are documents of their own; repeated rows are copies; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import shingles
from lexmill.llm.common import cleaned, sliced, spread_join, stored, trimmed
from lexmill.llm.components import components, flat

#: The threshold in hundredths, and the same as a bound of differences: sets of a and b shingles are linked when their symmetric difference is at most (a + b) / 7.
PERCENT, SLACK = 75, 7
#: A shingle is common from so many documents on; the table of levels has 2**SLOTS places.
COMMON, SLOTS = 8, 22
#: A token with more classes in its task is hot; a token of this level (logarithm of its documents) is dealt over 2**(level - HOT + 1) tasks.
PAIRS, HOT = 24, 13
#: A class is in its pivot's ball when REACH times their difference is at most the sum of their sizes: two links away.
REACH = 3
#: Classes in a block, for all work in pairs of blocks.
BLOCK = 256
#: A prefix is lengthened by a token for so many estimated candidates, at most by this part of the set, and never by more than half a byte holds.
CHEAP, LONGER, LONGEST = 4, 8, 120
#: So many ids of documents go to all tasks; with more, documents are dealt out by id.
SENT = 1_000_000
_FLUSH = 1 << 20
#: A prefix token on its way: 40 bits of its hash, class, size of the set, share of the set from here on (in 255ths, rounded up), l (the top bit: hot by estimate), share of common tokens in the prefix (in 255ths).
ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("c", "<i8"), ("n", "<u4"), ("r", "u1"), ("l", "u1"), ("k", "u1")])
_MINE = 128


def _parts(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _texts(batches, column: int):
    for batch in batches:
        for part in sliced(batch, batch.schema.names[column], 1 << 20):
            yield part, shingles.sets(part.column(column).to_pylist())


def _rows(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


# The order of shingles


def levels(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The logarithm of the number of documents of the most frequent common shingle of each slot (the first bits of a hash); 0 without one."""
    parts = _parts(docs)

    def deal(batches):
        held, n, seen = [], 0, set()

        def out():
            # Counted among a sender's rows first, so that a very common shingle travels once.
            t, k = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
            cuts = np.searchsorted(t, (np.arange(1, parts, dtype=np.uint64) << np.uint64(48)) // np.uint64(parts))
            rows = []
            for b, (ts, ks) in enumerate(zip(np.split(t, cuts), np.split(k, cuts), strict=True)):
                if len(ts):
                    again = ks > 1
                    six = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for x in (ts[~again], ts[again])]
                    rows.append((b, *six, ks[again].astype("<u4").tobytes()))
            b, once, twice, count = zip(*rows, strict=True)
            return _rows({"bucket": (b, pa.int32()), "once": (once, pa.binary()), "twice": (twice, pa.binary()), "n": (count, pa.binary())})

        for _, sets in _texts(batches, 0):
            for s in sets:
                if len(s) and (key := shingles.class_key(s)) not in seen:
                    seen.add(key)
                    held.append(s)
                    n += len(s)
            if n > _FLUSH:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def tokens(data: bytes) -> np.ndarray:
        six = np.frombuffer(data, np.uint8).reshape(-1, 6)
        full = np.zeros((len(six), 8), np.uint8)
        full[:, :6] = six
        return full.reshape(-1).view("<u8")

    def count(batches):
        held, n = [], []
        for batch in batches:
            for once, twice, k in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                held += [tokens(once), tokens(twice)]
                n += [np.ones(len(held[-2]), np.uint32), np.frombuffer(k, "<u4")]
        if not held:
            return
        t, n = np.concatenate(held), np.concatenate(n)
        order = np.argsort(t)
        t, n = t[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        n = np.add.reduceat(n.astype(np.int64), first)
        slot, n = (t[first] >> np.uint64(48 - SLOTS))[n >= COMMON].astype(np.int64), n[n >= COMMON]
        if len(slot):
            low = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            most = np.log2(np.maximum.reduceat(n, low)).astype(np.uint8)
            yield _rows({"slots": ([slot[low].astype("<u4").tobytes()], pa.binary()), "levels": ([most.tobytes()], pa.binary())})

    dealt = docs.select(text).mapInArrow(trimmed(deal), "bucket int, once binary, twice binary, n binary").repartition("bucket")
    table = np.zeros(1 << SLOTS, np.uint8)
    # A row for each task, and five bytes for each slot in all: 20 MB at any size of the input.
    with cleaned(docs.sparkSession):
        got = dealt.mapInArrow(trimmed(count), "slots binary, levels binary").collect()
    for r in got:
        at = np.frombuffer(r["slots"], "<u4")
        table[at] = np.maximum(table[at], np.frombuffer(r["levels"], np.uint8))
    return table


def prefix(s: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The prefix of a set in the global order, its l, and its tokens' levels."""
    n = len(s)
    base = n - -(-PERCENT * n // 100)
    level = table[s >> np.uint64(64 - SLOTS)]
    order = np.argsort(level, kind="stable")  # the set is ascending, so ties go by hash
    # Every token may bring a candidate, a common one as many as it has documents.
    head = level[order[: base + 1]].astype(np.int64)
    cost = base + 1 + int((1 << head[head > 0]).sum())
    match = 1 + min(n // LONGER, cost // CHEAP, LONGEST)
    order = order[: base + match]
    return s[order], match, level[order]


# Candidates


def feasible(na, nb, ra, rb, need):
    """Can a pair that shares this token as one of its first ``need`` reach the threshold? Both have a part (in 255ths) of their sets from the token on."""
    low = 3 * (na + nb) / 7 - need + 1 - 1e-6
    return (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & (ra * na / 255 >= low) & (rb * nb / 255 >= low)


def _sums(a: np.ndarray, b: np.ndarray, need: np.ndarray):
    """Each pair once, with how often it is there and its need."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high, need = low[order], high[order], need[order]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else order
    return low[first], high[first], np.diff(np.concatenate([first, [len(low)]])), need[first]


def candidates(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """kind 0: pairs of classes (a, b) that share m tokens of few classes, and need so many; 1: a hot token's entry (a: class, b: token, m: size, need: k * 65536 + part * 256 + l); 2: documents (a: class, null without words; b: doc_id; m: shingles)."""
    parts = _parts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = "bucket int, kind int, data binary"
    document = np.dtype([("id", "<i8"), ("null", "u1"), ("c", "<i8"), ("n", "<u4")])

    def entries(s: np.ndarray, cls: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, match, level = prefix(s, table)
        e = np.zeros(len(p), ENTRY)
        e["low"], e["high"], e["c"], e["n"] = p & np.uint64(0xFFFFFFFF), (p >> np.uint64(32)) & np.uint64(0xFF), cls, len(s)
        e["r"] = np.ceil(255 * (len(s) - np.arange(len(p))) / len(s))
        e["k"] = 255 * (level > 0).mean()
        # Tokens that agree in 40 bits count as one.
        e["l"] = max(1, match - (len(p) - len(np.unique(p & np.uint64(0xFFFFFFFFFF)))))
        bucket = (p >> np.uint64(33)) % np.uint64(parts)
        hot = level >= HOT
        if hot.any():
            e["l"][hot] |= _MINE
            over = np.uint64(1) << (level[hot] - HOT + 1).astype(np.uint64)
            bucket[hot] = (bucket[hot] + np.uint64(cls & (2**64 - 1)) % over) % np.uint64(parts)
        return bucket.astype(np.int64), e

    def deal(batches):
        table = shared.value
        rows, own, held, seen = [], [], 0, set()

        def out():
            got = []
            if rows:
                bucket, e = (np.concatenate(x) for x in zip(*rows, strict=True))
                order = np.argsort(bucket, kind="stable")
                e, ends = e[order], np.cumsum(np.bincount(bucket, minlength=parts))
                got += [(b, 0, e[x:y].tobytes()) for b, (x, y) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)) if y > x]
            got.append((abs(own[0][2]) % parts, 1, np.array(own, document).tobytes()))
            b, kind, data = zip(*got, strict=True)
            return _rows({"bucket": (b, pa.int32()), "kind": (kind, pa.int32()), "data": (data, pa.binary())})

        for part, sets in _texts(batches, 1):
            for i, s in zip(part.column(0).to_pylist(), sets, strict=True):
                cls = shingles.class_key(s) if len(s) else 0
                own.append((i or 0, i is None, cls, len(s)))
                if len(s) and cls not in seen:
                    seen.add(cls)
                    rows.append(entries(s, cls, table))
                    held += len(rows[-1][1])
            if held > _FLUSH // 2 or len(own) > 20_000:
                yield out()
                rows, own, held = [], [], 0
        if own:
            yield out()

    def meet(batches):
        held = []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind:
                    d = np.frombuffer(data, document)
                    yield _out(2, pa.array(d["c"], mask=d["n"] == 0), pa.array(d["id"], mask=d["null"] == 1), d["n"], np.zeros(len(d)))
                else:
                    held.append(np.frombuffer(data, ENTRY))
        if held:
            yield from meeting(np.concatenate(held))

    rows = docs.select(F.col(key).cast("bigint").alias(key), text)
    return rows.mapInArrow(trimmed(deal), schema).repartition("bucket").mapInArrow(trimmed(meet), "kind int, a bigint, b bigint, m bigint, need bigint")


def _out(kind: int, a, b, m, need) -> pa.RecordBatch:
    cols = [np.full(len(m), kind, np.int32), a, b, np.asarray(m).astype(np.int64), np.asarray(need).astype(np.int64)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["kind", "a", "b", "m", "need"])


def meeting(e: np.ndarray):
    """Pairs of one task's tokens of few classes, and the entries of its hot tokens."""
    h = e["low"].astype(np.int64) | (e["high"].astype(np.int64) << 32)
    order = np.lexsort((e["c"], h))
    h, e = h[order], e[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (e["c"][1:] != e["c"][:-1])
    h, e = h[fresh], e[fresh]
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(h)]]))
    hot = (sizes > PAIRS) | np.logical_or.reduceat(e["l"] >= _MINE, begins)
    match = e["l"].astype(np.int64) & (_MINE - 1)
    found = []
    for k in np.unique(sizes[(sizes > 1) & ~hot]).tolist():
        at = begins[(sizes == k) & ~hot]
        i, j = np.triu_indices(k, 1)
        x, y = (at[:, None] + i).reshape(-1), (at[:, None] + j).reshape(-1)
        need = np.minimum(match[x], match[y])
        good = feasible(e["n"][x].astype(np.int64), e["n"][y].astype(np.int64), e["r"][x].astype(np.int64), e["r"][y].astype(np.int64), need)
        found.append((e["c"][x[good]], e["c"][y[good]], need[good]))
    if found:
        yield _out(0, *_sums(*(np.concatenate(c) for c in zip(*found, strict=True))))
    own = np.repeat(hot, sizes)
    if own.any():
        yield _out(1, e["c"][own], h[own], e["n"][own], e["k"][own].astype(np.int64) * 65536 + e["r"][own].astype(np.int64) * 256 + match[own])


# Sets of pairs


def wanted_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """class and text of the ``wanted`` classes."""
    first = stored(wanted.join(classes, "class").select(F.col("class").alias("_class"), F.col("first").alias("_id")), "wanted")
    few = first.count() <= SENT  # 16 bytes each
    texts = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("text"))

    def keyed(batches):
        for part, sets in _texts(batches, 0):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles.class_key(s) if len(s) else None for s in sets], pa.int64()), part.column(1)], names=["text", "class", "wanted"])

    def of(rows):
        return rows.mapInArrow(trimmed(keyed), "text string, class bigint, wanted bigint")

    # A row of the same doc_id but another text isn't the class's.
    found = of(texts.join(F.broadcast(first) if few else first, "_id").select("text", "_class")).where("class = wanted").select("class", "text")
    without = first.where("_id is null")
    if not without.isEmpty():  # classes without any doc_id are found by their key alone
        none = of(texts.where("_id is null").select("text", F.lit(None).cast("bigint").alias("_class")))
        none = none.join(without, F.col("class") == F.col("_class"), "left_semi").groupBy("class").agg(F.min("text").alias("text"))
        found = found.unionByName(none)
    return stored(found, "texts")


def compare(texts: DataFrame, pairs: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """a, b, na, nb, d (the size of the symmetric difference of the sets) of the linked ones among ``pairs`` (a, b); texts: class, text.

    With the ``table`` of levels all pairs come, and for near ones (:data:`REACH`) diff (the tokens of the difference), prefix and l of b.

    Sets are made of a second hash. A class of many pairs is dealt over as many tasks as it has blocks of partners; a task
    holds one class's set and streams the others.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("_of"))
    dealt = stored(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_of")).alias("salt")), "dealt")
    other = dealt.join(texts, dealt["b"] == texts["class"]).select("a", "salt", "b", "text")
    own = dealt.select("a", "salt").distinct().join(texts, F.col("a") == texts["class"]).select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")
    met = own.unionByName(other).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    order = None if table is None else texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        group, mine, last = None, None, None
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                a, salt, b, texts = (part.column(i).to_pylist() for i in range(4))
                sets = shingles.sets(texts, seed=2)
                out = []
                for i, (x, y, z, s) in enumerate(zip(a, salt, b, sets, strict=True)):
                    if z is None:
                        group, mine, last = (x, y), s, None
                    elif group == (x, y) and z != last:
                        last = z
                        diff = np.setxor1d(mine, s, True)
                        size, near = len(mine) + len(s), (None, None, None)
                        if order is not None and REACH * len(diff) <= size:
                            p, match, _ = prefix(shingles.sets([texts[i]])[0], order.value)
                            near = (diff.tobytes(), p.tobytes(), match)
                        if order is not None or SLACK * len(diff) <= size:
                            out.append((x, z, len(mine), len(s), len(diff), *near))
                x, z, na, nb, d, diff, p, match = zip(*out, strict=True) if out else ((),) * 8
                yield _rows({"a": (x, pa.int64()), "b": (z, pa.int64()), "na": (na, pa.int64()), "nb": (nb, pa.int64()), "d": (d, pa.int64()), "diff": (diff, pa.binary()), "prefix": (p, pa.binary()), "l": (match, pa.int64())})

    return met.mapInArrow(trimmed(run), "a bigint, b bigint, na bigint, nb bigint, d bigint, diff binary, prefix binary, l bigint")


# Balls


def balls(texts: DataFrame, classes: DataFrame, hot: DataFrame, table: np.ndarray) -> DataFrame:
    """class, pivot, d, n, u, near (is it in the pivot's ball), linked (with the pivot), copies, diff, prefix, l for each class that meets hot tokens."""
    # A changed text has fewer common tokens in its prefix, as it has tokens of its own: a token's pivot is the class that has most.
    names = stored(hot.groupBy("token").agg(F.max(F.struct("k", "class"))["class"].alias("pivot"), F.count("*").alias("n")), "names")
    # What most of its tokens name; of equally many the greatest.
    votes = spread_join(hot.select("token", "class"), names, "token", "n").groupBy("class", "pivot").agg(F.count("*").alias("m"))
    chosen = stored(votes.groupBy("class").agg(F.max(F.struct("m", "pivot"))["pivot"].alias("pivot")), "chosen")
    # A pivot that is linked with its own one hands its classes on to that. Pivots only name greater (k, class), so there is no circle.
    pivots = chosen.select("pivot").distinct()
    up = chosen.where("class <> pivot").join(pivots.select(F.col("pivot").alias("class")), "class", "left_semi")
    up = compare(texts, stored(up.select(F.col("pivot").alias("a"), F.col("class").alias("b")), "pivots")).select(F.col("b").alias("v"), F.col("a").alias("to"))
    up = flat(stored(up, "pivots")).toDF("pivot", "last")
    chosen = stored(chosen.join(up, "pivot", "left").select(F.coalesce("last", "pivot").alias("a"), F.col("class").alias("b")), "chosen")
    met = compare(texts, chosen, table)
    size = F.col("na") + F.col("nb")
    rows = met.select(
        F.col("b").alias("class"), F.col("a").alias("pivot"), "d", F.col("nb").alias("n"), (F.col("nb") - SLACK * F.col("d")).alias("u"), F.col("diff").isNotNull().alias("near"), (SLACK * F.col("d") <= size).alias("linked"), "diff", "prefix", "l"
    )
    return rows.join(classes.select("class", "copies"), "class")


def ball_links(rows: DataFrame) -> DataFrame:
    """class, links (copies of other classes of its ball that it is linked with; of a class in several blocks to be summed), root (a class of the block that it hangs together with)."""
    # Sure links: a class meets all whose u is at least -u. Both are points of a line; a ball has no more of them than sizes of sets.
    points = rows.groupBy("pivot", F.col("u").alias("x")).agg(F.sum("copies").alias("w"), F.count("*").alias("c"))
    asked = points.select("pivot", (-F.col("x")).alias("x")).distinct().select("pivot", "x", F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("c"))
    line = points.unionByName(asked).groupBy("pivot", "x").agg(F.sum("w").alias("w"), F.sum("c").alias("c"))
    down, up = (Window.partitionBy("pivot").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.desc("x"), F.col("x")))
    line = line.select("pivot", "x", "c", F.sum("w").over(down).alias("sure"), (F.sum("c").over(up) - F.col("c")).alias("before"))
    own = line.select("pivot", F.col("x").alias("u"), F.col("before").alias("own_before"), F.col("c").alias("own_c"))
    other = line.select("pivot", (-F.col("x")).alias("u"), "sure", "before")
    each = stored(rows.join(own, ["pivot", "u"]).join(other, ["pivot", "u"]), "slack")
    sure = each.select("class", (F.col("sure") - F.when(F.col("u") >= 0, F.col("copies")).otherwise(0)).alias("links"), F.col("class").alias("root"))
    # Others: those before -u on the line, in blocks along it.
    block = F.floor(F.col("own_before") / BLOCK) + F.pmod(F.xxhash64("class"), F.ceil(F.col("own_c") / BLOCK))
    dealt = each.where("before > 0").withColumn("_own", block)
    # Whoever is before -u has a block of at most before / BLOCK + 1.
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("before") / BLOCK) + 1)))
    dealt = dealt.select("pivot", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "class", "copies", "n", "u", "l", "prefix", "diff")
    dealt = dealt.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "class")

    def run(batches):
        group, held = None, []

        def out():
            side, cls, copies, n, u, match, first, diff = zip(*held, strict=True)
            sides = np.array(side) if group[1] != group[2] else None
            near = verified([np.frombuffer(x, np.uint64) for x in first], np.array(match), [np.frombuffer(x, np.uint64) for x in diff], np.array(n), np.array(u), sides)
            links, root = near @ np.array(copies, np.int64), forest(near)
            at, cls = np.flatnonzero(links), np.array(cls, np.int64)
            return _rows({"class": (cls[at], pa.int64()), "links": (links[at], pa.int64()), "root": (cls[root[at]], pa.int64())})

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(11)], strict=True):
                if row[:3] != group:
                    if len(held) > 1:
                        yield out()
                    group, held = row[:3], []
                held.append(row[3:])
        if len(held) > 1:
            yield out()

    return sure.unionByName(dealt.mapInArrow(trimmed(run), "class bigint, links bigint, root bigint"))


def shared(lists: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two lists (of distinct tokens) have in common, by blocks of a matrix product."""
    k = len(lists)
    owner = np.repeat(np.arange(k), [len(x) for x in lists])
    token, at, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    keep = count[at] > 1
    owner, at = owner[keep], at[keep]
    _, at = np.unique(at, return_inverse=True)
    both = np.zeros((k, k), np.float64)
    width = max(1, min(1 << 14, (1 << 21) // max(k, 1)))
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        s, e = np.searchsorted(at, (a, a + width))
        m = np.zeros((k, width), np.float32)
        m[owner[s:e], at[s:e] - a] = 1
        both += m @ m.T
    return both.astype(np.int64)


def verified(prefixes: list[np.ndarray], match: np.ndarray, diffs: list[np.ndarray], n: np.ndarray, u: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """Which of a block's classes are linked with which though ``u + u' < 0``, as a symmetric matrix: those that share enough prefix tokens are verified by their differences to the pivot, as the difference of two sets is that of their differences."""
    near = (shared(prefixes) >= np.minimum(match[:, None], match[None, :])) & (u[:, None] + u[None, :] < 0)
    # At most as many tokens are in both differences as in the smaller one.
    sizes = np.array([len(x) for x in diffs], np.int64)
    near &= SLACK * np.abs(sizes[:, None] - sizes[None, :]) <= n[:, None] + n[None, :]
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    at = np.flatnonzero(near.any(1))
    if len(at):
        apart = sizes[at][:, None] + sizes[at][None, :] - 2 * shared([diffs[i] for i in at])
        near[np.ix_(at, at)] &= SLACK * apart <= n[at][:, None] + n[at][None, :]
    return near


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row that it hangs together with."""
    root = np.arange(len(near))
    while True:
        low = np.where(near, root[None, :], len(near)).min(1)
        new = np.minimum(root, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def across(hot: DataFrame, spots: DataFrame) -> DataFrame:
    """a, b, m, need: pairs of a hot token's classes that aren't in one ball, by pairs of blocks. spots: class, pivot, d, near."""
    # A class in no ball is alone in one.
    rows = stored(hot.join(spots, "class"), "placed").withColumn("home", F.when(F.col("near"), F.col("pivot")).otherwise(F.bitwise_not("class")))
    of = rows.groupBy("token").agg(F.count("*").alias("k"), F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high").select("token", "k", F.ceil(F.col("k") / (4 * BLOCK)).alias("of"))
    dealt = spread_join(rows, stored(of, "mixed"), "token", "k").withColumn("_own", F.pmod(F.xxhash64("class"), F.col("of")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1)))
    dealt = dealt.select("token", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "class", "home", "pivot", "d", "n", "r", "l")
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "class")

    def run(batches):
        group, held, found, count = None, [], [], 0

        def meet():
            side, cls, home, pivot, d, n, r, match = (np.array(x, np.int64) for x in zip(*held, strict=True))
            # Sizes ascend: partners of a class from its place on to the last that size and place allow.
            last = np.searchsorted(n, np.minimum(100 * n // PERCENT, np.floor(7 * (r * n / 255 + match - 1) / 3 - n + 1e-6).astype(np.int64)), "right")
            many = np.maximum(last - np.arange(len(n)) - 1, 0)
            for s in range(0, len(n), BLOCK):
                x = np.repeat(np.arange(s, min(s + BLOCK, len(n))), many[s : s + BLOCK])
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many[s : s + BLOCK]) - many[s : s + BLOCK], many[s : s + BLOCK])
                need = np.minimum(match[x], match[y])
                good = feasible(n[x], n[y], r[x], r[y], need) & (home[x] != home[y]) & (cls[x] != cls[y])
                good &= (pivot[x] != pivot[y]) | (SLACK * np.abs(d[x] - d[y]) <= n[x] + n[y])
                if group[1] != group[2]:
                    good &= side[x] != side[y]
                if good.any():
                    yield cls[x[good]], cls[y[good]], need[good]

        def out():
            a, b, m, need = _sums(*(np.concatenate(c) for c in zip(*found, strict=True)))
            return _rows({"a": (a, pa.int64()), "b": (b, pa.int64()), "m": (m, pa.int64()), "need": (need, pa.int64())})

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(11)], strict=True):
                if row[:3] != group:
                    for x in meet() if len(held) > 1 else ():
                        found.append(x)
                        count += len(x[0])
                        if count > _FLUSH:
                            yield out()
                            found, count = [], 0
                    group, held = row[:3], []
                held.append(row[3:])
        for x in meet() if len(held) > 1 else ():
            found.append(x)
        if found:
            yield out()

    return dealt.mapInArrow(trimmed(run), "a bigint, b bigint, m bigint, need bigint")


# The join


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each document."""
    return _joined(docs, key, text).select("doc_id", "n_shingles", "component_id", "n_links")


def _joined(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Also class (null without words) and root_class, whose first document is the component's smallest."""
    table = levels(docs, text)
    found = stored(candidates(docs, table, key, text), "candidates")
    rows = found.where("kind = 2").select(F.col("b").alias("doc_id"), F.col("a").alias("class"), F.col("m").alias("n_shingles"))
    classes = stored(rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    hot = found.where("kind = 1").select(F.col("a").alias("class"), F.col("b").alias("token"), F.col("m").alias("n"), F.shiftright("need", 16).alias("k"), F.shiftright("need", 8).bitwiseAND(255).alias("r"), F.col("need").bitwiseAND(255).alias("l"))
    pairs = found.where("kind = 0").select("a", "b", "m", "need")
    texts = wanted_texts(docs, classes, hot.select("class").distinct(), key, text)
    spots = stored(balls(texts, classes, hot, table), "balls")
    pairs = pairs.unionByName(across(hot, spots.select("class", "pivot", "d", "near"))).groupBy("a", "b").agg(F.sum("m").alias("m"), F.min("need").alias("need")).where("m >= need")
    near = spots.where("near")
    home = [near.select(F.col("class").alias(x), F.col("pivot").alias(f"home_{x}")) for x in "ab"]
    pairs = pairs.join(home[0], "a", "left").join(home[1], "b", "left").where("home_a is null or home_b is null or home_a <> home_b").select("a", "b")
    pairs = stored(pairs, "pairs")
    more = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(texts.select("class"), "class", "left_anti")
    texts = texts.unionByName(wanted_texts(docs, classes, more, key, text))
    linked = stored(compare(texts, pairs).select("a", "b"), "links")
    inner = stored(ball_links(near), "ball_links")
    # A vertex is ordered by its first doc_id (null last), so a component's root is its smallest document.
    vertex = F.struct(F.col("first").isNull().alias("no"), F.coalesce("first", F.lit(0)).alias("first"), "class")
    at = classes.select("class", vertex.alias("v"))
    edges = linked.union(near.where("linked and pivot <> class").select("pivot", "class")).union(inner.where("class <> root").select("class", "root").distinct())
    edges = edges.join(at.toDF("a", "va"), "a").join(at.toDF("b", "vb"), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    roots = components(edges).select(F.col("v.class").alias("class"), "root")
    both = linked.union(linked.select("b", "a")).join(classes.select(F.col("class").alias("b"), "copies"), "b").select(F.col("a").alias("class"), F.col("copies").alias("links"))
    links = both.unionByName(inner.select("class", "links")).groupBy("class").agg(F.sum("links").alias("links"))
    done = classes.join(roots, "class", "left").join(links, "class", "left")
    root = F.coalesce("root", vertex)
    done = done.select(
        "class", "copies", F.when(~root["no"], root["first"]).alias("component_id"), root["class"].alias("root_class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    done = stored(done, "done")
    none = rows.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"), "class", F.lit(None).cast("bigint").alias("root_class"))
    return none.unionByName(spread_join(rows.where("class is not null"), done, "class", "copies"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component: of equal ones one, and rows without words once for each doc_id and text.

    First is the smallest doc_id; a component without any doc_id keeps one row of its first class.
    """
    rows = stored(_joined(docs.select(key, text), key, text), "joined")
    first = rows.where("class is null or (class = root_class and doc_id <=> component_id)").select(F.col("doc_id").alias("_stay"), F.col("class").alias("_class"))
    kept = docs.join(first.select("_stay").distinct(), docs[key].cast("bigint").eqNullSafe(F.col("_stay")), "left_semi")
    odd = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_odd")), "odd")
    if odd.isEmpty():
        return kept
    # Rows that repeat a doc_id or have none: their class says which of them are meant.
    same = docs[key].cast("bigint").eqNullSafe(F.col("_odd"))
    clear = kept.join(odd, same, "left_anti")
    rest = docs.join(odd, same, "left_semi")

    def keyed(batches):
        for part, sets in _texts(batches, 0):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles.class_key(s) if len(s) else None for s in sets], pa.int64())], names=["_text", "_key"])

    keys = rest.select(text).distinct().mapInArrow(trimmed(keyed), "_text string, _key bigint")
    rest = rest.join(keys, rest[text].eqNullSafe(keys["_text"])).drop("_text")
    stay = first.join(odd, F.col("_stay").eqNullSafe(F.col("_odd")), "left_semi").distinct()
    rest = rest.join(stay, rest[key].cast("bigint").eqNullSafe(stay["_stay"]) & rest["_key"].eqNullSafe(stay["_class"]), "left_semi")
    rest = rest.withColumn("_one", F.when(F.col("_key").isNull(), F.col(text)))
    return clear.unionByName(rest.dropDuplicates([key, "_key", "_one"]).drop("_key", "_one"))
