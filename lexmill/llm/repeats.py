"""Suffix-array dedup: removes every byte that a 100-byte string covers which also starts earlier.

Windows of 100 bytes choose anchors by content (:mod:`lexmill.llm.winnow`), so equal windows have equal anchors at equal
places, and only about one position in 32 travels:

1. Each anchor goes to the task of its hash with a second hash of all that its run of windows covers. Tasks that send
   first find runs that repeat among their own rows, by hash and then by bytes, so a passage of a third of all documents
   is sent once by each. Anchors that are met once are done.
2. Of the others each row sends its bytes (at most 168) to the anchor's task. Runs equal as a whole are told by a hash and
   compared with their first on the bytes. There the suffixes of what is left meet: a merge sort whose comparisons find
   common extensions by binary search over prefix polynomial hashes. The sorted order is verified on the bytes, and a
   group where a collision has misled it is sorted by bytes; neighbours that agree in 100 bytes are equal windows.
3. Anchors of more rows than :data:`ROWS` (a passage that very many documents share) never meet in one task: each window
   goes with its bytes to the task of its own hash, after the same reduction among a sender's rows.
4. What was found is joined to the texts.

Hashes only choose what meets: with hashes of a few bits the result is the same.

Defined cases: a null text counts as empty; earlier means a smaller doc_id (null first, then by a hash of the text where
a doc_id repeats with other texts) or in the same text an earlier start; rows that repeat both doc_id and text are one
document, and each gets its result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import grams, winnow
from lexmill.llm.common import map_arrow, sliced, stored, trimmed
from lexmill.llm.suffixes import Text

LENGTH, GRAM = 100, 32
#: Most bytes before an anchor in its run, and bytes of a run.
LEFT = LENGTH - GRAM
SEGMENT = 2 * LEFT + GRAM
#: Rows of an anchor up to which they meet in one task.
ROWS = 512
_SLICE, _FLUSH = 1 << 20, 400_000
#: Rows that are sorted at once.
SLICED = 4_000
#: Bits of the hashes in use; fewer cost time and never a result.
ANCHOR, CONTENT = np.uint64(2**64 - 1), np.uint64(2**64 - 1)
_NAMES = ("bucket", "kind", "data")
_SCHEMA = "bucket int, kind int, data binary"
ENTRY = np.dtype([("g", "<u8"), ("c", "<u8"), ("rid", "<i8"), ("s", "<i4"), ("n", "u1"), ("off", "u1"), ("big", "u1")])
ASKED = np.dtype([("g", "<u8"), ("rid", "<i8"), ("s", "<i4"), ("n", "u1"), ("off", "u1")])
SENT = np.dtype([("g", "<u8"), ("rid", "<i8"), ("s", "<i4"), ("n", "u1"), ("off", "u1"), ("text", "u1", SEGMENT)])
WINDOW = np.dtype([("w", "<u8"), ("rid", "<i8"), ("s", "<i4"), ("text", "u1", LENGTH)])
MARK = np.dtype([("rid", "<i8"), ("s", "<i4"), ("e", "<i4")])
#: Kinds of packed rows.
MARKS, FEW, MANY, ENTRIES = 1, 2, 3, 4


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=list(_NAMES))


def _deal(kind: int, rows: np.ndarray, key: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Packs rows by the bucket of their key."""
    bucket = ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, ends = rows[order], np.cumsum(np.bincount(bucket, minlength=parts))
    return [(b, kind, rows[a:e].tobytes()) for b, (a, e) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)) if e > a]


def _by_text(kind: int, rows: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Packs rows by the bucket of their text."""
    bucket = rows["rid"] % parts
    order = np.lexsort((rows["rid"], bucket))
    rows, ends = rows[order], np.cumsum(np.bincount(bucket, minlength=parts))
    return [(b, kind, rows[a:e].tobytes()) for b, (a, e) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)) if e > a]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where rows (sorted) begin that differ from the one before in any key."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _marks(rid: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Ranges of repeated windows, joined where they touch."""
    order = np.lexsort((s, rid))
    rid, s, e = rid[order], s[order], e[order]
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (s[1:] > e[:-1] + 1)
    at = np.flatnonzero(new)
    out = np.zeros(len(at), MARK)
    if len(at):
        out["rid"], out["s"], out["e"] = rid[at], s[at], np.maximum.reduceat(e, at)
    return out


def _sort_entries(e: np.ndarray) -> np.ndarray:
    return np.lexsort((e["s"], e["rid"], e["c"], e["g"]))


def _equal_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Are the n bytes at x and at y the same? n is at most a segment's length."""
    out, col = np.zeros(len(x), bool), np.arange(SEGMENT)
    for a in range(0, len(x), 50_000):
        at = slice(a, a + 50_000)
        inside = col[None, :] < n[at, None]
        look = [data[np.minimum(z[at, None] + col, len(data) - 1)] for z in (x, y)]
        out[at] = ((look[0] == look[1]) | ~inside).all(1)
    return out


def _anchors(texts: DataFrame, parts: int) -> DataFrame:
    """bucket (of texts), kind, data: marks of runs that repeat as a whole among a sender's rows, and what is asked of texts."""

    def deal(batches):
        held, pieces, n, size = [], [], 0, 0

        def out():
            e, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = _sort_entries(e)
            e, at, data = e[order], at[order], np.concatenate(pieces)
            lead = _starts(e["g"], e["c"])
            first = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            later = np.flatnonzero(~lead)
            same = (e["n"][later] == e["n"][first[later]]) & (e["off"][later] == e["off"][first[later]])
            same[same] = _equal_bytes(data, at[later[same]], at[first[later[same]]], e["n"][later[same]].astype(np.int64) + LENGTH)
            rest = np.ones(len(e), bool)
            rest[later[same]] = False
            again, e = e[~rest], e[rest]
            rows = []
            if len(again):
                m = _marks(again["rid"], again["s"], again["s"] + again["n"])
                rows += _by_text(MARKS, m, parts)
            group = np.cumsum(_starts(e["g"])) - 1
            many = np.bincount(group)[group] > ROWS
            if many.any():
                ask = e[many]
                rows += _by_text(MANY, ask, parts)
                one = ask[_starts(ask["g"])].copy()
                one["big"] = 1
                e = np.concatenate([e[~many], one])
            return _batch(rows + _deal(ENTRIES, e, e["g"], parts))

        for batch in batches:
            for part in sliced(batch, "text", _SLICE):
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                rid = part.column(0).to_numpy()
                data, starts, ends = grams.laid(raw)
                prefix = grams.prefix_hash(data)
                d, a, s1, s2, g = winnow.runs(data, starts, ends, LENGTH, GRAM, prefix)
                if not len(d):
                    continue
                e = np.zeros(len(d), ENTRY)
                e["g"], e["rid"], e["s"], e["n"], e["off"] = g & ANCHOR, rid[d], s1 - starts[d], s2 - s1, a - s1
                e["c"] = grams.mixed(grams.span_hash(prefix, s1, s2 + LENGTH) + e["off"].astype(np.uint64)) & CONTENT
                held.append((e, s1 + size))
                pieces.append(data)
                n, size = n + len(e), size + len(data)
                if n > _FLUSH:
                    yield out()
                    held, pieces, n, size = [], [], 0, 0
        if held:
            yield out()

    def meet(batches):
        held, asked, marks = [], [], []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                (held if kind == ENTRIES else asked if kind == MANY else marks).append(np.frombuffer(data, MARK if kind == MARKS else ENTRY))
        rows = []
        if held:
            e = np.concatenate(held)
            e = e[_sort_entries(e)]
            # A sender's note that an anchor is very common says nothing about its own content.
            noted = np.unique(e["g"][e["big"] == 1])
            e = e[e["big"] == 0]
            if len(e):
                group = np.cumsum(_starts(e["g"])) - 1
                n = np.bincount(group)[group]
                many = (n > ROWS) | np.isin(e["g"], noted)
                few = e[~many & (n > 1)]
                ask = np.zeros(len(few), ASKED)
                for c in ASKED.names:
                    ask[c] = few[c]
                rows += _by_text(FEW, ask, parts)
                asked.append(e[many])
        if asked:
            e = np.concatenate(asked)
            ask = np.zeros(len(e), ASKED)
            for c in ASKED.names:
                ask[c] = e[c]
            rows += _by_text(MANY, ask, parts)
        if marks:
            m = np.concatenate(marks)
            rows += _by_text(MARKS, m, parts)
        yield _batch(rows)

    return texts.select("rid", "text").mapInArrow(trimmed(deal), _SCHEMA).repartition("bucket").mapInArrow(trimmed(meet), _SCHEMA)


def whole_runs(sent: np.ndarray) -> np.ndarray:
    """Which rows (sorted by g, rid, s) are equal as a whole to an earlier one of their anchor: told by a hash, verified on the bytes."""
    key = sent["text"].copy().view("<u8").reshape(len(sent), -1)
    h = grams.mixed(sent["n"].astype(np.uint64) * np.uint64(256) + sent["off"])
    for i in range(key.shape[1]):
        h = grams.mixed(h ^ key[:, i]) & CONTENT
    order = np.lexsort((np.arange(len(sent)), h, sent["g"]))
    lead = _starts(sent["g"][order], h[order])
    first = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    same = np.zeros(len(sent), bool)
    x, y = order[~lead], first[~lead]
    same[x] = (sent["n"][x] == sent["n"][y]) & (sent["off"][x] == sent["off"][y]) & (sent["text"][x] == sent["text"][y]).all(1)
    return same


def equal_windows(sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``sent`` runs that stand in an earlier one of the same anchor: (row, start).

    ``sent`` is sorted by (g, rid, s), so a smaller index is earlier.
    """
    k = len(sent)
    # Aligned: the anchor of every row is at the same column.
    matrix = np.zeros((k, SEGMENT + LEFT), np.uint8)
    off, n = sent["off"].astype(np.int64), sent["n"].astype(np.int64)
    np.put_along_axis(matrix, np.arange(SEGMENT)[None, :] + (LEFT - off)[:, None], sent["text"], 1)
    width = matrix.shape[1]
    text = Text(matrix.reshape(-1))
    row = np.repeat(np.arange(k), n + 1)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)  # window of the run
    back = off[row] - shift  # the anchor's place in the window, from -100 to LEFT
    group = (np.cumsum(_starts(sent["g"])) - 1)[row] * (4 * LENGTH) + back + 2 * LENGTH
    order = np.argsort(group, kind="stable")
    row, shift, back, group = row[order], shift[order], back[order], group[order]
    at = row * width + LEFT - back
    order = text.sort(at, group, LENGTH)
    order, same = text.verified(at, group, LENGTH, order)
    row, shift = row[order], shift[order]
    cls = np.cumsum(~same) - 1
    lead = np.full(cls[-1] + 1 if len(cls) else 0, k, np.int64)
    np.minimum.at(lead, cls, row)
    again = row > lead[cls]
    return row[again], sent["s"][row[again]] + shift[again]


def _with_texts(texts: DataFrame, packed: DataFrame, parts: int) -> DataFrame:
    """The texts' rows (kind 0) in partitions of their buckets, behind what is packed for them (bucket, kind, data)."""
    rows = texts.select(F.pmod("rid", F.lit(parts)).cast("int").alias("bucket"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("data"), *texts.columns)
    return rows.unionByName(packed, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", F.desc("kind"))


class _Packed:
    """What was packed for the texts of a bucket, by text."""

    def __init__(self):
        self.bucket, self.held, self.rows = None, {}, {}

    def add(self, bucket: int, kind: int, data: bytes, dtype: np.dtype) -> None:
        if bucket != self.bucket:
            self.bucket, self.held, self.rows = bucket, {}, {}
        self.held.setdefault(kind, []).append(np.frombuffer(data, dtype))

    def of(self, bucket: int, kind: int, rid: int) -> np.ndarray | None:
        if bucket != self.bucket or kind not in self.held and kind not in self.rows:
            return None
        if kind in self.held:
            rows = np.concatenate(self.held.pop(kind))
            self.rows[kind] = rows[np.argsort(rows["rid"], kind="stable")]
        rows = self.rows[kind]
        a, e = np.searchsorted(rows["rid"], (rid, rid + 1))
        return rows[a:e] if e > a else None


def _windows(texts: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """bucket, kind (marks), data: repeated windows of the runs that were asked for."""

    def fetch(batches):
        few, many, n, packed = [], [], 0, _Packed()

        def out():
            rows, marks = [], []
            if few:
                f = np.concatenate(few)
                f = f[np.lexsort((f["s"], f["rid"], f["g"]))]
                whole = whole_runs(f)
                marks.append(_marks(f["rid"][whole], f["s"][whole], f["s"][whole] + f["n"][whole]))
                f = f[~whole]
                rows += _deal(FEW, f, f["g"], parts)
            if many:
                w = np.concatenate(many)
                again, first = same_windows(w)
                marks.append(_marks(again["rid"], again["s"], again["s"]))
                rows += _deal(MANY, first, first["w"], parts)
            m = np.concatenate(marks)
            return _batch(rows + (_by_text(MARKS, m, parts) if len(m) else []))

        for batch in batches:
            for bucket, kind, data, rid, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if kind:
                    packed.add(bucket, kind, data, ASKED)
                    continue
                got = {k: packed.of(bucket, k, rid) for k in (FEW, MANY)}
                if got[FEW] is None and got[MANY] is None:
                    continue
                data = np.frombuffer((text or "").encode(), np.uint8)
                if (a := got[FEW]) is not None:
                    f = np.zeros(len(a), SENT)
                    for c in ASKED.names:
                        f[c] = a[c]
                    size = a["n"].astype(np.int64) + LENGTH
                    look = np.minimum(a["s"][:, None] + np.arange(SEGMENT)[None, :], len(data) - 1)
                    f["text"] = np.where(np.arange(SEGMENT)[None, :] < size[:, None], data[look], 0)
                    few.append(f)
                    n += 4 * len(f)
                if (a := got[MANY]) is not None:
                    count = a["n"].astype(np.int64) + 1
                    s = np.repeat(a["s"].astype(np.int64) - np.cumsum(count) + count, count) + np.arange(count.sum())
                    w = np.zeros(len(s), WINDOW)
                    w["w"], w["rid"], w["s"] = grams.span_hash(grams.prefix_hash(data), s, s + LENGTH) & CONTENT, rid, s
                    w["text"] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[s]
                    many.append(w)
                    n += 3 * len(w)
                if n > _FLUSH:
                    yield out()
                    few, many, n = [], [], 0
        if n:
            yield out()

    def meet(batches):
        few, many, marks = [], [], []
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == MARKS:
                    marks.append(np.frombuffer(data, MARK))
                elif kind == FEW:
                    few.append(np.frombuffer(data, SENT))
                else:
                    many.append(np.frombuffer(data, WINDOW))
        if many:
            again, _ = same_windows(np.concatenate(many))
            marks.append(_marks(again["rid"], again["s"], again["s"]))
        if few:
            f = np.concatenate(few)
            f = f[np.lexsort((f["s"], f["rid"], f["g"]))]
            whole = whole_runs(f)
            marks.append(_marks(f["rid"][whole], f["s"][whole], f["s"][whole] + f["n"][whole]))
            f = f[~whole]
            begins = np.flatnonzero(_starts(f["g"])) if len(f) else np.zeros(0, np.int64)
            # A multiple behind the last group's start has only the end after it.
            ends = np.append(begins, len(f))
            cut = np.unique(np.append(ends[np.searchsorted(ends, np.arange(0, len(f), SLICED))], len(f)))
            for a, e in zip(np.concatenate([[0], cut[:-1]]).astype(np.int64), cut, strict=True):
                if e > a:
                    row, at = equal_windows(f[a:e])
                    marks.append(_marks(f["rid"][a:e][row], at, at))
        m = np.concatenate(marks) if marks else np.zeros(0, MARK)
        m = _marks(m["rid"], m["s"], m["e"]) if len(m) else m
        yield _batch(_by_text(MARKS, m, parts) if len(m) else [])

    both = _with_texts(texts.select("rid", "text"), asked, parts)
    return both.mapInArrow(trimmed(fetch), _SCHEMA).repartition("bucket").mapInArrow(trimmed(meet), _SCHEMA)


def same_windows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose bytes stand in an earlier one, and the first of each; told by their hash, verified on the bytes."""
    words = w["text"].copy().view("<u4").reshape(len(w), -1)
    # Sorted by the bytes themselves within a hash, so those that collide are told apart.
    order = np.lexsort((w["s"], w["rid"], *words.T, w["w"]))
    w = w[order]
    first = _starts(w["w"], *words[order].T)
    return w[~first], w[first]


def kept(text: bytes, marks: np.ndarray) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of maximal removed runs."""
    cover = np.zeros(len(text) + 1, np.int32)
    np.add.at(cover, marks["s"], 1)
    np.add.at(cover, marks["e"].astype(np.int64) + LENGTH, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return ~gone, int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``rid`` to (_row, _id, text): an order of documents as one number, the id itself unless an id repeats or is null."""
    odd = rows.groupBy("_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("_id").isNull())
    if odd.isEmpty():
        return rows.withColumn("rid", F.col("_id"))
    rows = rows.withColumn("_text", F.sha2(F.coalesce("text", F.lit("")), 256))
    ids = rows.select(F.col("_id").alias("_key"), F.col("_text").alias("_hash")).distinct()
    # Sorted by ranges, so numbers that grow with the partition and in it keep the order.
    ids = stored(ids.orderBy(F.col("_key").asc_nulls_first(), "_hash").withColumn("rid", F.monotonically_increasing_id()), "ids")
    return rows.join(ids, rows["_id"].eqNullSafe(ids["_key"]) & (rows["_text"] == ids["_hash"])).drop("_key", "_hash", "_text")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_row (a struct of the columns but ``text``), _kept (binary, the remaining bytes), _bytes, _removed and _spans of each row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) | 1
    while any(parts % i == 0 for i in range(3, int(parts**0.5) + 1, 2)):
        parts += 2  # a prime, so that ids in steps spread as well
    own = F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("_row")
    rows = _numbered(docs.select(own, F.col(key).cast("bigint").alias("_id"), F.col(text).alias("text"))).select("rid", "text", "_row")
    found = stored(_anchors(rows, parts), "anchors")
    # Written, so that the texts dealt out for it go before they are dealt out again.
    more = stored(_windows(rows, found.where(F.col("kind") != MARKS), parts), "windows")
    both = _with_texts(rows, found.where(F.col("kind") == MARKS).unionByName(more), parts)
    kind = rows.schema["_row"].dataType.simpleString()
    schema = f"_row {kind}, _kept binary, _bytes bigint, _removed bigint, _spans bigint"

    def cut(batches):
        packed = _Packed()
        for batch in batches:
            bucket, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            # Runs of rows of one bucket that are all packed or all texts.
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | ((kinds[1:] == 0) != (kinds[:-1] == 0))) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
                run = batch.slice(x, y - x)
                if y > x and kinds[x]:
                    for data in run.column(2).to_pylist():
                        packed.add(bucket[x], MARKS, data, MARK)
                    continue
                for part in sliced(run, "text", _SLICE):
                    out = [[], [], [], []]
                    for rid, text in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                        raw, spans = (text or "").encode(), 0
                        stay, m = raw, packed.of(bucket[x], MARKS, rid)
                        if m is not None:
                            keep, spans = kept(raw, m)
                            stay = np.frombuffer(raw, np.uint8)[keep].tobytes()
                        for c, v in zip(out, (stay, len(raw), len(raw) - len(stay), spans), strict=True):
                            c.append(v)
                    yield pa.RecordBatch.from_arrays([part.column(5), *(pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["_row", "_kept", "_bytes", "_removed", "_spans"])

    return both.mapInArrow(trimmed(cut), schema)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = remove(docs.select(key, text), key, text)
    return done.select(F.col("_row").getField(key).alias(key), F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with repeated bytes cut out of ``text``; a text that is nothing but repeats goes with its row.

    A cut may fall inside a character: what is left of it goes too. Where there is a column ``length``, it becomes the new
    text's number of code points. A null text becomes an empty one.
    """
    done = remove(docs, key, text)

    def decode(cols, n):
        return {"_row": cols["_row"], "_text": [k.decode("utf-8", "ignore") for k in cols["_kept"]], "_removed": cols["_removed"]}

    kind = done.schema["_row"].dataType.simpleString()
    out = map_arrow(done, decode, f"_row {kind}, _text string, _removed bigint", "_kept").where((F.col("_removed") == 0) | (F.length("_text") > 0))
    columns = {c: F.col("_text") if c == text else F.col("_row").getField(c) for c in docs.columns}
    if length in columns:
        columns[length] = F.when(columns[length].isNotNull(), F.length("_text")).cast(docs.schema[length].dataType)
    return out.select(*[v.alias(c) for c, v in columns.items()])
