"""The training-data operators against brute force, on small authored tables with nulls, empties, repeats, long texts and clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import bpe, chat, common, components, grams, jaccard, language, media, mixing, nearest, pages, quality, repeats, shingles, suffixes, winnow

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _kept string, rid long, n_bytes string"


def words(rng, n, vocabulary=300):
    return " ".join(rng.choice([f"w{i}", f"Wört{i}", f"x{i},"][: 2 + (i % 2)]) for i in (rng.randrange(vocabulary) for _ in range(n)))


def texts():
    """Copies, near copies, shared passages, short, empty, null, blank and long texts."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = words(rng, 40)
    out = [base, base, base + " tail", "head " + base, None, "", "  \n", "one two", "One  TWO", "a b c d", passage + " " + words(rng, 200), words(rng, 150) + " " + passage, "é" * 300, "日本語🎉 " * 60, words(rng, 4000)]
    for _ in range(12):  # near copies with a word changed
        w = base.split()
        w[rng.randrange(len(w))] = "zz"
        out.append(" ".join(w))
    out += [words(rng, rng.randrange(1, 60)) for _ in range(15)]
    out += ["abab" * 200, "abab" * 200 + "c", passage]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 1) % 7 else None, len(t or ""), "clash", 7, "clash") for i, t in rows], COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    return frame(spark, [*rows, (3, rows[3][1]), (None, "null id text"), (None, None), (5, "same id, other text")]).cache()


@pytest.fixture(scope="module")
def unique(spark):
    return frame(spark, list(enumerate(texts()))).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def sha(b):
    return hashlib.sha256(b).hexdigest()


# 1


def test_media_round_trip(docs, empty):
    made = media.fingerprints(media.probe(media.store(docs)))
    got = made.join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert made.count() == docs.count() and media.fingerprints(media.probe(media.store(empty))).count() == 0
    for r in got:
        if r["doc_id"] == 5:
            continue
        raw = (r["text"] or "").encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), sha(want), zlib.crc32(want[-16:]))


def test_media_tables():
    data = bytes(range(192)) * 200
    m = media.mux(data)
    track = media.parse(m)[0]
    assert (track["codec"], len(track["sizes"]), track["ticks"]) == ("raw ", 200, track["duration"])
    assert media.read_samples(m, track) == data
    names = [p[-1] for p, _, _ in media.walk(m)]
    assert names[:3] == [b"ftyp", b"mdat", b"moov"] and b"stsz" in names
    for bad in (None, b"", b"junk", m[:-9], m.replace(b"stsz", b"xxxx")):
        with pytest.raises(ValueError):
            media.parse(bad)


def test_media_odd_tables():
    """Two chunks apart, sizes that differ, a sync table, 64-bit offsets and sizes."""
    import struct

    def full(kind, *parts):
        return media._full(kind, *parts)

    data = b"HEADaaabbbbb--cc"
    first = 16 + 8
    stbl = media._box(b"stbl", full(b"stsd", struct.pack(">I", 1), media._box(b"abcd", b"\0" * 8)), full(b"stts", struct.pack(">III", 1, 3, 5)), full(b"stss", struct.pack(">II", 1, 3)), full(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 1, 1)), full(b"stsz", struct.pack(">II", 0, 3), struct.pack(">III", 3, 5, 2)), full(b"co64", struct.pack(">I", 2), struct.pack(">QQ", first + 4, first + 14)))
    mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 15))
    trak = media._box(b"trak", media._box(b"mdia", mdhd, full(b"hdlr", struct.pack(">I4s12x", 0, b"soun")), media._box(b"minf", stbl)))

    m = struct.pack(">I4s", 8, b"free") + struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data + media._box(b"moov", trak)
    track = media.parse(m)[0]
    assert media.read_samples(m, track) == b"aaabbbbbcc"
    assert track["keys"].tolist() == [2] and (track["handler"], track["codec"]) == ("soun", "abcd")


# 2


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
                n[a] += 1
                n[b] += 1
    return {i: (len(sets[i]), find(i), n[i]) for i in range(len(rows))}


def test_jaccard_equals_brute_force(unique):
    rows = sorted((r["doc_id"], r["text"]) for r in unique.select("doc_id", "text").collect() if r["text"] is not None) + [(r["doc_id"], None) for r in unique.where("text is null").collect()]
    rows.sort()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(unique).collect()}
    assert got == brute_components(rows)


def test_jaccard_odd_rows(docs, empty):
    assert jaccard.join(empty).count() == 0
    rows = jaccard.join(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] == 3} == {0}
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id < 4").collect()) == [0]


def brute_table(spark, texts):
    rows = list(enumerate(texts))
    return frame(spark, rows), brute_components(rows)


def joined(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join(docs).collect()}


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = f"own{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("pairs", "block", "hot"), [(2, 4, 13), (5, 3, 3)])
def test_jaccard_balls_equal_brute_force(spark, monkeypatch, pairs, block, hot):
    """Groups of near copies of up to 8 changes, some linked only through others; small limits send them through balls, blocks and dealt tokens.

    Stages that run in workers see the module as it is on disk, so they are given the limits by their closures (:func:`limited`)."""
    rng = random.Random(11)
    made = [t for size, n, changes in ((60, 40, 2), (120, 60, 8), (200, 30, 12)) for t in near_copies(rng, words(rng, size), n, changes)]
    docs, want = brute_table(spark, made + [words(rng, 50) for _ in range(20)] + made[:5])
    limited(monkeypatch, PAIRS=pairs, BLOCK=block, HOT=hot)
    assert joined(docs) == want


def limited(monkeypatch, **values):
    """Other limits, in workers too: closures are pickled by value when the module counts as made up here."""
    from pyspark import cloudpickle

    for name, value in values.items():
        monkeypatch.setattr(jaccard, name, value)
    cloudpickle.register_pickle_by_value(jaccard)


@pytest.fixture(autouse=True)
def by_reference_again():
    yield
    from pyspark import cloudpickle

    if jaccard.__name__ in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.unregister_pickle_by_value(jaccard)


def test_a_licence_on_many_pages_links_nothing(spark):
    """600 documents of own words and one passage: no candidate group, no link; nor with a passage that is most of each."""
    rng = random.Random(4)
    licence = " ".join(f"lic{i}" for i in range(40))
    for own in (40, 9):
        docs = frame(spark, [(i, " ".join(f"o{rng.randrange(10**9)}" for _ in range(own)) + " " + licence) for i in range(600)])
        assert {r[1:] for r in joined(docs).values()} == {(i, 0) for i in range(600)}
        table = jaccard.levels(docs)
        found = jaccard.candidates(docs, table).where("kind = 0 and m >= need").count()
        assert found == 0


def test_a_token_in_half_of_all_documents(spark):
    rng = random.Random(6)
    line = "this very line is in half of all documents of the table"
    docs, want = brute_table(spark, [(line + " " if i % 2 else "") + words(rng, rng.choice((0, 3, 12, 40)), 4000) for i in range(300)])
    assert joined(docs) == want


def test_words_of_equal_polynomial_hash_are_told_apart(spark):
    """Two Thue-Morse words are equal under every polynomial modulo 2**64; here they aren't."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    for seed in (1, 2):
        (x,), (y,) = shingles.sets([a], seed=seed), shingles.sets([b], seed=seed)
        assert x.tolist() != y.tolist()
    docs, want = brute_table(spark, [a, b, a[:63], b[:63], a[:64], b[:64], a[:65], b[:65]])
    assert joined(docs) == want and {v[2] for v in want.values()} == {0}


def test_word_hashes_depend_on_the_word_alone():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(200))) + "x" * rng.randrange(80) for _ in range(50)]
    many = shingles.sets(texts)
    assert all(np.array_equal(m, shingles.sets([t])[0]) for m, t in zip(many, texts, strict=True))


def test_many_matches_lose_nothing():
    """Whatever l each set takes, linked sets share as many feasible prefix tokens as the smaller l."""
    rng = np.random.default_rng(1)
    linked = 0
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        cut = rng.random(len(a)) < 0.1
        b = np.unique(np.concatenate([a[~cut], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if not len(b) or 100 * inter < 75 * (len(a) + len(b) - inter):
            continue
        linked += 1
        table = np.zeros(1 << jaccard.SLOTS, np.uint8)
        some = rng.choice(a, len(a) // 2, replace=False)
        table[some >> np.uint64(64 - jaccard.SLOTS)] = rng.integers(3, 12, len(some))
        (pa_, la, _), (pb, lb, _) = jaccard.prefix(a, table), jaccard.prefix(b, table)
        need, m = min(la, lb), 0
        for t in np.intersect1d(pa_, pb):
            ra, rb = (np.ceil(255 * (len(s) - p.tolist().index(t)) / len(s)) for s, p in ((a, pa_), (b, pb)))
            m += bool(jaccard.feasible(len(a), len(b), ra, rb, need))
        assert m >= need
    assert linked > 100


def test_levels_count_documents(spark):
    rng = random.Random(8)
    line = "ten words that stand in sixty four documents of all"
    docs = frame(spark, [(i, words(rng, 30, 9000) + (" " + line if i < 64 else "")) for i in range(100)])
    table = jaccard.levels(docs)
    (s,) = shingles.sets([line])
    assert set(table[s >> np.uint64(64 - jaccard.SLOTS)].tolist()) == {6}
    assert (table > 0).sum() == len(s)


def test_representatives_of_rows_without_ids(spark):
    rng = random.Random(3)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(None, a), (None, a), (None, a + " x"), (7, b), (7, a + " y"), (9, b + " z"), (None, None), (8, "")]
    kept = jaccard.representatives(frame(spark, rows))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(7, b), (7, a + " y"), (None, None), (8, "")], key=repr)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# 3


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for x in range(len(b) - 99):
            if b[x : x + 100] in seen:
                gone[x : x + 100] = b"\1" * 100
            else:
                seen.add(b[x : x + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), len(b) - len(kept), sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1])), sha(kept))
    return out


def test_repeats_equal_brute_force(unique, empty):
    rows = sorted(((r["doc_id"], r["text"]) for r in unique.select("doc_id", "text").collect()), key=lambda r: r[0])
    got = {r[0]: tuple(r)[1:] for r in repeats.digest(unique).collect()}
    assert got == brute_repeats(rows)
    assert repeats.digest(empty).count() == 0


def test_repeats_odd_rows(docs):
    rows = repeats.digest(docs).collect()
    assert len(rows) == docs.count()
    same = [tuple(r) for r in rows if r["doc_id"] == 3]
    assert len(same) == 2 and same[0] == same[1]
    cut = repeats.cut(docs)
    assert cut.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in cut.collect())


@pytest.mark.parametrize("bits", [64, 8, 2])
@pytest.mark.parametrize("limit", [1, 3, 512])
def test_repeats_paths(monkeypatch, limit, bits):
    """Each way of comparing windows gives the brute-force result, with hashes cut to a few bits as well; run in this process, stage by stage."""
    monkeypatch.setattr(repeats, "ROWS", limit)
    monkeypatch.setattr(repeats, "SLICED", 7)
    for name in ("ANCHOR", "CONTENT"):
        monkeypatch.setattr(repeats, name, np.uint64(2**bits - 1))
    whole = suffixes.Text.hash
    monkeypatch.setattr(suffixes.Text, "hash", lambda self, at, length: grams.mixed(whole(self, at, length)) & np.uint64(2**bits - 1))
    rng = random.Random(3)
    passage = words(rng, 30)
    rows = [(i, words(rng, 25) + " " + passage[: rng.randrange(60, len(passage))] + " " + words(rng, 25)) for i in range(30)]
    marks = run_repeats(rows)
    want = brute_repeats(rows)
    for i, t in rows:
        keep, spans = repeats.kept(t.encode(), marks.get(i, np.zeros(0, repeats.MARK)))
        assert (len(t.encode()) - int(keep.sum()), spans) == want[i][1:3]


def test_repeats_last_group_straddles_a_slice(monkeypatch):
    """More than 10,000 rows in a task; a multiple of it lies in the last group, behind its start."""
    import pyarrow as pa

    f = np.zeros(10_002, repeats.SENT)
    f["g"], f["rid"], f["text"] = np.arange(len(f)) // 3, np.arange(len(f)), 97

    class Frame:
        columns, calls, out = ("rid", "text"), 0, None

        def mapInArrow(self, fn, _):
            self.calls += 1
            if self.calls == 2:
                batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([repeats.FEW], pa.int32()), pa.array([f.tobytes()], pa.binary())], names=["bucket", "kind", "data"])
                self.out = [r for b in fn(iter([batch])) for r in b.to_pylist()]
            return self

        select = repartition = lambda self, *_: self

    monkeypatch.setattr(repeats, "_with_texts", lambda texts, *_: texts)
    monkeypatch.setattr(repeats, "SLICED", 10_000)
    for whole in (False, True):
        if not whole:  # then only the sorted windows tell
            monkeypatch.setattr(repeats, "whole_runs", lambda f: np.zeros(len(f), bool))
        else:
            monkeypatch.undo()
            monkeypatch.setattr(repeats, "_with_texts", lambda texts, *_: texts)
        done = repeats._windows(Frame(), Frame(), 3)
        assert sorted(int(x) for r in done.out for x in np.frombuffer(r["data"], repeats.MARK)["rid"]) == [i for i in range(len(f)) if i % 3]


def run_repeats(rows):
    import pyarrow as pa

    class Frame:  # what the stages ask of a frame, over a list of batches
        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, fn, _):
            return Frame([b for b in fn(iter(self.batches))])

        select = repartition = lambda self, *_: self

    parts = 3
    texts_ = Frame([pa.RecordBatch.from_pydict({"rid": [r for r, _ in part], "text": [t for _, t in part]}) for part in (rows[:11], rows[11:])])
    found = [r for b in repeats._anchors(texts_, parts).batches for r in b.to_pylist()]
    import unittest.mock as m

    def with_texts(_, packed, parts):
        every = sorted([*((r["bucket"], r["kind"], r["data"], None, None) for r in packed), *((i % parts, 0, None, i, t) for i, t in rows)], key=lambda r: (r[0], -r[1]))
        return Frame([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*every), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()))], names=["bucket", "kind", "data", "rid", "text"])])

    with m.patch.object(repeats, "_with_texts", with_texts):
        more = repeats._windows(texts_, [r for r in found if r["kind"] != repeats.MARKS], parts).batches
    marks = defaultdict(list)
    for r in [r for r in found if r["kind"] == repeats.MARKS] + [r for b in more for r in b.to_pylist()]:
        for x in np.frombuffer(r["data"], repeats.MARK):
            marks[int(x["rid"])].append(x)
            assert int(x["rid"]) % parts == r["bucket"]
    return {i: np.array(x, repeats.MARK) for i, x in marks.items()}


def test_suffix_sort_and_extensions():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(97, 99, 400).astype(np.uint8), np.zeros(40, np.uint8)])
    text = suffixes.Text(data)
    at = np.arange(380)
    group = np.repeat([0, 1], 190)
    order = text.sort(at, group, 30)
    raw = data.tobytes()
    for g in (0, 1):
        own = [int(at[i]) for i in order if group[i] == g]
        assert [raw[x : x + 30] for x in own] == sorted(raw[x : x + 30] for x in own)
    x, y = rng.integers(40, 300, 200), rng.integers(40, 300, 200)
    fore = text.common(x, y, np.full(200, 35))
    for a, b, f in zip(x, y, fore, strict=True):
        assert f == next((i for i in range(35) if raw[a + i] != raw[b + i]), 35)
    # A shuffled order is found out and mended.
    wrong = np.concatenate([rng.permutation(190), 190 + rng.permutation(190)])
    mended, same = text.verified(at, group, 30, wrong)
    for g in (0, 1):
        own = [raw[at[i] : at[i] + 30] for i in mended if group[i] == g]
        assert own == sorted(own)
        assert same[group == g].tolist() == [False, *(x == y for x, y in zip(own, own[1:]))]


def test_anchors_follow_content():
    rng = random.Random(6)
    body = bytes(rng.randrange(97, 100) for _ in range(300))
    data, starts, ends = grams.laid([b"xyz" + body, body + b"q", b"short"])
    d, a, s1, s2, _ = winnow.runs(data, starts, ends, 100, 32)
    place = {(int(i), int(s - starts[i])): int(x - s) for i, x, p, q in zip(d, a, s1, s2, strict=True) for s in range(p, q + 1)}
    assert len(place) == 303 - 99 + 301 - 99
    for s in range(201):
        assert place[(0, s + 3)] == place[(1, s)]


# 4


def test_bpe_equals_reference_encoder(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["a  b", " a", "a ", "a \n b", "\t x", "don't DON'T", "x" * 700, "<|endoftext|>", "½ ٣4 é ǅ", "　 w", "\x1c \x85 z", "  ", " \n ", "word, word. word!? (word)"]
    codec = bpe.ByteBPE(RANKS, PATTERN)
    for t, ids in zip(odd, codec.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS)
    for r in got.join(docs.select("doc_id", "text"), "doc_id").where("doc_id not in (3, 5)").collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "").encode()
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0
    starts, chars = codec.offsets(codec.encode(["é日🎉 x"])[0])
    assert starts[0] == 0 and chars == sorted(chars) and chars[-1] == 3


# 5


def test_mixing(spark, empty):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), f"s{0 if rng.random() < 0.4 else rng.randrange(1, 5)}" if i % 9 else None) for i in range(3000)] + [(7, None, "s9"), (7, None, "s9")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixing.mix(d.repartition(7)).collect())
    size, order = defaultdict(int), sorted({s for _, _, s in rows if s}) + [None]
    for _, t, s in rows:
        size[s] += len((t or "").split())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:  # the excess goes round until none is above
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == 0 and r["taken"] == 0 or r["taken"] in (0, r["size"], 2 * r["size"])
        if r["doc_id"] != 7:
            assert r["target"] == pytest.approx(target[s]) and r["source_size"] == size[s]
            taken[s] += r["taken"]
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, abs=60)
    mixture = mixing.mixture(d)
    assert mixture.columns == d.columns
    assert mixture.select(F.sum(mixing.size_of())).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix(empty).count() == 0


def test_mix_maps_and_empty_sizes(spark):
    rows = [(i, " " if i % 2 else None, "a", {"k": i % 3}) for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string, int>")
    assert {(r["size"], r["taken"]) for r in mixing.mix(d).collect()} == {(0, 0)} and mixing.mix(d).count() == 50
    assert mixing.mixture(d).count() == 0
    full = d.withColumn("text", F.lit("a b c"))
    assert mixing.mix(full).agg(F.sum("taken")).first()[0] == 225 and mixing.mixture(full).count() == 75


# 6 and 9


def test_language(spark):
    rng = random.Random(9)
    vocab = {"en": "the of and to in is that it was for".split(), "de": "der die und in den von zu das mit sich".split(), "fr": "le la les des est pour dans que une sur".split(), "es": "el la los que en del por una con para".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(12)), lang) for i in range(400) for lang in [list(vocab)[i % 4]]] + [(900, None, "en"), (901, "", "de"), (902, "123 !!", "fr"), (903, "der und die " * 5000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(d, language.fit(d)).collect()}
    held = [i for i, _, lang in rows if lang and i < 900 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held)
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nobody = language.predict(d, language.fit(d.where("lang is null")))
    assert {r["lang_pred"] for r in nobody.collect()} == {"und"}


def test_quality(spark, docs):
    rng = random.Random(10)
    rows = [(i, " ".join(f"{rng.choice('abc')}{rng.choice('de')}{rng.choice('fgh')}" + ("!!" if i % 3 == 0 else "") for _ in range(20))) for i in range(300)] + [(901, None), (902, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(300)] + [(5, 1), (None, 1), (902, None)], "doc_id long, quality int")
    model = quality.fit(d, labels)
    got = {r["doc_id"]: r for r in quality.score(d, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == (i % 3 != 0) for i in held) >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert quality.keep(d, model).count() == sum(r["predicted"] for r in got.values())
    none = quality.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


# 7


def page(body, i=0):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>'</script></head><body><nav><a>menu {i}</a></nav>{body}<footer>f {i}</footer></body></html>"


def test_pages(spark):
    art = "<article><h1>H &amp; t</h1><p>a <b>b</b>\n c&nbsp;d<br>e<p>two<div class='comments'><article>no</article></div><aside>no</aside><form>no</form></article>"
    rows = [(1, "http://a.example/x", page(art)), (2, None, None), (3, "junk", ""), (4, "http://a.example/y", page("<div class='ad'>x</div><main><p>m</p></main>")), (1, "http://a.example/x", page(art))]
    rows += [(100 + i, "http://b.example/", page(f"<div><p>Same line</p><p>Own {i}</p><ul><li>Same item</li></ul></div>", i)) for i in range(8)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = pages.extract(d).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[1] == "H & t\na b c d e\ntwo" and by[2] == by[3] == "" and by[4] == "m"
    assert all(by[100 + i] == f"Own {i}" for i in range(8)) and all(r["n_chars"] == len(r["text"]) for r in got)
    (made,) = pages.templates(d).where("host = 'b.example'").collect()
    assert len(made["texts"]) == 2 and {c["outer"] for c in made["classes"]} == {-1}
    assert pages.extract(d.where("false")).count() == 0


def test_pages_template_inside_articles(spark):
    rows = [(i, "http://a.example/", page(f"<p>Top {i}</p><article><p>Own {i}</p><div><p>Read this on our site</p></div></article><article><p>More {i}</p></article>")) for i in range(8)]
    rows += [(10 + i, "http://b.example/", page("<article><p>One text</p><p>of copies</p></article>")) for i in range(6)]
    rows += [(20 + i, "http://c.example/", page(f"<article><p>Join us</p></article><div><p>Own {i}</p></div>")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own {i}\nMore {i}" for i in range(8))
    assert all(got[10 + i] == "One text\nof copies" and got[20 + i] == f"Own {i}" for i in range(6))


@pytest.mark.parametrize("wrap", ["div class='content-sidebar-wrap'", "div class='page has-sidebar'", "div id='page-with-nav'", "form action='/'", "div class='site-banner'", "div role='form'"])
def test_pages_wrapped_article(wrap):
    inner = "<article><p>Own</p><div class='comment-list'><article>no</article></div><form>no</form></article><div class='comments'><article>no</article></div>"
    assert pages.main_text(page(f"<{wrap}>{inner}</{wrap.split()[0]}>")) == "Own"
    assert pages.main_text(page(f"<{wrap}>{inner.replace('article', 'main', 1).replace('</form></article>', '</form></main>')}</{wrap.split()[0]}>")) == "Own"


def test_pages_attributes():
    for kept in ('title="the hidden gem"', 'data-hidden="false"', "title='a class=ad b'", "data-x=\"id='ad'\"", "aria-label=hidden"):
        assert pages.main_text(page(f"<article><p>a</p><p {kept}>b</p></article>")) == "a\nb"
    for gone in ("hidden", 'title="x" hidden', "hidden=''", "class=ad", "id = 'ad'", "CLASS='x ad'", 'style="display: none"'):
        assert pages.main_text(page(f"<article><p>a</p><p {gone}>b</p></article>")) == "a"


def extracted(spark, bodies, url="http://a.example/"):
    rows = [(i, url, page(b, i)) for i, b in enumerate(bodies)]
    return [r["text"] for r in sorted(pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r["page_id"])]


def test_pages_without_article_or_names(spark):
    """Only the template's slots and what they hold on the host's pages tell the text from menu, advert and footer."""
    rng = random.Random(12)
    own = [(words(rng, 6), [words(rng, rng.randrange(8, 40)) for _ in range(rng.randrange(1, 5))], words(rng, 4)) for _ in range(9)]
    bodies = [
        f"<div><a href='/'>Home</a> <a href='/{i}'>{words(rng, 2)}</a></div><div>{ad}</div><div><h1>{head}</h1>{''.join(f'<p>{x}</p>' for x in text)}<ul><li><a href='#'>{words(rng, 5)}</a></li></ul></div><div>All rights</div>"
        for i, (head, text, ad) in enumerate(own)
    ]
    assert extracted(spark, bodies) == ["\n".join([head, *text]) for head, text, _ in own]
    # The same page alone, and one that has another layout than its host.
    other = "<section><h2>Odd</h2><p>one out, of which there is a sentence</p></section>"
    assert extracted(spark, [*bodies, other])[-1] == "Odd\none out, of which there is a sentence"
    assert pages.main_text(page(bodies[0])) == "\n".join([own[0][0], *own[0][1]])


def test_pages_keep_content_of_any_name(spark):
    rng = random.Random(13)
    own = [[words(rng, 30) for _ in range(3)] for _ in range(6)]
    bodies = [f"<article><p>{a}</p><div class='related-work'>{b}</div></article><div class=promo>buy {i}</div><article><div class='notice-of-appeal'>{c}</div></article>" for i, (a, b, c) in enumerate(own)]
    assert extracted(spark, bodies) == ["\n".join(x) for x in own]


def test_pages_comments_longer_than_the_article(spark):
    rng = random.Random(14)
    own = [words(rng, 30) for _ in range(7)]
    bodies = [f"<article><p>{x}</p></article><div class='reader-comments'>{''.join(f'<article><p>{words(rng, 40)}</p></article>' for _ in range(5))}</div>" for x in own]
    assert extracted(spark, bodies) == own
    bodies = [f"<div><h1>h</h1><p>{x}</p></div><div id='comments'>{''.join(f'<p>{words(rng, 40)}</p>' for _ in range(5))}</div>" for x in own]
    assert [t.split("\n")[-1] for t in extracted(spark, bodies)] == own


def test_pages_occurrence_vectors_equal_brute_force(spark):
    """Classes from aggregated hashes are those of the vectors themselves."""
    rng = random.Random(15)
    bodies = [f"<div class=x><p>Always</p>{'<p>Often</p><b>Often too</b>' if i % 4 else ''}{'<ul><li>a</li><li>b</li></ul>' * (i % 3)}<p>{words(rng, 9)}</p></div>" for i in range(12)]
    html = [page(b, i) for i, b in enumerate(bodies)]
    vectors = defaultdict(lambda: [0] * len(html))
    for i, h in enumerate(html):
        for t in pages.tokens_of(pages.read(h)):
            vectors[t[0]][i] = t[4]
    classes = defaultdict(set)
    for token, v in vectors.items():
        if sum(map(bool, v)) >= max(pages.CLASS_PAGES, pages.SUPPORT * len(html)):
            classes[tuple(v)].add(token)
    rows = [(i, "http://a.example/", h) for i, h in enumerate(html)]
    (made,) = pages.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = defaultdict(set)
    for c in made["classes"]:
        got[c["number"]].add(c["token"])
    # A valid class is a vector's tokens, or those of them that lie in one slot.
    assert all(any(members <= whole for whole in classes.values()) for members in got.values())
    assert {frozenset(w) for w in classes.values() if len(w) > 1} == {frozenset(w) & frozenset(x) for w in classes.values() if len(w) > 1 for x in [set().union(*got.values())]}
    outer = {c["number"]: c["outer"] for c in made["classes"]}
    assert -1 in outer.values() and any(o >= 0 for o in outer.values())


@pytest.mark.parametrize("bad", ["<x ", '<x "', "<a b='", "<!x ", "<!-- ", "</x ", "<a =", "<div>", "<p>a", "<p><b>", "<li><ul>", "<script>"])
def test_pages_hard_markup_is_linear(bad):
    import time

    begun = time.perf_counter()
    pages.main_text(bad * ((1 << 20) // len(bad)))
    assert time.perf_counter() - begun < 8


# 8


def test_chat(spark):
    rng = random.Random(11)
    rows = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (2, 0, None, None), (3, 0, "system", "only"), (None, 1, "assistant", "n"), (4, 0, "a\nb<|n", "x"), (5, 1, "user", "t"), (5, 1, "user", "t")]
    rows += [(10, i, "system" if i == 0 else ("user", "assistant")[i % 2 == 0], " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 90))) + "<||<<|") for i in range(60)] + [(11, 0, "assistant", "long " * 5000)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, window string")
    got = {r["conv_id"]: r for r in chat.digest(chat.windows(d, budget=200)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()), len(said), sha(said.encode()))
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
    made = [r for r in chat.windows(d, budget=200).collect() if r["conv_id"] == 10]
    assert len(made) > 5 and all(r["formatted"].startswith("<|im_start|>system") for r in made)
    assert all(chat.tokens(r["formatted"]) <= 200 for r in made)
    for t in ("<|", "<||", "<|<|||n", "<|n\n"):
        assert chat.unescape(chat.escape(t)) == t and chat.unescape_role(chat.escape_role(t)) == t
    assert chat.digest(chat.windows(d.where("false"))).count() == 0


def test_chat_large_system_turn():
    """A system turn over half of the budget is in the first window only; no window exceeds the budget but for a turn that does so alone."""
    for size, budget in ((3000, 1024), (600, 1024), (100, 1024)):
        w = chat.Windows(budget, 2)
        turns = [("system", "s " * size)] + [(("user", "assistant")[i % 2], f"t{i} " * 150) for i in range(12)]
        out = [x for r, t in turns for x in w.add(r, t)] + list(w.end())
        assert [t for text, _, new in out for t in chat.read_back(text, new)] == turns
        held = ["s s" in text for text, _, _ in out]
        assert held[0] and all(held) == (2 * size < budget) and any(held[1:]) == (2 * size < budget)
        assert all(chat.tokens(text) <= budget for text, _, _ in out[size > budget :])


# 10


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(12)
    v = rng.normal(0, 0.3, (700, 8)).round(1)
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)] + [(800, None), (850, [float("nan")] * 8), (900, [1.0, None] * 4), (None, [0.0] * 8), (950, [float("inf")] * 8), (650, [float(x) for x in v[3]])]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    q = d.where("vec_id % 50 = 0")
    good = [(i, np.floor(np.float32(x).astype(np.float64) * 256).astype(int)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all()]
    want = []
    for i in sorted({i for i, _ in good if i % 50 == 0 and i != 650}):
        x = next(x for j, x in good if j == i)
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted((-int(x @ y), j) for j, y in good if j != i)[:5])]
    got = sorted(tuple(r) for r in nearest.search(d, q, 5).where("query_id <> 650").collect())
    assert got == sorted(want)
    monkeypatch.setattr(nearest, "SMALL", 200)
    assert sorted(tuple(r) for r in nearest.search(d, q, 5).where("query_id <> 650").collect()) == sorted(want)
    assert nearest.search(d.where("false"), q.where("false")).count() == 0


def test_nearest_wide_and_few(spark, monkeypatch):
    """Scores beyond 64 bits count as the nearest 64-bit integer; fewer than k candidates; one very common vector."""
    rng = np.random.default_rng(14)
    v = [[float(x) for x in row] for row in rng.normal(0, 1, (40, 3)) * 10.0 ** rng.integers(0, 13, (40, 1))] + [[1.0, 1.0, 1.0]] * 60
    rows = list(enumerate(v))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(nearest, "SMALL", 30)
    got = sorted(tuple(r) for r in nearest.search(d, d.where("vec_id % 10 = 0"), 5).collect())
    whole = [[int(np.floor(256 * x)) for x in e] for _, e in rows]
    want = []
    for i in range(0, 100, 10):
        scores = sorted((-nearest._long(sum(a * b for a, b in zip(whole[i], whole[j], strict=True))), j) for j in range(100) if j != i)
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:5])]
    assert got == sorted(want)
    few = d.where("vec_id < 3")
    assert nearest.search(few, few, 5).count() == 6 and nearest.search(few, d.where("vec_id = 50"), 5).count() == 3


def test_tree_bounds():
    rng = np.random.default_rng(13)
    v = np.floor(rng.normal(0, 40, (900, 6)))
    tree = nearest.Tree(np.arange(900), v, leaf=32)
    q = np.floor(rng.normal(0, 40, (20, 6)))
    bounds = tree.bounds(q)
    for n, (a, b) in enumerate(tree.span):
        assert (bounds[:, n] >= (q @ tree.vectors[a:b].T).max(1)).all()


# Pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(14)
    passage = words(rng, 60)
    rows = [(i, words(rng, 80) + (" " + passage if i % 10 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(20)] + [(300 + i, "JUNK!! " * 60 + f"x{i}", "en", "s1", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 300)) for i, *_ in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "test")
        left.append(docs)
        if name != "byte-level bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in left]
    assert ids[0] == sorted(i for i, *_ in rows if i < 300)
    assert ids[1] == list(range(120))
    assert [passage in r["text"] for r in left[2].where("doc_id % 10 = 0").orderBy("doc_id").collect()][:2] == [True, False]
    assert ids[3] == ids[4]
    assert all(r["decoded_sha256"] for r in left[4].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])


def test_pipeline_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, rows without doc_id, a clashing extra column; and empty tables."""
    rng = random.Random(21)
    good = [(i, words(rng, 60), "en", f"s{i % 2}" if i % 5 else None, 0, "x") for i in range(60)]
    odd = [(100, None, None, None, None, None), (101, "", "en", "s0", 0, "x"), (None, words(rng, 40), "en", "s1", 0, "x"), (None, None, None, "s1", None, None), good[3], good[3], (4, words(rng, 50), "en", "s0", 0, "x"), (102, good[7][1] + " more", "en", "s0", 0, "x")]
    junk = [(200 + i, "JUNK!! " * 60 + f"x{i}", "en", "s1", 0, "x") for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    labels = [(i, 1) for i in range(60)] + [(200 + i, 0) for i in range(40)] + [(100, 1), (None, 1), (5, None)]
    for name, rows in (("all", good + odd + junk), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels if rows else [], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
        for stage, run in corpus_pipeline.STAGES:
            docs = common.stored(run(spark, docs, folder), "test")
            left.append(docs.collect())
            if stage != "byte-level bpe":
                assert docs.columns == schema.replace(" string", "").replace(" long", "").split(", ")
        if not rows:
            assert not any(left)
            continue
        ids = [[r["doc_id"] for r in x] for x in left]
        assert set(range(60)) <= set(ids[0]) and not set(ids[0]) & set(range(200, 240)) and ids[0].count(3) == 3
        assert ids[1].count(3) == 1 and ids[1].count(4) == 2 and 102 not in ids[1] and set(range(60)) <= set(ids[1])
        assert all(r["text"] is not None and r["n_chars"] in (None, len(r["text"])) for r in left[2])
        assert 100 not in ids[3] and 101 not in ids[3] and max(ids[3].count(i) for i in ids[3] if i is not None) <= 4
        assert {r["doc_id"]: len(r["ids"]) // 4 == r["n_tokens"] > 0 for r in left[4]}.values() and all(r["ids_sha256"] == sha(r["ids"]) for r in left[4])
        texts_ = {sha(r["text"].encode()) for r in left[3]}
        assert {r["decoded_sha256"] for r in left[4]} == texts_ and {r["source"] for r in left[4]} == {None, "s0", "s1"}


def test_a_wrong_decoding_fails(spark):
    d = spark.createDataFrame([(1, "a", bytearray(b"b"))], "doc_id long, text string, decoded binary")
    with pytest.raises(Exception, match="gave other bytes"):
        bpe.checked(d).collect()


# The registered queries, over whole tables of the smallest folder

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    if not __import__("os").path.exists(SMALL):
        pytest.skip("no test data")
    return {t: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ("doc_id", "text", "lang", "source")), ("labels", ("doc_id", "quality")), ("pages", ("page_id", "html")), ("conversations", ("conv_id", "turn", "role", "text")))}


def test_queries_agree_with_their_sql(spark, tables):
    from lexmill.llm import queries
    from lexmill.plans.check import differences

    for name, _, n, same, odd in differences(spark, SMALL, list(queries.SQL), queries.queries(), queries.SQL):
        assert same and n, (name, odd)


def test_queries_equal_brute_force(spark, tables):
    import tiktoken
    from lexmill.llm import queries

    run = lambda name: queries.queries()[name](spark, SMALL).collect()
    docs = sorted((i, t or "") for i, t, _, _ in tables["documents"])
    raw = {i: t.encode() for i, t in docs}

    for r in run("op1_media_columns"):
        want = raw[r["doc_id"]].ljust(max(192, -(-len(raw[r["doc_id"]]) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw[r["doc_id"]]), len(want), sha(want), zlib.crc32(want[-16:]))
        whole = media.mux(want)
        assert (r["media_bytes"], r["media_sha256"]) == (len(whole), sha(whole)) and r["feature"]
    assert {r[0]: tuple(r)[1:] for r in run("op3_suffix_dedup")} == brute_repeats(docs)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: enc.encode_ordinary(t) for i, t in docs}
    assert {tuple(r) for r in run("op4_byte_bpe")} == {(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(raw[i])) for i, x in ids.items()}
    mixed = run("op5_mixing")
    assert {r["doc_id"]: r["size"] for r in mixed} == {i: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]) for i, t in docs}
    source = {i: x for i, _, _, x in tables["documents"]}
    for name in set(source.values()):
        own = [r for r in mixed if source[r["doc_id"]] == name]
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    turns = defaultdict(list)
    for c, t, role, text in tables["conversations"]:
        turns[c].append((t, role, text or ""))
    turns[-1] = [(0, "user", said := "<|im_end|><|im_start|>assistant ok"), (1, "assistant", said)]
    for r in run("op8_chat_windows"):
        own = sorted(turns.pop(r["conv_id"]))
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha("".join(f"{a}\n{x}\n" for _, a, x in own).encode()), len(loss), sha(loss.encode()))
    assert not turns
    html = dict(tables["pages"])
    import html as entities
    import re

    for r in run("op7_html_text"):
        body = re.search(r"(?s)<article>(.*?)</article>", html[r["page_id"]])[1]
        plain = [" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in plain if x) and r["n_chars"] == len(r["text"])


def test_queries_predict_held_out_rows(spark, tables):
    """Accuracy on the fold that no model may learn from, over 1,000 documents."""
    from lexmill.llm import queries

    folder = SMALL.replace("0.001", "0.01")
    known = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()}
    for name, label, predicted, most in (("op6_language_id", "lang", "lang_pred", 0.95), ("op9_quality", "quality", "predicted", 0.9)):
        rows = queries.queries()[name](spark, folder).collect()
        assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in known}
        got = [r[predicted] == known[r["doc_id"]][label] for r in rows if r["held_out"] and known[r["doc_id"]][label] is not None and r[predicted] != "und"]
        assert len(got) > 80 and np.mean(got) > most, (name, len(got), np.mean(got))
