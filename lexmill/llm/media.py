"""Media columns: ISO media containers (ISO/IEC 14496-12) written, walked and probed.

:func:`store` keeps a text's bytes losslessly as one video track of raw 8-bit grey frames, 16 by 12 pixels (192 bytes,
the unit), so every media feature follows from the text alone. :func:`probe` walks nested boxes, decodes the sample
tables (stsd, mdhd, stts, stss, stsz or stz2, stsc, stco or co64) into codec, duration and key-frame byte ranges, and
never reads a sample's bytes; :func:`read_samples` uses the tables to read them back.

Defined cases: a null text counts as empty; the payload of an empty text is one frame of blanks; equal texts give equal
containers; a container that is null, cut or not ISO media gives null features and an ``error``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from lexmill.llm.common import map_arrow

WIDTH, HEIGHT, UNIT = 16, 12, 192
TIMESCALE, DELTA, CHUNK = 24_000, 1_000, 64
#: Boxes that only hold boxes.
NESTS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"mvex", b"moof", b"traf", b"udta"])


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with blanks up to a positive multiple of the unit, and their number before that."""
    raw = (text or "").encode()
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(data: bytes) -> bytes:
    """A container whose only track holds ``data`` (a multiple of the unit) as raw grey frames; its times are zero, so equal data give equal bytes."""
    n = len(data) // UNIT
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    chunks = -(-n // CHUNK)
    first = len(ftyp) + 8
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1, b"\x04grey".ljust(32, b"\0"), 40, -1)
    runs = [(1, CHUNK)] if n % CHUNK == 0 else [(1, CHUNK), (chunks, n % CHUNK)] if chunks > 1 else [(1, n)]
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
        _full(b"stts", struct.pack(">III", 1, n, DELTA)),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs]),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        _full(b"stco", struct.pack(">I", chunks), (first + UNIT * CHUNK * np.arange(chunks)).astype(">u4").tobytes()),
    )
    length = n * DELTA
    moov = _box(
        b"moov",
        _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, length, 0x10000, 0x100), _MATRIX, b"\0" * 24, struct.pack(">I", 2)),
        _box(
            b"trak",
            _full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, length, 0, 0, 0, 0, 0), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7),
            _box(
                b"mdia",
                _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, length, 0x55C4, 0)),
                _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
                _box(b"minf", _full(b"vmhd", b"\0" * 8, flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl),
            ),
        ),
    )
    return ftyp + _box(b"mdat", data) + moov


def walk(data: bytes, begin: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """Each box's path, and where its body begins and ends, in order; payload boxes are stepped over. Raises ValueError on a cut box."""
    end = len(data) if end is None else end
    while begin < end:
        if end - begin < 8:
            raise ValueError("a box header is cut")
        size, kind = struct.unpack_from(">I4s", data, begin)
        body = begin + 8
        if size == 1:
            if end - begin < 16:
                raise ValueError("a box header is cut")
            size, body = struct.unpack_from(">Q", data, body)[0], begin + 16
        stop = end if size == 0 else begin + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} is cut")
        here = (*path, kind)
        yield here, body, stop
        if kind in NESTS:
            yield from walk(data, body, stop, here)
        begin = stop


def _table(data: bytes, at: int, columns: int, count: int, kind: str = ">u4") -> np.ndarray:
    out = np.frombuffer(data, kind, columns * count, at).astype(np.int64)
    return out.reshape(count, columns) if columns > 1 else out


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict:
    u32 = lambda at: struct.unpack_from(">I", data, at)[0]
    at = boxes[b"mdhd"][0]
    long = data[at] == 1
    scale, length = u32(at + (20 if long else 12)), struct.unpack_from(">Q" if long else ">I", data, at + (24 if long else 16))[0]
    handler = data[boxes[b"hdlr"][0] + 8 :][:4].decode("latin-1")
    codec = data[boxes[b"stsd"][0] + 12 :][:4].decode("latin-1") if u32(boxes[b"stsd"][0] + 4) else None
    if b"stsz" in boxes:
        at = boxes[b"stsz"][0]
        each, n = u32(at + 4), u32(at + 8)
        sizes = np.full(n, each, np.int64) if each else _table(data, at + 12, 1, n)
    else:
        at = boxes[b"stz2"][0]
        bits, n = data[at + 7], u32(at + 8)
        if bits == 4:
            both = np.frombuffer(data, np.uint8, -(-n // 2), at + 12)
            sizes = np.stack([both >> 4, both & 15], 1).reshape(-1)[:n].astype(np.int64)
        else:
            sizes = _table(data, at + 12, 1, n, f">u{bits // 8}")
    wide = b"co64" in boxes
    at = boxes[b"co64" if wide else b"stco"][0]
    chunks = _table(data, at + 8, 1, u32(at + 4), ">u8" if wide else ">u4")
    at = boxes[b"stsc"][0]
    runs = _table(data, at + 8, 3, u32(at + 4)).reshape(-1, 3)
    per = np.zeros(len(chunks), np.int64)
    for i, (a, k, _) in enumerate(runs.tolist()):
        per[a - 1 : runs[i + 1, 0] - 1 if i + 1 < len(runs) else None] = k
    if per.sum() < n:
        raise ValueError("the chunks hold too few samples")
    of_chunk = np.repeat(np.arange(len(chunks)), per)[:n]
    before = np.concatenate([[0], np.cumsum(sizes)])[:n]
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    offsets = chunks[of_chunk] + before - before[np.minimum(first[of_chunk], max(n - 1, 0))] if n else before
    at = boxes[b"stts"][0]
    steps = _table(data, at + 8, 2, u32(at + 4)).reshape(-1, 2)
    keys = _table(data, (at := boxes[b"stss"][0]) + 8, 1, u32(at + 4)) - 1 if b"stss" in boxes else np.arange(n)
    keys = keys[(keys >= 0) & (keys < n)]
    return {"handler": handler, "codec": codec, "timescale": scale, "duration": length, "ticks": int((steps[:, 0] * steps[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "keys": keys}


def parse(data: bytes | None) -> list[dict]:
    """The tracks of a container, from its boxes alone. Raises ValueError where it isn't whole ISO media."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    try:
        for path, body, stop in walk(data or b""):
            if path == (b"moov", b"trak"):
                tracks.append({})
            elif len(path) > 2 and path[:2] == (b"moov", b"trak"):
                tracks[-1][path[-1]] = (body, stop)
        if not tracks:
            raise ValueError("no track")
        return [_track(data, t) for t in tracks]
    except (KeyError, IndexError, struct.error) as e:
        raise ValueError(f"a table is missing or cut: {e!r}") from e


def read_samples(data: bytes, track: dict) -> bytes:
    """The bytes of a track's samples in their order."""
    at, size = track["offsets"], track["sizes"]
    if not len(at):
        return b""
    breaks = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]]) - 1
    return b"".join(data[at[a] : at[b] + size[b]] for a, b in zip(first, last, strict=True))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text, unpadded) and ``media``: the container that holds its payload."""

    def run(cols, n):
        both = [payload(t) for t in cols[text]]
        return {key: cols[key], "n_bytes": [b for _, b in both], "media": [mux(p) for p, _ in both]}

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, n_bytes bigint, media binary", text)


PROBED = "codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<offset:bigint,length:bigint>>, error string"


def probe(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Adds to key, n_bytes and media: codec, timescale, duration, n_samples and the byte ranges of key frames of the first track (joined where they touch), and ``error``."""

    def run(cols, n):
        out = cols | {c: [] for c in ("codec", "timescale", "duration", "n_samples", "keyframes", "error")}
        for m in cols[media]:
            try:
                t, error = parse(m)[0], None
                at, size = t["offsets"][t["keys"]], t["sizes"][t["keys"]]
                cut = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1 if len(at) else np.zeros(0, np.int64)
                a, b = np.concatenate([[0], cut])[: len(at)], np.concatenate([cut, [len(at)]])[: len(at)] - 1
                ranges = [{"offset": int(at[i]), "length": int(at[j] + size[j] - at[i])} for i, j in zip(a, b, strict=True)]
                row = (t["codec"], t["timescale"], t["duration"], len(t["sizes"]), ranges)
            except ValueError as e:
                row, error = (None,) * 5, str(e)
            for c, v in zip(("codec", "timescale", "duration", "n_samples", "keyframes", "error"), (*row, error), strict=True):
                out[c].append(v)
        return out

    kind = stored.schema[key].dataType.simpleString()
    return map_arrow(stored.select(key, "n_bytes", media), run, f"`{key}` {kind}, n_bytes bigint, `{media}` binary, {PROBED}", media)


def fingerprints(probed: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Reads each payload back through the sample tables: payload_bytes, payload_sha256, tail_crc32 (last 16 bytes), media_bytes, media_sha256 and ``feature``."""

    def run(cols, n):
        back = [read_samples(m, parse(m)[0]) if e is None else None for m, e in zip(cols[media], cols["error"], strict=True)]
        sha = lambda b: None if b is None else hashlib.sha256(b).hexdigest()
        return {
            key: cols[key],
            "n_bytes": cols["n_bytes"],
            "payload_bytes": [None if b is None else len(b) for b in back],
            "payload_sha256": [sha(b) for b in back],
            "tail_crc32": [None if b is None else zlib.crc32(b[-16:]) for b in back],
            "media_bytes": [None if m is None else len(m) for m in cols[media]],
            "media_sha256": [sha(m) for m in cols[media]],
            "feature": [
                f"{e}" if e else f"codec={c.strip()};timescale={s};duration={d};samples={k};keyframes={','.join(f'{r["offset"]}+{r["length"]}' for r in ranges)}"
                for e, c, s, d, k, ranges in zip(cols["error"], cols["codec"], cols["timescale"], cols["duration"], cols["n_samples"], cols["keyframes"], strict=True)
            ],
        }

    kind = probed.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_arrow(probed, run, schema, media)
