"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file gives every token's bytes. Its bytes are written with one printable character each (the byte table), so the
library's BPE model can hold them; a pair of tokens may merge when their concatenation is a token, at that token's rank.

Long texts repeat words, so the library sees each distinct chunk once: a text is cut before spaces where no match of the
pattern can cross the cut, and the ids of chunks are kept in a bounded table for each Python worker.

Defined cases: a null text is encoded as the empty text (no ids); rows are independent, so ties, repeated rows and empty
tables need no rule; other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_arrow

#: Distinct chunks whose ids a worker keeps before it starts anew; bounds memory only.
KEPT_CHUNKS = 180_000
#: A chunk longer than this isn't kept.
KEPT_LENGTH = 64
#: The white space of the pattern's ``\\s``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where one of these is in a text, a match may cross a cut before a space.
_UNSAFE = [w + " " for w in WHITE]
#: A letter run and one of these after it are two matches of the pattern.
_STOPS = frozenset(",.;:!?")


def byte_table() -> list[str]:
    """Printable character of each byte: itself where printable and not a blank, else the next from U+0100."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Decoder:
    """The bytes of each id, from the characters of its token by the reversed byte table."""

    def __init__(self, rank_file: str):
        table = byte_table()
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of = {rank: bytes(back[c] for c in map(table.__getitem__, token)) for token, rank in read_ranks(rank_file).items()}

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids: bytes, as ids of one character may be apart; an unknown id raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class ByteBPE:
    """Encoder and decoder for a rank file (lines of base64 token and rank)."""

    def __init__(self, rank_file: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(rank_file)
        table = byte_table()
        shown = {token: "".join(table[b] for b in token) for token in ranks}
        merges = [
            (shown[token[:cut]], shown[token[cut:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.model = self.tokenizer.model
        self.shown = dict(enumerate(table))
        self.stops = {c: np.asarray(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in _STOPS}
        self.decoder = Decoder(rank_file)
        self.kept: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Pieces of the text that no match of the pattern crosses; joined they give the text."""
        if text[0] == " " or text[-1] == " " or any(u in text for u in _UNSAFE):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _letters(self, run: str) -> bytes:
        """Ids of a run of letters with at most one space before: a single match, so the model alone decides."""
        if (ids := self.kept.get(run)) is None:
            ids = np.array([t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.shown))], "<u4").tobytes()
            if len(run) <= KEPT_LENGTH:
                self.kept[run] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.kept) > KEPT_CHUNKS:
            self.kept = {c: self.kept[c] for c in _STOPS if c in self.kept}
        cut = [self.chunks(t) if t else [] for t in texts]
        here, found, other = self.kept, {}, []
        for chunk in set().union(*cut).difference(here):
            body = chunk[1:] if chunk[0] == " " else chunk
            if body.isalpha():
                ids = self._letters(chunk)
            elif body[-1:] in _STOPS and body[:-1].isalpha():
                ids = self._letters(chunk[:-1]) + self.stops[body[-1]]
            else:
                other.append(chunk)
                continue
            (here if len(chunk) <= KEPT_LENGTH else found)[chunk] = ids
        for at in range(0, len(other), 10_000):
            part = other[at : at + 10_000]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (here if len(chunk) <= KEPT_LENGTH else found)[chunk] = np.asarray(e.ids, "<u4").tobytes()
        if found:
            return [b"".join([here[c] if c in here else found[c] for c in one]) for one in cut]
        return [b"".join(map(here.__getitem__, one)) for one in cut]

    def decode(self, ids: bytes) -> bytes:
        return self.decoder.decode(ids)

    def offsets(self, ids: bytes) -> tuple[list[int], list[int]]:
        """For each id, the byte where it begins, and the character that this byte belongs to (a split character counts at each of its ids)."""
        sizes = [len(self.decoder.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.zeros(0, np.int64)
        raw = np.frombuffer(self.decode(ids), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return begins.tolist(), char[begins].tolist() if sizes else []


@lru_cache(2)
def _codec(rank_file: str, pattern: str) -> ByteBPE:
    return ByteBPE(rank_file, pattern)


@lru_cache(2)
def _decoder(rank_file: str) -> Decoder:
    return Decoder(rank_file)


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to ``keep``, n_tokens, ids (binary, little-endian unsigned 32-bit); with ``offsets`` also byte_starts and char_starts."""
    own = [key, *(c for c in keep if c != key)]

    def run(cols, n):
        codec = _codec(rank_file, pattern)
        ids = codec.encode(cols[text])
        out = {c: cols[c] for c in own} | {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}
        if offsets:
            pairs = [codec.offsets(x) for x in ids]
            out |= {"byte_starts": [p[0] for p in pairs], "char_starts": [p[1] for p in pairs]}
        return out

    schema = f"{_schema(docs, own)}, n_tokens bigint, ids binary" + ", byte_starts array<bigint>, char_starts array<bigint>" * offsets
    # The tokenizer goes with its partition: workers live on, and what follows needs their memory.
    return map_arrow(docs.select(*dict.fromkeys([*own, text])), run, schema, text, after=_codec.cache_clear)


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """Adds ``decoded`` (binary) to the columns of :func:`encode`; null ids decode to no bytes."""

    def run(cols, n):
        codec = _decoder(rank_file)
        return cols | {"decoded": [codec.decode(x or b"") for x in cols["ids"]]}

    return map_arrow(encoded, run, f"{_schema(encoded, encoded.columns)}, decoded binary", "ids")


def checked(decoded: DataFrame, text: str = "text") -> DataFrame:
    """The rows as they are; the job fails where decoding hasn't given back the bytes of ``text`` (null: none)."""
    same = F.col("decoded") == F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return decoded.withColumn("decoded", F.when(same, F.col("decoded")).otherwise(F.raise_error(F.lit("decoding a text's ids gave other bytes")).cast("binary")))


def digest(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

