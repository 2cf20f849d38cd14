"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family (one against the rest) chooses the family; within it, a machine
for each pair of languages votes, so closely related languages are told apart by their own features. Features are shares
of hashed words and byte n-grams of the lower-cased text; machines are trained in numpy by AdaGrad on the hinge loss over
a bounded sample of labelled rows (:data:`SAMPLE` for each language, by the smallest hashes of doc_id).

Defined cases: a text that is null or has no letter is ``und`` with score 1; with one language learned, that is the
answer; without any, ``und`` with score 0; rows of a null lang teach nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import grams
from lexmill.llm.common import held_out, map_arrow

#: Bound of the labelled rows of each language that training collects, and of languages.
SAMPLE, LANGUAGES = 800, 200
GRAMS, BITS, EPOCHS, RATE, PENALTY, SCALE = (2, 3), 16, 6, 0.3, 1e-5, 30.0
#: Families of languages by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


@dataclass
class Model:
    families: list[str]
    members: list[list[int]]  # languages of each family
    langs: list[str]
    pairs: list[tuple[int, int]]  # within families
    weights: np.ndarray  # features, families then pairs
    bias: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        z = grams.mean_score([t.lower().encode() for t in texts], self.weights, GRAMS, BITS) * SCALE + self.bias
        sure = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
        k = len(self.families)
        fam = np.argmax(z[:, :k], 1)
        votes = np.zeros((len(texts), len(self.langs)))
        for c, (a, b) in enumerate(self.pairs):
            p = sure(z[:, k + c])
            votes[:, a] += p
            votes[:, b] += 1 - p
        out, score = [], np.empty(len(texts))
        for i, f in enumerate(fam):
            own = self.members[f]
            best = own[int(np.argmax(votes[i, own]))]
            out.append(self.langs[best])
            score[i] = (sure(z[i, f]) if k > 1 else 1.0) * (votes[i, best] / (len(own) - 1) if len(own) > 1 else 1.0)
        return out, score


def _machine(data: list, rows: np.ndarray, sign: np.ndarray, rng) -> tuple[np.ndarray, float]:
    """A linear support vector machine: AdaGrad on the hinge loss, classes weighted to count alike."""
    size = grams.size(GRAMS, BITS)
    w, sq, bias, sq_bias = np.zeros(size, np.float32), np.full(size, 1e-6, np.float32), 0.0, 1e-6
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f, x = data[rows[i]]
            if sign[i] * (w[f] @ x * SCALE + bias) < 1:
                g = np.float32(-sign[i] * share[i]) * x * np.float32(SCALE) + np.float32(PENALTY) * w[f]
                sq[f] += g * g
                w[f] -= RATE * g / np.sqrt(sq[f])
                gb = -sign[i] * share[i]
                sq_bias += gb * gb
                bias -= RATE * gb / sq_bias**0.5
    return w, bias


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    fams = sorted({family(x) for x in langs})
    members = [[i for i, x in enumerate(langs) if family(x) == f] for f in fams]
    pairs = [p for m in members for p in combinations(m, 2)]
    data = [r for at in range(0, len(texts), 100) for r in grams.rows([t.lower().encode() for t in texts[at : at + 100]], GRAMS, BITS)]
    of = np.array([langs.index(x) for x in labels], np.int64)
    fam = np.array([fams.index(family(x)) for x in labels], np.int64)
    made = [_machine(data, np.arange(len(data)), np.where(fam == f, 1, -1), rng) for f in range(len(fams))] if len(fams) > 1 else [(np.zeros(grams.size(GRAMS, BITS)), 0.0)] * len(fams)
    for a, b in pairs:
        rows = np.flatnonzero((of == a) | (of == b))
        made.append(_machine(data, rows, np.where(of[rows] == a, 1, -1), rng))
    weights = np.stack([w for w, _ in made], 1).astype(np.float32) if made else np.zeros((1, 0), np.float32)
    return Model(fams, members, langs, pairs, weights, np.array([b for _, b in made]))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from text and non-null lang outside the held-out fold: of each language at most ``sample`` rows, those of the smallest hash of the key."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    counts = usable.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(LANGUAGES).collect()
    if not counts:
        return train([], [])
    # The share of a language's rows that gives twice the sample; its smallest hashes are among them.
    unit = (F.xxhash64(key).cast("double") / 2.0**64) + 0.5
    near = [(F.col(lang) == r[lang]) & (unit <= (2.0 * sample + 50) / r["count"]) for r in counts]
    few = usable.where(F.array_max(F.array(*[F.coalesce(c, F.lit(False)) for c in near]))).select(key, text, lang)
    got, taken, texts, labels = few.orderBy(F.xxhash64(key), key, text).limit(len(counts) * (3 * sample + 100)).collect(), {}, [], []
    for r in got:
        if taken.get(r[lang], 0) < sample:
            taken[r[lang]] = taken.get(r[lang], 0) + 1
            texts.append(r[text])
            labels.append(r[lang])
    return train(texts, labels)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols, n):
        lang, score = shared.value.predict([t or "" for t in cols[text]])
        none = [not x for x in cols["_letters"]]
        return {
            key: cols[key],
            "held_out": cols["held_out"],
            "lang_pred": ["und" if u else x for u, x in zip(none, lang, strict=True)],
            "score": [1.0 if u else float(s) for u, s in zip(none, score, strict=True)],
        }

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, held_out(key).alias("held_out"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), text)
    return map_arrow(rows, run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double", text)
