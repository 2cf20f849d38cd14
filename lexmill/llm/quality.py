"""Quality classifier: supervised subword embeddings.

Every word, character n-gram and kind of word pair (the same word twice, or two) has a learned vector in a hashed table; a document is the average of its features'
vectors, and a softmax layer gives class probabilities. Training is plain stochastic gradient descent in numpy on a
bounded sample of labelled rows (:data:`SAMPLE`, the smallest hashes of doc_id). As average and layer are linear, scoring
needs one number a feature, and reads every byte of every text.

Defined cases: a null or empty text has no features and gets the score of the intercept; rows of a null quality, and
labels of a null doc_id, teach nothing; repeated labels of a row count once (the lowest); without any usable label every
score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import grams
from lexmill.llm.common import held_out, map_arrow, sliced, trimmed

#: Bound of the labelled rows that training collects to the driver.
SAMPLE = 2500
GRAMS, BITS, DIM, EPOCHS, RATE = (3, 5), 16, 8, 4, 0.1
#: From this score on a row is predicted to be of class 1.
THRESHOLD = 0.7


@dataclass
class Model:
    weights: np.ndarray  # a column a feature: vector times (class 1 minus class 0)
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = grams.mean_score([(t or "").encode() for t in texts], self.weights, GRAMS, BITS, True)[:, 0] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    size = grams.size(GRAMS, BITS)
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros((size, 1), np.float32), 0.0 if not labels else (4.0 if labels[0] else -4.0))
    rng = np.random.default_rng(seed)
    data = [r for at in range(0, len(texts), 100) for r in grams.rows([t.encode() for t in texts[at : at + 100]], GRAMS, BITS, True)]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            f, share = data[i]
            mean = share @ vectors[f]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p * np.float32(0.1)
            # A feature's own share of the average is tiny; as in a sum over occurrences its step counts them, at most so many.
            vectors[f] -= rate * np.minimum(share * 400, 20)[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0]))[:, None].astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled rows outside the held-out fold: those of the smallest hash of the key."""
    taught = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min(label).alias("_label"))
    few = taught.orderBy(F.xxhash64(key), key).limit(sample)
    got = docs.select(key, text).where(~held_out(key)).join(F.broadcast(few), key).orderBy(F.xxhash64(key), text).limit(sample).collect()
    return train([r[text] or "" for r in got], [int(r["_label"]) for r in got])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols, n):
        s = shared.value.score(cols[text])
        return {key: cols[key], "held_out": cols["held_out"], "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, held_out(key).alias("held_out"), text), run, f"`{key}` {kind}, held_out boolean, score double, predicted int", text)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted to be of class 1, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in sliced(batch, text, 1 << 20):
                s = shared.value.score(part.column(part.schema.names.index(text)).to_pylist())
                yield part.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(trimmed(run), schema)
