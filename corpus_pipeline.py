"""Corpus preparation: the stages in order, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``documents``. :func:`run` writes each stage's result as Parquet in the shared scratch folder and reads it
again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, jaccard, mixing, quality, repeats
from lexmill.llm.common import stored, table

#: Rank file of the encoding.
RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go. It learns from the labelled rows among ``docs``.

    Null and empty texts are scored like others (no features: the model's bias decides); without usable labels all scores
    are 0.5 and all rows go; rows of a null doc_id are scored but never learned from; repeated rows all stay or all go; an
    empty table gives no rows; other columns stay as they are.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component only the document of the smallest doc_id stays, once.

    Null, empty and blank texts have no shingles and stay, once for each doc_id and text; of rows without doc_id that are
    linked with nothing that has one, the first class keeps one; rows that repeat a doc_id with other texts are documents
    of their own; an empty table gives no rows; other columns stay as they are.
    """
    return jaccard.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: repeated passages are cut out of the texts; a document that is nothing but repeats goes.

    A null text becomes an empty one and stays, as do empty texts; what a cut leaves of a character goes; n_chars follows
    the text; rows that repeat doc_id and text are one document, and each gets its result; an empty table gives no rows.
    """
    return repeats.cut(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents as often as the mix takes them (at most twice), in its order.

    Null, empty and blank texts have no words and are never taken; a null source is a source of its own; repeated rows are
    documents of their own; an empty table gives no rows; other columns stay as they are.
    """
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, source, n_tokens, ids (binary, little-endian unsigned 32-bit), ids_sha256, decoded_sha256.

    Each text's ids are decoded again, and the job fails where that isn't the text. A null text has no ids; repeated rows
    are encoded each; an empty table gives no rows; other columns go.
    """
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    made = bpe.checked(bpe.decode(bpe.encode(docs, path, pattern, keep=("source", "text")), path))
    return made.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram jaccard join", one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level bpe", encode),
]
#: No stage but the mix could be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs
