"""Competing preprocessing pipelines as expressions from a text to its terms, their trace and their comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import lexicon
from lexmill.functions import text as T
from lexmill.functions.stem import STEMMERS


def lemmas(words: Column, lemma=T.rule_lemma) -> Column:
    return F.transform(words, lemma)


def final(text, lemma=T.rule_lemma) -> Column:
    """B: lemmas, then custom stop words dropped by surface form."""
    return _final(T.content_tokens(text), lemma)


def _final(words: Column, lemma=T.rule_lemma) -> Column:
    return F.transform(F.filter(words, lambda w: ~w.isin(*lexicon.CUSTOM_STOPWORDS)), lemma)


def reordered(text, lemma=T.rule_lemma) -> Column:
    """B reordered: custom stop words go before lemmas are made. With a lemma that doesn't look at neighbours this equals B; a contextual one may differ."""
    return lemmas(T.without(T.content_tokens(text), lexicon.CUSTOM_STOPWORDS), lemma)


def lemmas_only(text, lemma=T.rule_lemma) -> Column:
    """C."""
    return lemmas(T.content_tokens(text), lemma)


def stopped(text) -> Column:
    """A before its stemmer: the English stop words dropped. The stemmer runs on distinct words, see :func:`stemmed`."""
    return T.without(T.content_tokens(text), lexicon.ENGLISH_STOPWORDS)


PIPELINES = {"B": final, "B reordered": reordered, "C": lemmas_only, "A (unstemmed)": stopped}
#: The same from content tokens to terms.
_OF_WORDS = {"B": _final, "B reordered": lambda w: lemmas(T.without(w, lexicon.CUSTOM_STOPWORDS)), "C": lemmas, "A (unstemmed)": lambda w: T.without(w, lexicon.ENGLISH_STOPWORDS)}


def stemmed(docs: DataFrame, stemmer: str = "Snowball", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A: (key, terms): stop words dropped, then the stems of each batch's distinct words put in their places; nothing is shuffled."""
    fn = STEMMERS[stemmer]

    def cut(batches):
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            stems = pa.array([fn(w) for w in words.dictionary.to_pylist()], pa.string())
            ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), stems.take(words.indices))], [key, "terms"])

    rows = docs.select(key, F.coalesce(stopped(text), F.array().cast("array<string>")).alias("terms"))
    return rows.mapInArrow(cut, rows.schema)


def trace(text, lemma=T.rule_lemma) -> Column:
    """The stages of the final pipeline: array of struct(stage, output)."""
    policy = T.number_policy(text)
    words = T.content_tokens(text)
    stage = lambda n, c: F.struct(F.lit(n).alias("stage"), c.alias("output"))
    return F.array(
        stage("text", F.col(text) if isinstance(text, str) else text),
        stage("number policy", policy),
        stage("tokens", F.array_join(T.tokens(policy), " | ")),
        stage("content tokens", F.array_join(words, " | ")),
        stage("lemmas", F.array_join(lemmas(words, lemma), " | ")),
        stage("terms", F.array_join(final(text, lemma), " | ")),
    )


def compare(docs: DataFrame, words: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Tokens kept, vocabulary and (given a list ``word``) readable share of each pipeline."""
    # Each of these goes word by word, so it is applied to the distinct words.
    found = docs.select(F.explode(T.content_tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(name).alias("pipeline"), fn(F.array("word")).alias("terms")) for name, fn in _OF_WORDS.items()])
    made = found.select("n", F.explode(each).alias("x")).select("n", "x.pipeline", F.explode("x.terms").alias("term"))
    counts = made.groupBy("pipeline", "term").agg(F.sum("n").alias("n"))
    if words is not None:
        counts = counts.join(words.select(F.col("word").alias("term"), F.lit(1).alias("known")).distinct(), "term", "left")
    else:
        counts = counts.withColumn("known", F.lit(None).cast("int"))
    return counts.groupBy("pipeline").agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"), (100 * F.count("known") / F.count("*")).alias("readable_pct"))


def lemma_changes(docs: DataFrame, a=final, b=reordered, text: str = "text") -> DataFrame:
    """Terms that one pipeline has and the other lacks, by sentence: term, only_in, n."""
    s = docs.select(F.explode(T.sentences(text)).alias("s"))
    both = s.select(a("s").alias("a"), b("s").alias("b"))
    each = both.select(F.explode(F.concat(F.transform(F.array_except("a", "b"), lambda t: F.struct(t.alias("term"), F.lit("first").alias("only_in"))), F.transform(F.array_except("b", "a"), lambda t: F.struct(t.alias("term"), F.lit("second").alias("only_in"))))).alias("x"))
    return each.groupBy("x.term", "x.only_in").agg(F.count("*").alias("n"))
