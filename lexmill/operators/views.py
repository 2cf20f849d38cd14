"""What a user of the engine calls: text probes, tokenizer checks, relevance, comparison of pipelines, summary tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import lexicon, patterns
from lexmill.functions import text as T
from lexmill.operators import retrieval

# Query terms that name a topic.
TOPIC_WORDS = {
    "depression": ("depression", "depressive", "depressed", "depress"),
    "anxiety": ("anxiety", "anxious", "anxieti", "gad", "panic", "worry", "generalised", "generalis"),
    "medication": (
        "medication", "medic", "medicine", "medicin", "antidepressant", "antidepress", "ssri", "snri", "sertraline", "fluoxetine",
        "citalopram", "escitalopram", "paroxetine", "mirtazapine",
    ),
    "self_harm": ("self-harm",),
    "suicide": ("suicide", "suicid", "suicidal"),
    "trauma": ("ptsd", "trauma", "traumat", "traumatic", "post-traumatic"),
    "eating": ("eating", "eat", "anorexia", "bulimia", "binge"),
    "self_esteem": ("self-esteem", "confidence", "confid"),
    "loneliness": ("loneliness", "loneli", "lonely"),
    "stress": ("stress", "stressed"),
    "sleep": ("sleep", "insomnia"),
    "substance_use": ("alcohol", "drug", "substance", "naltrexone", "acamprosate", "disulfiram", "baclofen", "cocaine", "opioid"),
}


def passage(docs: DataFrame, key_value, start: str, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n characters of a document from a phrase on."""
    at = F.locate(start, F.col(text))
    return docs.where((F.col(key) == key_value) & (at > 0)).select(key, F.substr(F.col(text), at, F.lit(n)).alias("passage"))


def find_sentence(docs: DataFrame, phrase: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first sentence of each document that holds a phrase, whatever its case."""
    hit = F.filter(T.sentences(text), lambda s: F.lower(s).contains(phrase.lower()))
    return docs.where(F.lower(text).contains(phrase.lower())).select(key, F.try_element_at(hit, F.lit(1)).alias("sentence")).where(F.col("sentence").isNotNull())


def example_snippet(docs: DataFrame, pattern: str, target: str | None = None, width: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document's text around a target (else around the pattern's most frequent match), without the cut words at both ends."""
    if target is None:
        best = docs.select(F.explode(T.matches(text, pattern)).alias("m")).groupBy("m").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "m").first()
        if best is None:
            return docs.where("false").select(key, F.lit("").alias("target"), F.lit("").alias("snippet"))
        target = best["m"]
    at = F.locate(target, F.col(text))
    begin = F.greatest(at - width, F.lit(1))
    words = T.whitespace_tokens(F.substr(F.col(text), begin, at - begin + len(target) + width))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    return docs.where(at > 0).orderBy(key).limit(1).select(key, F.lit(target).alias("target"), F.array_join(inner, " ").alias("snippet"))


def special_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """Terms that a general tokenizer should leave whole: term, n."""
    kinds = [patterns.DOMAIN_PROBLEMS[p] for p in ("P1", "P5", "P7", "P9")] + [r"\b\d+-[a-z]+(?:-[a-z]+)*\b"]
    found = F.flatten(F.array(*[T.matches(T.normalise(text), p) for p in kinds]))
    return docs.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def hybrid_tokens(text, terms: list[str]) -> Column:
    """A general tokenizer (words, numbers, single signs) that leaves the given terms whole, the longest first."""
    whole = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    body = r"\w+(?:'\w+)?|[^\w\s]"
    return T.matches(T.normalise(text), rf"(?<!\w)(?:{whole})(?!\w)|{body}" if whole else body)


def tokenizer_check(cases: DataFrame, tokenizers: dict | None = None) -> DataFrame:
    """case, text, expected (array): for each tokenizer, whether every expected unit comes out whole."""
    made = [cases.select("case", F.lit(n).alias("tokenizer"), (F.size(F.array_except("expected", fn("text"))) == 0).alias("whole")) for n, fn in (tokenizers or T.TOKENIZERS).items()]
    return reduce(DataFrame.unionByName, made)


def stop_views(sentences: DataFrame, text: str = "text") -> DataFrame:
    """A sentence's terms without each stop list's words, to see what a list does to its meaning."""
    words = F.transform(T.tokens(text), F.lower)
    return sentences.select(text, F.array_join(T.without(words, lexicon.ENGLISH_STOPWORDS), " ").alias("english"), F.array_join(T.without(words, lexicon.CUSTOM_STOPWORDS), " ").alias("custom"))


def extraction_summary(extracted: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words and characters extracted and in the corpus, and the share kept."""
    whole = F.array_join(F.flatten("extracted.pages"), "\n")
    a = extracted.select(key, F.regexp_count(whole, F.lit(r"(?U)\w+")).alias("words_extracted"), F.length(whole).alias("chars_extracted"))
    b = corpus.select(key, F.regexp_count("text", F.lit(r"(?U)\w+")).alias("words_kept"), F.length("text").alias("chars_kept"))
    return a.join(b, key).withColumn("kept_pct", F.when(F.col("words_extracted") > 0, 100 * F.col("words_kept") / F.col("words_extracted")))


def parse_ids(text: str | None, pattern: str = r"[Dd](\d+)", form: str = "D{:02d}") -> set[str]:
    """Ids in a list like ``d1, D07 d25``."""
    return {form.format(int(m[1])) for part in re.split(r"[,;\s]+", text or "") if (m := re.fullmatch(pattern, part))}


def relevance(docs: DataFrame, judged: DataFrame, query: str, mode: str, terms: list[str], own: str = "", key: str = "doc_id") -> tuple[DataFrame | None, str]:
    """Relevant documents and where they come from: the user's list, else judgments of the same query and mode, else documents with a topic that the terms name, else none.

    judged: query, mode, doc_id; docs may have topics (array).
    """
    every = docs.select(key)
    if ids := parse_ids(own):
        mine = every.where(F.col(key).isin(*ids))
        if not mine.isEmpty():
            return mine, "own list"
    said = judged.where((F.col("query") == " ".join(query.split())) & (F.col("mode") == mode)).select(key).distinct()
    if not said.isEmpty():
        return said, "judgments"
    topics = sorted({topic for topic, names in TOPIC_WORDS.items() if set(names) & set(terms)})
    if topics and "topics" in docs.columns:
        near = docs.where(F.arrays_overlap("topics", F.array(*map(F.lit, topics)))).select(key)
        if not near.isEmpty():
            return near, "estimate by topics: " + ", ".join(topics)
    return None, "none"


def compare_pipelines(docs: DataFrame, made: dict, query: str, mode: str, relevant: DataFrame, splitter=T.sentences) -> DataFrame:
    """Measures of the same query over an index of each pipeline, against one set of relevant documents."""
    rows = []
    for name, pipeline in made.items():
        found = retrieval.search(retrieval.build(docs, pipeline, splitter), query, mode, pipeline)
        score = "occurrences" if mode == "phrase" else "score"
        order = F.row_number().over(retrieval.Window.orderBy(F.desc(score), "doc_id"))
        ranked = found.select(F.lit(name).alias("query_id"), "doc_id", order.alias("rank"))
        rows.append(retrieval.evaluate(ranked, relevant.select(F.lit(name).alias("query_id"), "doc_id")))
    return reduce(DataFrame.unionByName, rows).withColumnRenamed("query_id", "pipeline")


def mean_by_type(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Mean measures of each query type (kinds: query_id, type)."""
    measures = [c for c, t in rows.dtypes if t == "double"]
    return rows.join(kinds, "query_id").groupBy("type").agg(*[F.avg(c).alias(c) for c in measures])


def dense_judgments(queries: DataFrame, docs: DataFrame, judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each query and document with relevant 0 or 1; queries are a bounded set."""
    grid = docs.select(key).crossJoin(F.broadcast(queries.select("query_id").distinct()))
    return grid.join(judged.select("query_id", key, F.lit(1).alias("relevant")).distinct(), ["query_id", key], "left").na.fill(0, ["relevant"])


def metric_table(rows: DataFrame, by: str = "pipeline") -> DataFrame:
    """Measures as rows, one column for each pipeline."""
    measures = [c for c, t in rows.dtypes if t == "double"]
    return rows.unpivot([by], measures, "measure", "value").groupBy("measure").pivot(by).agg(F.first("value"))


def gap_table(counts: DataFrame, base: DataFrame) -> DataFrame:
    """Entities that one recognizer has and what another calls them: entity, label, n, other (``missed`` where it has none)."""
    return counts.join(base.select("entity", F.col("label").alias("other")), "entity", "left").withColumn("other", F.coalesce("other", F.lit("missed")))
