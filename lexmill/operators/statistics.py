"""Corpus statistics, tokenizer and stop word comparisons, n-gram tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexicon, patterns
from lexmill.functions import text as T
from lexmill.sources import scratch


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    words = T.whitespace_tokens(text)
    return docs.select(
        key,
        (F.size(F.split(text, r"\.")) - 1).cast("bigint").alias("sentences"),
        F.size(words).cast("bigint").alias("tokens"),
        F.length(text).cast("bigint").alias("characters"),
        F.size(F.array_distinct(F.transform(words, F.lower))).cast("bigint").alias("vocabulary"),
    )


def corpus_totals(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row; the vocabulary is that of the union of all documents."""
    sums = document_statistics(docs, text=text).agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in ("sentences", "tokens", "characters")])
    words = docs.select(F.explode(F.transform(T.whitespace_tokens(text), F.lower)).alias("w"))
    return sums.crossJoin(F.broadcast(words.agg(F.count_distinct("w").alias("vocabulary"))))


def counting_checks(docs: DataFrame, text: str = "text") -> DataFrame:
    """What distorts a count of sentences by dots: dots in numbers, abbreviations, lines without a dot at their end."""
    rows = docs.select(F.regexp_count(text, F.lit(r"[0-9]\.[0-9]")).alias("a"), F.regexp_count(text, F.lit(r"e\.g\.|i\.e\.")).alias("b"), F.size(F.filter(T.lines(text), lambda x: ~F.rtrim(x).endswith("."))).alias("c"))
    return rows.agg(F.sum("a").alias("dots_in_numbers"), F.sum("b").alias("abbreviations"), F.sum("c").alias("lines_without_dot"))


def balance(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Documents, tokens, mean and share of tokens of each group."""
    rows = docs.select(by, F.size(T.whitespace_tokens(text)).cast("bigint").alias("n")).groupBy(by).agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.avg("n").alias("mean_tokens"))
    return rows.withColumn("share_pct", 100 * F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))


def before_after(before: DataFrame, after: DataFrame, terms: str = "terms") -> DataFrame:
    """Documents, tokens and vocabulary before and after, and the change in percent, one row a measure."""
    one = lambda d, n: d.agg(F.count("*").cast("double").alias("documents"), F.sum(F.size(terms)).cast("double").alias("tokens"), F.count_distinct(F.lit(1)).alias("_")).drop("_").crossJoin(d.select(F.explode(terms).alias("t")).agg(F.count_distinct("t").cast("double").alias("vocabulary"))).unpivot([], ["documents", "tokens", "vocabulary"], "measure", n)
    return one(before, "before").join(one(after, "after"), "measure").withColumn("change_pct", 100 * (F.col("after") - F.col("before")) / F.col("before"))


def splitter_comparison(docs: DataFrame, splitters: dict, text: str = "text") -> DataFrame:
    """Units, mean words, units of over 60 words and of under 3, for each splitter."""
    made = [docs.select(F.lit(name).alias("splitter"), F.explode(fn(text)).alias("s")) for name, fn in splitters.items()]
    n = F.size(T.whitespace_tokens("s"))
    rows = reduce(DataFrame.unionByName, made).withColumn("n", n)
    return rows.groupBy("splitter").agg(F.count("*").alias("units"), F.avg("n").alias("mean_words"), F.sum((F.col("n") > 60).cast("bigint")).alias("over_60"), F.sum((F.col("n") < 3).cast("bigint")).alias("under_3"))


def dictionary_sizes(docs: DataFrame, tokenizers: dict, text: str = "text") -> DataFrame:
    made = [docs.select(F.lit(name).alias("tokenizer"), F.explode(fn(text)).alias("token")) for name, fn in tokenizers.items()]
    counts = reduce(DataFrame.unionByName, made).groupBy("tokenizer", "token").agg(F.count("*").alias("n"))
    rows = counts.withColumn("term", T.to_term("token")).groupBy("tokenizer").agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_tokens"), F.count_distinct("term").alias("distinct_terms"))
    return rows.withColumn("reduction_pct", 100 * (1 - F.col("distinct_terms") / F.col("distinct_tokens")))


def token_categories(docs: DataFrame, tokenizers: dict, text: str = "text") -> DataFrame:
    """Entries of each tokenizer's dictionary by category."""
    made = [docs.select(F.lit(name).alias("tokenizer"), F.explode(fn(text)).alias("token")) for name, fn in tokenizers.items()]
    return reduce(DataFrame.unionByName, made).distinct().groupBy("tokenizer", T.token_category("token").alias("category")).agg(F.count("*").alias("entries"))


def case_duplicates(docs: DataFrame, tokenizers: dict, text: str = "text") -> DataFrame:
    made = [docs.select(F.lit(name).alias("tokenizer"), F.explode(fn(text)).alias("token")) for name, fn in tokenizers.items()]
    return reduce(DataFrame.unionByName, made).distinct().groupBy("tokenizer").agg((F.count("*") - F.count_distinct(F.lower("token"))).alias("case_duplicates"))


def pattern_profile(docs: DataFrame, table: dict[str, str], key: str = "doc_id", text: str = "text", top: int = 5) -> DataFrame:
    """For each pattern: occurrences, distinct forms, documents and the most frequent forms."""
    found = docs.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("id"), T.matches(text, p).alias("m")) for i, p in table.items()])).alias("x")).select(key, "x.id", F.explode("x.m").alias("form"))
    per = found.groupBy("id", "form", key).agg(F.count("*").alias("n"))
    sums = per.groupBy("id").agg(F.sum("n").alias("occurrences"), F.count_distinct("form").alias("forms"), F.count_distinct(key).alias("documents"))
    ranked = per.groupBy("id", "form").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "form"))).where(F.col("r") <= top)
    best = ranked.groupBy("id").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("r", "form"))), lambda x: x["form"])).alias("examples"))
    return sums.join(best, "id", "left")


def kept_share(found: DataFrame, produced: DataFrame) -> DataFrame:
    """Of units found (id, form, n), the share that the tokens produced (form, n) keep whole."""
    rows = found.join(produced.withColumnRenamed("n", "p"), "form", "left")
    return rows.groupBy("id").agg((100 * F.sum(F.least("n", F.coalesce("p", F.lit(0)))) / F.sum("n")).alias("kept_pct"))


def number_policy_effect(docs: DataFrame, text: str = "text") -> DataFrame:
    made = [docs.select(F.lit(name).alias("setting"), F.explode(T.tokens(fn(F.col(text)))).alias("token")) for name, fn in (("tokens", lambda c: c), ("policy + tokens", T.number_policy))]
    counts = reduce(DataFrame.unionByName, made).groupBy("setting", "token").agg(F.count("*").alias("n")).withColumn("number", F.col("token").rlike(r"\p{Nd}"))
    return counts.groupBy("setting").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("number"), F.col("n")).otherwise(0)).alias("number_tokens"), F.sum(F.col("number").cast("bigint")).alias("distinct_number_tokens"), F.count("*").alias("vocabulary"))


def category_profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The number categories' profile."""
    table = {c: ("(?i)" if c in patterns.CASELESS_CATEGORIES else "") + p for c, p in patterns.NUMBER_CATEGORIES.items()}
    return pattern_profile(docs, table, key, text, 6)


STOP_LISTS = {"none": (), "english": lexicon.ENGLISH_STOPWORDS, "custom": lexicon.CUSTOM_STOPWORDS}


def stopword_effect(terms: DataFrame, lists: dict[str, tuple[str, ...]] | None = None, word: str = "term") -> DataFrame:
    """Kept and removed tokens, vocabulary, negations and modals kept under each list. Works on counts of distinct words."""
    counts = terms.groupBy(F.col(word).alias("w")).agg(F.count("*").alias("n"))
    made = [counts.select(F.lit(name).alias("list"), F.lit(len(stop)).cast("bigint").alias("list_size"), "w", "n", (~F.col("w").isin(*stop) if stop else F.lit(True)).alias("kept")) for name, stop in (lists or STOP_LISTS).items()]
    num = lambda c: F.sum(F.when(F.col("kept") & c, F.col("n")).otherwise(0))
    return reduce(DataFrame.unionByName, made).groupBy("list", "list_size").agg(
        num(F.lit(True)).alias("kept_tokens"),
        (100 * (1 - num(F.lit(True)) / F.sum("n"))).alias("removed_pct"),
        F.sum(F.col("kept").cast("bigint")).alias("vocabulary"),
        num(F.col("w").isin(*lexicon.NEGATIONS)).alias("negations"),
        num(F.col("w").isin(*lexicon.MODALS)).alias("modals"),
    )


def order_effect(terms: DataFrame, stem=T.light_stem, stop: tuple[str, ...] = lexicon.CUSTOM_STOPWORDS, word: str = "term") -> DataFrame:
    """Stop words before or after stemming: distinct words that leak through, and that are lost, when stemming comes first."""
    counts = terms.groupBy(F.col(word).alias("w")).agg(F.count("*").alias("n"))
    flags = counts.select("n", F.col("w").isin(*stop).alias("a"), stem("w").isin(*stop).alias("b"))
    return flags.agg(F.sum((F.col("a") & ~F.col("b")).cast("bigint")).alias("leaked_words"), F.sum(F.when(F.col("a") & ~F.col("b"), F.col("n")).otherwise(0)).alias("leaked_tokens"), F.sum((~F.col("a") & F.col("b")).cast("bigint")).alias("lost_words"), F.sum(F.when(~F.col("a") & F.col("b"), F.col("n")).otherwise(0)).alias("lost_tokens"))


def stem_groups(words: DataFrame, stem: Column, top: int = 3, word: str = "word") -> tuple[DataFrame, DataFrame]:
    """Words, stems and reduction; and the largest groups of words that a stem merges."""
    pairs = words.select(F.col(word).alias("word")).distinct().withColumn("stem", stem)
    sizes = pairs.agg(F.count("*").alias("words"), F.count_distinct("stem").alias("stems")).withColumn("reduction_pct", 100 * (1 - F.col("stems") / F.col("words")))
    groups = pairs.groupBy("stem").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("word")).alias("members")).orderBy(F.desc("n"), "stem").limit(top)
    return sizes, groups


def stem_pairs(pairs: DataFrame, stems: DataFrame) -> DataFrame:
    """a, b, same (should they share a stem): verdict ok, UNDER or OVER by a table of word and stem."""
    both = pairs.join(stems.select(F.col("word").alias("a"), F.col("stem").alias("sa")), "a").join(stems.select(F.col("word").alias("b"), F.col("stem").alias("sb")), "b")
    equal = F.col("sa") == F.col("sb")
    return both.select("a", "b", "same", F.when(equal == F.col("same"), "ok").when(F.col("same"), "UNDER").otherwise("OVER").alias("verdict"))


def sentence_ngrams(sentences: DataFrame, sizes=(1, 2, 3, 4, 5), terms: str = "terms") -> DataFrame:
    """n, gram, count over sentences' term arrays; a gram never crosses a sentence."""
    def named(n):
        return F.transform(T.ngrams(F.col(terms), n), lambda g: F.struct(F.lit(n).cast("bigint").alias("n"), F.array_join(g, " ").alias("gram")))

    made = F.flatten(F.array(*[named(n) for n in sizes]))
    return sentences.select(F.explode(made).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("count"))


#: Tokens that are cut into n-grams at once, and the parts that a hash's first bits choose among, for each shuffle partition.
_AT_ONCE, _PARTS = 1 << 20, 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: one to one, and every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _counted(gram: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if count is None:
        return np.unique(gram, return_counts=True)
    order = np.argsort(gram)
    gram = gram[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.add.reduceat(count[order], first) if len(gram) else count


def _windows(lists: pa.ListArray, sizes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """n, place of the first token, hashes of tokens, hashes of n-grams and where they begin, for a few sentences' hashes at once."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.cumsum(size)
    row = 0
    while row < len(size):
        last = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + _AT_ONCE, "right")))
        first = int(ends[row] - size[row])
        h = values[first : ends[last - 1]]
        left = np.repeat(ends[row:last] - first, size[row:last]) - np.arange(len(h))  # tokens from here to the sentence's end
        gram = _mixed(h)
        for n in range(1, max(sizes) + 1):
            if n > 1:
                gram = _mixed(gram[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :])
            if len(h) < n:
                break
            if n in sizes:
                at = np.flatnonzero(left[: len(gram)] >= n)
                yield n, first, h, gram[at], at
        row = last


def _packed(sentences: DataFrame, sizes, terms: str, stop: np.ndarray | None = None) -> DataFrame:
    """n, part, grams, counts: hashes of n-grams and their counts, packed by parts of the hashes' range; without those that begin or end with a hash of ``stop``."""
    parts = _PARTS * int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = pa.schema([("n", pa.int64()), ("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def cut(batches):
        for batch in batches:
            for n, _, h, gram, at in _windows(batch.column(0), sizes):
                if stop is not None:
                    out = np.isin(h, stop)
                    gram = gram[~out[at] & ~out[at + n - 1]]
                own, count = _counted(gram)
                part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(own) else np.zeros(0, np.int64)
                bounds = [*begins.tolist(), len(own)]
                count = count.astype(np.int64)
                made = [(own[i:j].tobytes(), count[i:j].tobytes()) for i, j in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(made), pa.int64()), pa.array(part[begins].astype(np.int32)), pa.array([g for g, _ in made], pa.binary()), pa.array([c for _, c in made], pa.binary())], schema=packed)

    return sentences.select(_hashes(terms).alias("h")).mapInArrow(cut, "n long, part int, grams binary, counts binary")


def _hashes(terms: str) -> Column:
    return F.transform(terms, lambda w: F.xxhash64(w))


def _sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _counted(*(np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("grams", np.uint64), ("counts", np.int64))))


def hashed_ngrams(sentences: DataFrame, sizes=(1, 2, 3, 4, 5), terms: str = "terms") -> DataFrame:
    """n, gram (64 bits of hash), count: as :func:`sentence_ngrams`, for tables that need counts only.

    Words are hashed once and n-grams are made of their hashes, array by array, so none is built or shuffled as text or as a
    row of its own: what goes on is packed by parts of the hashes' range. With k different grams the chance of any
    collision is about k² / 2⁶⁵.
    """
    result = pa.schema([("n", pa.int64()), ("gram", pa.int64()), ("count", pa.int64())])

    def count(key, table):
        own, sums = _sums(table)
        return pa.table([pa.array(np.full(len(own), key[0].as_py(), np.int64)), pa.array(own.view(np.int64)), pa.array(sums)], schema=result)

    return _packed(sentences, sizes, terms).groupBy("n", "part").applyInArrow(count, "n long, gram long, count long")


#: Hashes of n-grams whose text is looked for in one pass.
_NAMED = 1 << 20


def top_phrases(sentences: DataFrame, k: int = 10, sizes=(1, 2, 3, 4, 5), stop: tuple[str, ...] = lexicon.CUSTOM_STOPWORDS, terms: str = "terms") -> DataFrame:
    """n, gram, count: :func:`top_grams` of :func:`phrase_grams`; n-grams are counted by hashes, and only those that can be among the k are written out.

    ``sentences`` is read twice, and more often only where very many n-grams are as frequent as the k-th.
    """
    spark = sentences.sparkSession
    hashed = np.array(spark.range(1).select(F.array(*[F.xxhash64(F.lit(w)) for w in stop]).cast("array<bigint>").alias("h")).first()["h"], np.int64).view(np.uint64)
    result = pa.schema([("n", pa.int64()), ("gram", pa.int64()), ("count", pa.int64()), ("first", pa.bool_())])

    def count(key, table):
        # What a part has less often than its own k-th isn't among the k of all parts.
        own, sums = _sums(table)
        order = np.argsort(-sums, kind="stable")
        order = order[sums[order] >= sums[order[min(k, len(order)) - 1]]]
        return pa.table([pa.array(np.full(len(order), key[0].as_py(), np.int64)), pa.array(own[order].view(np.int64)), pa.array(sums[order]), pa.array(np.arange(len(order)) < k)], schema=result)

    path = scratch.new_path(spark, "phrases")
    _packed(sentences, sizes, terms, hashed).groupBy("n", "part").applyInArrow(count, "n long, gram long, count long, first boolean").write.parquet(path)
    best = spark.read.parquet(path)
    least = {r["n"]: r["c"][: k][-1] for r in best.where("first").groupBy("n").agg(F.slice(F.sort_array(F.collect_list("count"), False), 1, k).alias("c")).collect()}
    rows = best.where(reduce(lambda a, b: a | b, [(F.col("n") == n) & (F.col("count") >= c) for n, c in least.items()], F.lit(False)))
    passes = -(-rows.count() // _NAMED)
    kept = "n long, gram string, count long"
    done = spark.createDataFrame([], kept)
    named = pa.schema([("n", pa.int64()), ("gram", pa.string()), ("count", pa.int64())])
    for i in range(passes):
        wanted = {}
        found = rows.where(F.pmod("gram", F.lit(passes)) == i).select("n", "gram", "count").toArrow()
        n_, gram_, count_ = (found.column(c).to_numpy() for c in ("n", "gram", "count"))
        for n in least:
            own, sums = gram_[n_ == n].view(np.uint64), count_[n_ == n]
            order = np.argsort(own)
            wanted[n] = own[order], sums[order]
        shared = spark.sparkContext.broadcast(wanted)

        def name(batches, shared=shared):
            for batch in batches:
                words = batch.column(1).flatten()
                for n, first, h, gram, at in _windows(batch.column(0), sizes):
                    own, sums = shared.value.get(n, (np.zeros(0, np.uint64), None))
                    if not len(own):
                        continue
                    place = np.minimum(np.searchsorted(own, gram), len(own) - 1)
                    hit = own[place] == gram
                    out = np.isin(h, hashed)
                    hit &= ~out[at] & ~out[at + n - 1]
                    place, once = np.unique(place[hit], return_index=True)
                    begins = first + at[hit][once]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(place), pa.int64()), pa.array([" ".join(words.slice(b, n).to_pylist()) for b in begins.tolist()], pa.string()), pa.array(sums[place])], schema=named)

        made = sentences.select(_hashes(terms).alias("h"), terms).mapInArrow(name, kept).groupBy("n", "gram").agg(F.max("count").alias("count"))
        top = made.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("count"), "gram"))).where(F.col("r") <= k).drop("r")
        done = done.unionByName(spark.createDataFrame(top.collect(), kept))
    return done.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("count"), "gram"))).where(F.col("r") <= k).drop("r")


def ngram_summary(grams: DataFrame) -> DataFrame:
    once = F.sum((F.col("count") == 1).cast("bigint"))
    return grams.groupBy("n").agg(F.sum("count").alias("total"), F.count("*").alias("distinct"), (100 * once / F.count("*")).alias("seen_once_pct"))


def ngram_bins(grams: DataFrame) -> DataFrame:
    c = F.col("count")
    bin_ = F.when(c == 1, "1").when(c == 2, "2").when(c <= 5, "3-5").when(c <= 10, "6-10").otherwise(">10")
    return grams.groupBy("n", bin_.alias("bin")).agg(F.count("*").alias("grams"))


def phrase_grams(grams: DataFrame, stop: tuple[str, ...] = lexicon.CUSTOM_STOPWORDS) -> DataFrame:
    """N-grams that neither begin nor end with a stop word."""
    w = F.split("gram", " ")
    return grams.where(~F.element_at(w, 1).isin(*stop) & ~F.element_at(w, -1).isin(*stop))


def top_grams(grams: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent of each n, ties by the gram; frequency per thousand of its n."""
    w = Window.partitionBy("n")
    rows = grams.withColumn("per_thousand", 1000 * F.col("count") / F.sum("count").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), "gram")))
    return rows.where(F.col("rank") <= k)


def count_ngrams(text: str, n: int):
    """Of one text (a Column): its n-grams of content tokens, for an ad hoc count."""
    return F.transform(T.ngrams(T.content_tokens(text), n), lambda g: F.array_join(g, " "))


def vocabulary_sets(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b") -> DataFrame:
    """One row: distinct words that two sets of rows share, that only one has, and of both together."""
    count = lambda d, name: d.agg(F.count("*").alias(name))
    made = [count(a.intersect(b), "shared"), count(a.subtract(b), f"only_{name_a}"), count(b.subtract(a), f"only_{name_b}"), count(a.union(b).distinct(), "either")]
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), made)  # single rows
