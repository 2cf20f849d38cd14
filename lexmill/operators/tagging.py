"""Rule and learned taggers, dictionary entities, multiset scores, nearest-neighbour votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexicon
from lexmill.functions import text as T


def rule_tag(token, base: Column | None = None) -> Column:
    """The dictionary's tag, else the first fitting shape's, else the base tagger's (null without one)."""
    t = F.col(token) if isinstance(token, str) else token
    out = F.lit(None).cast("string")
    tag = None
    for name, words in lexicon.TAG_LEXICON.items():
        c = F.lower(t).isin(*words)
        tag = F.when(c, name) if tag is None else tag.when(c, name)
    for shape, name in lexicon.TAG_SHAPES:
        tag = tag.when(t.rlike(shape), name)
    return tag.otherwise(base if base is not None else out)


def is_domain_token(token) -> Column:
    return rule_tag(token).isNotNull()


def accuracy(rows: DataFrame, pred: str = "pred", gold: str = "gold", token: str = "token") -> DataFrame:
    ok = (F.col(pred).eqNullSafe(F.col(gold))).cast("double")
    return rows.agg(F.count("*").alias("tokens"), (100 * F.avg(ok)).alias("accuracy"), (100 * F.avg(F.when(is_domain_token(token), ok))).alias("domain_accuracy"))


def _contexts(tagged: DataFrame) -> DataFrame:
    w = Window.partitionBy("sent_id").orderBy("position")
    return tagged.withColumn("p1", F.coalesce(F.lag("tag", 1).over(w), F.lit("^"))).withColumn("p2", F.coalesce(F.lag("tag", 2).over(w), F.lit("^")))


def train_backoff(tagged: DataFrame) -> DataFrame:
    """Tables of a trigram, bigram, unigram and affix chain over (sent_id, position, token, tag): level, key, tag. The most frequent tag of a context, ties by tag."""
    rows = _contexts(tagged)
    sep = "\u0001"
    keys = F.array(
        F.struct(F.lit(3).alias("level"), F.concat_ws(sep, "p2", "p1", "token").alias("key")),
        F.struct(F.lit(2).alias("level"), F.concat_ws(sep, "p1", "token").alias("key")),
        F.struct(F.lit(1).alias("level"), F.col("token").alias("key")),
        F.struct(F.lit(0).alias("level"), F.when(F.length("token") >= 5, F.right("token", F.lit(3))).alias("key")),
    )
    counts = rows.select(F.explode(keys).alias("k"), "tag").where(F.col("k.key").isNotNull()).groupBy("k.level", "k.key", "tag").agg(F.count("*").alias("n"))
    best = Window.partitionBy("level", "key").orderBy(F.desc("n"), "tag")
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").select("level", "key", "tag")


def tag_backoff(sentences: DataFrame, model: DataFrame, default: str = "NN") -> DataFrame:
    """sent_id, tokens (array) to sent_id, tags. Decoding goes left to right, so it is a loop in Arrow batches; the tables are collected once and must be of model size."""
    tables: dict[int, dict[str, str]] = {0: {}, 1: {}, 2: {}, 3: {}}
    for r in model.collect():
        tables[r["level"]][r["key"]] = r["tag"]
    shared = sentences.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("array<string>")
    def decode(tokens):
        t = shared.value

        def one(words):
            p2 = p1 = "^"
            out = []
            for w in words:
                tag = t[3].get(f"{p2}\u0001{p1}\u0001{w}") or t[2].get(f"{p1}\u0001{w}") or t[1].get(w) or (t[0].get(w[-3:]) if len(w) >= 5 else None) or default
                out.append(tag)
                p2, p1 = p1, tag
            return out

        return tokens.map(one)

    return sentences.select("sent_id", decode("tokens").alias("tags"))


def token_features(tagged: DataFrame) -> DataFrame:
    """Word, neighbours, length, first and last character of each token."""
    w = Window.partitionBy("sent_id").orderBy("position")
    return tagged.select("*", F.coalesce(F.lag("token").over(w), F.lit("START")).alias("previous_word"), F.coalesce(F.lead("token").over(w), F.lit("END")).alias("next_word"), F.length("token").alias("word_length"), F.left("token", F.lit(1)).alias("first_char"), F.right("token", F.lit(1)).alias("last_char"))


def knn_tag(train: DataFrame, test: DataFrame, k: int = 3, categorical=("token", "previous_word", "next_word", "first_char", "last_char"), numeric: str = "word_length") -> DataFrame:
    """The most frequent tag of the k nearest distinct training rows by one-hot distance, (sent_id, position, pred).

    Two differing categories are at squared distance 2. Test rows are a bounded set: they are broadcast in full.
    """
    rows = train.groupBy(*categorical, numeric, "tag").agg(F.count("*").alias("n"))
    d = sum((F.when(F.col(f"a.{c}") == F.col(f"b.{c}"), 0).otherwise(2) for c in categorical), F.lit(0)) + F.pow(F.col(f"a.{numeric}") - F.col(f"b.{numeric}"), 2)
    met = rows.alias("a").crossJoin(F.broadcast(test.alias("b"))).select("b.sent_id", "b.position", "a.tag", "a.n", d.alias("d"), F.struct(*[F.col(f"a.{c}") for c in categorical]).alias("w"))
    best = Window.partitionBy("sent_id", "position").orderBy("d", "w", "tag")
    near = met.withColumn("had", F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("had") < k)
    votes = near.groupBy("sent_id", "position", "tag").agg(F.sum(F.least(F.col("n"), k - F.col("had"))).alias("v"))
    return votes.groupBy("sent_id", "position").agg(F.max_by("tag", F.struct("v", "tag")).alias("pred"))


def _gazetteer(table=None, cased=lexicon.CASED):
    table = table or lexicon.ENTITIES
    return sorted(((t, label, t in cased) for label, words in table.items() for t in words), key=lambda x: (-len(x[0]), x[0]))


def entities(text, table: dict | None = None) -> Column:
    """Entities of the dictionary and helpline numbers: array of struct(text, label), longest match first at each place."""
    import re

    rows = _gazetteer(table)
    body = "|".join((re.escape(t) if cased else f"(?i:{re.escape(t)})") for t, _, cased in rows)
    found = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(rf"(?U)(?<![\w-])(?:{body}|988|1-8\d\d-\d{{3}}-\d{{4}})(?![\w-])"), F.lit(0))
    label = F.create_map(*[F.lit(x) for t, name, cased in rows for x in ((t if cased else t.lower()), name)]) if rows else F.create_map()
    kind = lambda m: F.coalesce(F.try_element_at(label, m), F.try_element_at(label, F.lower(m)), F.lit("HELPLINE"))
    return F.transform(found, lambda m: F.struct(m.alias("text"), kind(m).alias("label")))


def entity_counts(docs: DataFrame, table: dict | None = None, top: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """label, occurrences, documents and the most frequent entities."""
    found = docs.select(key, F.explode(entities(text, table)).alias("e")).select(key, "e.label", F.lower("e.text").alias("entity"))
    per = found.groupBy("label", "entity", key).agg(F.count("*").alias("n"))
    sums = per.groupBy("label").agg(F.sum("n").alias("occurrences"), F.count_distinct(key).alias("documents"))
    ranked = per.groupBy("label", "entity").agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "entity"))).where(F.col("r") <= top)
    return sums.join(ranked.groupBy("label").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda x: x["entity"])).alias("examples")), "label")


def bag_score(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Correct, incorrect, missed, precision, recall, f1 of two multisets of rows; ``by`` are scopes among the keys."""
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    p = pred.groupBy(*keys).agg(F.count("*").alias("p"))
    rows = g.join(p, keys, "full_outer").na.fill(0, ["g", "p"])
    s = rows.groupBy(*(by or [])).agg(F.sum(F.least("g", "p")).alias("correct"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("incorrect"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("missed"))
    return _measures(s)


def _measures(s: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    s = s.withColumn("precision", ratio(F.col("correct"), F.col("correct") + F.col("incorrect"))).withColumn("recall", ratio(F.col("correct"), F.col("correct") + F.col("missed")))
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def stem_score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`bag_score` of a document's content terms against their light stems, by document and term, without a row a token.

    A term that stays as it is is correct, as its stem comes at least as often; so only terms that a stem changes have to be
    counted, and only in documents where one of them is also another's stem.
    """
    rows = docs.groupBy(key).agg(F.collect_list(text).alias("texts")).select(key, F.flatten(F.transform("texts", T.content_tokens)).alias("t"))
    rows = rows.select(key, F.size("t").alias("n"), F.filter("t", T.may_stem).alias("t"))
    rows = rows.select(key, "n", F.filter(F.transform("t", lambda w: F.struct(w.alias("w"), T.light_stem(w).alias("s"))), lambda x: x["w"] != x["s"]).alias("m"))
    rows = rows.select(key, "n", F.col("m.w").alias("w"), F.col("m.s").alias("s"))
    one = lambda term, g, p, n, same: F.struct(term.alias("term"), g.cast("bigint").alias("g"), p.cast("bigint").alias("p"), n.cast("bigint").alias("n"), same.cast("bigint").alias("same"))
    zero, unit = F.lit(0), F.lit(1)
    # Rows without a key meet none, as in a join.
    whole = F.array(one(F.lit(None).cast("string"), zero, zero, F.col("n"), F.when(F.col(key).isNull(), 0).otherwise(F.col("n") - F.size("w"))))
    parts = F.concat(F.transform("w", lambda x: one(x, unit, zero, zero, zero)), F.transform("s", lambda x: one(x, zero, unit, zero, zero)))
    each = rows.select(key, F.inline(F.concat(whole, F.when(F.col(key).isNotNull() & F.arrays_overlap("w", "s"), parts).otherwise(F.filter(parts, lambda _: F.lit(False))))))
    sums = each.groupBy(key, "term").agg(*[F.sum(c).alias(c) for c in ("g", "p", "n", "same")])
    s = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("correct", F.least("g", "p") + F.col("same")), ("n", F.col("n")))])
    return _measures(s.select("correct", (F.col("n") - F.col("correct")).alias("incorrect"), (F.col("n") - F.col("correct")).alias("missed")))


def entity_table(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Each mention once: Correct, Incorrect or Missed; repeated mentions are matched in number."""
    order = Window.partitionBy(*keys).orderBy(F.lit(0))
    g, p = (d.select(*keys).withColumn("_i", F.row_number().over(order)).withColumn(n, F.lit(True)) for d, n in ((gold, "_g"), (pred, "_p")))
    rows = g.join(p, [*keys, "_i"], "full_outer")
    return rows.select(*keys, F.when(F.col("_g") & F.col("_p"), "Correct").when(F.col("_p"), "Incorrect").otherwise("Missed").alias("verdict"))


def hash_sample(rows: DataFrame, n: int, key: str, seed: int = 134) -> DataFrame:
    """n rows, the same for a seed however the table is partitioned."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def phrases(docs: DataFrame, most: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Instruction sentences: at least five words and an imperative or advising beginning, the first ``most`` of a document."""
    s = F.filter(T.sentences(text), lambda x: (F.size(T.whitespace_tokens(x)) >= 5) & x.rlike(r"(?i)^(do|don't|try|ask|talk|call|offer|consider|use|avoid|take|make|keep|seek|you (should|can|must|may))\b"))
    return docs.select(key, F.posexplode(F.slice(s, 1, most)).alias("at", "sentence"))
