"""Exact duplicates, shingle overlap, and document quality control of the corpus build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexicon, patterns
from lexmill.functions import text as T
from lexmill.sources import scratch

# Thresholds of the quality checks.
REJECT_WORDS, FLAG_WORDS, NON_ALPHA, SINGLES, ENGLISH, URLS, CITATIONS = 100, 300, 0.30, 0.10, 0.15, 10, 5
NEAR_JACCARD, NEAR_CONTAINMENT, NEAR_FLAG, SHINGLE = 0.2, 0.3, 0.80, 5


def folded(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal folded texts: digest, copies, first doc_id. Only counts travel, so a group may have any size."""
    return docs.select(key, F.sha2(folded(text), 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).where("copies > 1")


def shingles(text, k: int = SHINGLE) -> Column:
    """Distinct hashes of k lower-cased words in a row; a shorter text has none."""
    words = T.matches(F.lower(F.col(text)), r"\w+")
    n = F.size(words)
    # The words, the words from the second on, ... side by side: nothing is cut out of the array for each shingle.
    beside = F.arrays_zip(*[F.slice(words, i + 1, F.greatest(n - (k - 1), F.lit(0))).alias(f"w{i}") for i in range(k)])
    many = F.transform(beside, lambda z: F.xxhash64(F.concat_ws(" ", *[z[f"w{i}"] for i in range(k)])))
    return F.when(n >= k, F.array_distinct(many)).otherwise(F.array().cast("array<bigint>"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b, jaccard, containment, flagged: pairs of different shingle sets above the reporting thresholds, between the first documents of each set.

    Sets that are equal are one class (their copies never meet as pairs). Shingles that the same sets have are one row of
    their number, and a pair is met by what is rare in its smaller set: there the most frequent shingles, together less than
    the share that both thresholds ask for, make no pair alone. They are only counted for pairs that were met otherwise.
    """
    sets = docs.select(key, F.array_sort(shingles(text)).alias("s")).where(F.size("s") > 0)
    reps = sets.groupBy(F.xxhash64("s").alias("h")).agg(F.min_by("s", key).alias("s"), F.min(key).alias("id")).where(F.col("id").isNotNull()).select("id", "s", F.size("s").alias("n"))
    shared = _stored(_shared(_stored(_held(reps), "held")), "shared")
    share = min(NEAR_JACCARD, NEAR_CONTAINMENT) * (1 - 1e-9)
    frequent = Window.partitionBy("id").orderBy(F.desc("df"), "g")
    rows = shared.withColumn("rare", F.sum("w").over(frequent) >= share * F.col("n"))
    rows = rows.withColumn("rest", F.sum(F.when(F.col("rare"), 0).otherwise(F.col("w"))).over(Window.partitionBy("id")))
    a, b = rows.where("rare").alias("a"), shared.alias("b").hint("merge")
    smaller = F.struct("a.n", "a.id") < F.struct("b.n", "b.id")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & smaller).groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.rest").alias("rest")).agg(F.sum("a.w").alias("inter"))
    near = lambda k: (k / (F.col("na") + F.col("nb") - k) >= NEAR_JACCARD) | (k / F.col("na") >= NEAR_CONTAINMENT)
    left = rows.where(~F.col("rare")).groupBy(F.col("id").alias("a")).agg(F.collect_list(F.struct("g", "w")).alias("left"))
    own = shared.groupBy(F.col("id").alias("b")).agg(F.collect_list("g").alias("own"))
    pairs = met.where(near(F.col("inter") + F.col("rest"))).join(left, "a", "left").join(own, "b")
    more = F.aggregate(F.filter("left", lambda x: F.array_contains("own", x["g"])), F.lit(0).cast("bigint"), lambda n, x: n + x["w"])
    pairs = pairs.withColumn("inter", F.col("inter") + F.coalesce(more, F.lit(0))).where(near(F.col("inter")))
    scored = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard"), (F.col("inter") / F.col("na")).alias("containment"))
    return scored.withColumn("flagged", (F.col("jaccard") >= NEAR_FLAG) | (F.col("containment") >= NEAR_FLAG))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch.new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _held(reps: DataFrame) -> DataFrame:
    """id, n, g, df, x, y: the shingles of several sets, with the number of these sets and 128 bits of hash of them."""
    of = Window.partitionBy("g")
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), F.col("id"))).over(of)
    rows = reps.select("id", "n", F.explode("s").alias("g"))
    return rows.select("id", "n", "g", F.count("*").over(of).alias("df"), mark(1).alias("x"), mark(2).alias("y")).where("df > 1")


def _shared(held: DataFrame) -> DataFrame:
    """id, n, g, df, w: one shingle g for all w that the same sets have."""
    first = held.groupBy("df", "x", "y").agg(F.min("g").alias("g"), F.count("*").alias("w"))
    return held.select("id", "n", "g").join(first.select("g", "df", F.expr("w DIV df").alias("w")), "g")


def near_duplicate_members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, first_id, copies: the class of equal shingle sets that each document with a shingle is in, by the first document of it.

    With :func:`near_duplicates` on first_id this gives the links of every copy; members of one class have Jaccard 1.
    """
    sets = docs.select(key, F.array_sort(shingles(text)).alias("s")).where(F.size("s") > 0).select(key, F.xxhash64("s").alias("h"))
    classes = sets.groupBy("h").agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return sets.join(classes, "h", "left").select(F.col(key), F.coalesce("first_id", key).alias("first_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


#: What counts as a citation.
CITATION = r"\([A-Z][A-Za-z'\-]+ (et al\.?|and [A-Z][A-Za-z'\-]+),? \d{4}[a-z]?\)|\[\d+(?:[,–-]\s*\d+)*\]"


def quality_flags(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """words, flags and status (reject, flag, pass) of each document. Shares are of what there is: a text without letters or tokens has none to flag."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(t, F.lit(r"(?U)\w+"))
    # A word's neighbours are counted without building arrays of tokens.
    tokens = F.regexp_count(t, F.lit("[A-Za-z]+"))
    singles = F.regexp_count(t, F.lit("(?<![A-Za-z])[B-HJ-Zb-hj-z](?![A-Za-z])"))
    marks = "|".join(sorted(lexicon.ENGLISH_MARKS))
    english = F.regexp_count(F.lower(t), F.lit(f"(?<![a-z])(?:{marks})(?![a-z])"))
    ink = F.regexp_replace(t, r"(?U)\s+", "")
    non_alpha = F.regexp_count(ink, F.lit(r"[^\p{L}]"))
    dense = lambda p, most: 1000 * F.regexp_count(t, F.lit(p)) > most * F.greatest(words, F.lit(1))
    leftover = F.exists(F.array(*[F.lit(p) for p in lexicon.LEFTOVER_PHRASES]), lambda p: F.lower(t).contains(p))
    toc = F.exists(F.split(t, "\n"), lambda x: x.rlike(patterns.TOC_LINE))
    checks = [
        (words < REJECT_WORDS, "REJECT:too_short"),
        ((words >= REJECT_WORDS) & (words < FLAG_WORDS), "short"),
        (t.contains("\ufffd"), "replacement_chars"),
        (t.rlike("[ﬀ-ﬆ]"), "ligatures"),
        (non_alpha > NON_ALPHA * F.length(ink), "non_alpha"),
        (singles > SINGLES * tokens, "broken_spacing"),
        (english < ENGLISH * tokens, "not_english"),
        (toc, "toc_lines"),
        (dense(r"https?://|www\.", URLS), "urls"),
        (dense(CITATION, CITATIONS), "citations"),
        (leftover, "leftovers"),
    ]
    flags = F.filter(F.array(*[F.when(c, n) for c, n in checks]), lambda x: x.isNotNull())
    rows = docs.select(key, words.cast("bigint").alias("words"), flags.alias("_f"))
    status = F.when(F.exists("_f", lambda x: x.startswith("REJECT")), "reject").when(F.size("_f") > 0, "flag").otherwise("pass")
    return rows.select(key, "words", F.array_join("_f", "; ").alias("flags"), status.alias("status"))


def dictionary_share(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Share of a document's tokens of four letters or more that a word list (``word``) knows, with or without a suffix."""
    # Suffixes that may be taken off.
    ends = ("s", "es", "ed", "ing", "ly", "al", "er", "ers", "ment", "ness", "ion", "ions")
    counts = docs.select(key, F.explode(T.matches(F.lower(F.col(text)), r"[a-z]{4,}")).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    forms = counts.select("w").distinct().withColumn("form", F.explode(F.concat(F.array("w"), F.filter(F.array(*[F.when(F.col("w").endswith(e), F.left("w", F.length("w") - len(e))) for e in ends]), lambda x: x.isNotNull()))))
    known = forms.join(words.select(F.col("word").alias("form")).distinct(), "form", "left_semi").select("w").distinct().withColumn("known", F.lit(1))
    return counts.join(known, "w", "left").groupBy(key).agg((F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("known_share"))


def topic_alignment(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each topic, its seeds' occurrences (without overlap) in a thousand words."""
    low, words = F.lower(F.col(text)), F.greatest(F.regexp_count(F.col(text), F.lit(r"(?U)\w+")), F.lit(1))
    count = lambda s: (F.length(low) - F.length(F.replace(low, F.lit(s), F.lit("")))) / len(s)
    return docs.select(key, *[(1000 * sum((count(s) for s in seeds), F.lit(0)) / words).alias(topic) for topic, seeds in lexicon.TOPIC_SEEDS.items()])


def top_terms(docs: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k terms of each document by tf / total * ln((N + 1) / (df + 0.5))."""
    found = docs.select(key, F.explode(T.matches(F.lower(F.col(text)), r"[a-z][a-z\-]{2,}")).alias("term")).where(~F.col("term").isin(*lexicon.QC_STOPWORDS))
    tf = found.groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    rows = tf.withColumn("total", F.sum("tf").over(Window.partitionBy(key))).join(df, "term").crossJoin(F.broadcast(n))
    rows = rows.withColumn("score", F.col("tf") / F.col("total") * F.log((F.col("n") + 1) / (F.col("df") + 0.5)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "term")))
    return rows.where(F.col("rank") <= k).select(key, "rank", "term", "score")


def validate(rows: DataFrame, rules: dict[str, dict], stage: str = "final", key: str = "doc_id") -> DataFrame:
    """doc_id, field, severity, problem. A rule may have required, pattern, vocab (list) and list (separator ``;``); TODO is an error in the final stage, else pending."""
    at = lambda bad, f, severity, what: rows.where(bad).select(F.col(key).cast("string").alias("doc_id"), F.lit(f).alias("field"), F.lit(severity).alias("severity"), F.lit(what).alias("problem"))
    out = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).cast("string").alias("doc_id"), F.lit(key).alias("field"), F.lit("ERROR").alias("severity"), F.lit("duplicate id").alias("problem"))
    for f, rule in rules.items():
        v = F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) if f in rows.columns else F.lit("")
        todo = v.startswith("TODO")
        out = out.unionByName(at(todo, f, "ERROR" if stage == "final" else "PENDING", "TODO"))
        if rule.get("required"):
            out = out.unionByName(at(v == "", f, "ERROR", "missing"))
        if p := rule.get("pattern"):
            out = out.unionByName(at((v != "") & ~todo & ~v.rlike(p), f, "ERROR", "pattern"))
        if vocab := rule.get("vocab"):
            values = F.transform(F.split(v, ";"), lambda x: F.trim(x)) if rule.get("list") else F.array(v)
            out = out.unionByName(at(~todo & F.exists(values, lambda x: (x != "") & ~x.isin(*vocab)), f, "WARN" if rule.get("open") else "ERROR", "vocabulary"))
    return out
